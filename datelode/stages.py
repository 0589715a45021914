"""Stages as plug-ins: a name, a condition for each row, and a DataFrame function for the rows that pass it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datelode.operators.evidence import _entry as make_evidence  # noqa: F401

FLAGS, COMPLETED = "flags", "completed_stages"
UNSUPPORTED = "UNSUPPORTED"


def has_flag(name: str, column: str = FLAGS) -> Column:
    return F.coalesce(F.array_contains(column, name), F.lit(False))


def add_flag(name: str, column: str = FLAGS) -> Column:
    """The flags with name among them once."""
    return F.array_union(F.coalesce(column, F.array().cast("array<string>")), F.array(F.lit(name)))


def remove_flag(name: str, column: str = FLAGS) -> Column:
    return F.array_remove(F.coalesce(column, F.array().cast("array<string>")), name)


@dataclass(frozen=True)
class Stage:
    """process changes columns of the rows that are due, given as {column: expression}; all other rows pass as they are.

    Due is a row that is supported, has not been through the stage, and meets should_run. A batch stage
    (whole) gets all rows instead and answers for its own gate.
    """

    name: str
    process: Callable
    should_run: Column | None = None
    whole: bool = False

    def due(self) -> Column:
        open_ = ~has_flag(UNSUPPORTED) & ~has_flag(self.name, COMPLETED)
        return open_ if self.should_run is None else open_ & F.coalesce(self.should_run, F.lit(False))

    def run(self, items: DataFrame) -> DataFrame:
        if self.whole:
            return self.process(items).withColumn(COMPLETED, add_flag(self.name, COMPLETED))
        rows = items.withColumn("__due", self.due())
        changed = {c: F.when(F.col("__due"), e).otherwise(F.col(c)) if c in items.columns else F.when(F.col("__due"), e) for c, e in self.process(rows).items()}
        return rows.withColumns(changed | {COMPLETED: F.when(F.col("__due"), add_flag(self.name, COMPLETED)).otherwise(F.col(COMPLETED))}).drop("__due")


def run_stages(items: DataFrame, *stages: Stage) -> DataFrame:
    """items through the stages, one behind the other; row stages add no shuffle."""
    for stage in stages:
        items = items.transform(stage.run)
    return items
