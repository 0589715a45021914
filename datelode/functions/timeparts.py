"""Precision ranks and the interval that a time of some precision stands for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRECISIONS = ["unknown", "year", "month", "day", "hour", "minute", "second"]  # by rank


def precision_rank(precision: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for rank, name in enumerate(PRECISIONS):
        out = out.when(precision == name, F.lit(rank))
    return out.otherwise(F.lit(0))


def micros_between(a: Column, b: Column) -> Column:
    """b - a in microseconds, exact for timestamps without zone."""
    return F.timestamp_diff("MICROSECOND", a, b)


def interval_bounds(dt: Column, precision: Column) -> tuple[Column, Column]:
    """Start and end of the interval: a point, +-30 s, +-30 min, or the whole day, month or year."""
    wide = lambda unit: F.date_trunc(unit, dt).cast("timestamp_ntz")
    last = F.expr("INTERVAL '1' MICROSECOND")
    start = (
        F.when(precision == "second", dt)
        .when(precision == "minute", dt - F.expr("INTERVAL '30' SECOND"))
        .when(precision == "hour", dt - F.expr("INTERVAL '30' MINUTE"))
        .when(precision == "day", wide("DAY"))
        .when(precision == "month", wide("MONTH"))
        .when(precision == "year", wide("YEAR"))
    )
    end = (
        F.when(precision == "second", dt)
        .when(precision == "minute", dt + F.expr("INTERVAL '30' SECOND"))
        .when(precision == "hour", dt + F.expr("INTERVAL '30' MINUTE"))
        .when(precision == "day", wide("DAY") + F.expr("INTERVAL '1' DAY") - last)
        .when(precision == "month", wide("MONTH") + F.expr("INTERVAL '1' MONTH") - last)
        .when(precision == "year", wide("YEAR") + F.expr("INTERVAL '1' YEAR") - last)
    )
    return start, end
