"""Checkpoints and snapshots of items: restore, statistics, dumps, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datelode.plans.export import latest

#: State that a checkpoint overwrites, and facts that it fills in where it has them.
STATE, FACTS = ["flags", "completed_stages"], ["sha1", "width"]


def restore(items: DataFrame, log: DataFrame, key: str = "item_id", order: str = "seq", state: list[str] | None = None, facts: list[str] | None = None) -> DataFrame:
    """items with the state of the last row of each key in log; rows that log does not have stay as they are.

    state columns are taken over as they are (null: none), facts only where log has one that is not empty.
    """
    state, facts = STATE if state is None else state, FACTS if facts is None else facts
    saved = latest(log.select(key, order, *state, *facts), key, order).select(key, F.lit(True).alias("__known"), *[F.col(c).alias(f"__{c}") for c in (*state, *facts)])
    rows = items.join(saved, key, "left")
    filled = {c: F.when(F.col("__known"), F.coalesce(f"__{c}", F.array().cast(items.schema[c].dataType))).otherwise(F.col(c)) for c in state}
    for c in facts:
        known = F.col(f"__{c}").isNotNull() & (F.col(f"__{c}").cast("string") != "") & (F.col(f"__{c}").cast("string") != "0")
        filled[c] = F.when(known, F.col(f"__{c}")).otherwise(F.col(c))
    return rows.withColumns(filled).select(*items.columns)


def first_rows(log: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key: what a snapshot keeps of repeated ids."""
    rest = [c for c in log.columns if c != key]
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, *[f"r.{c}" for c in rest])


def snapshot_stats(items: DataFrame) -> DataFrame:
    """kind, name, n for items(final_datetime, exif_original, embedding, flags, completed_stages): totals, and how often each flag and stage stands.

    One pass: every row becomes its few counters, which are summed before they are shuffled.
    """
    entry = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    total = lambda name, condition: F.when(condition, entry("total", F.lit(name)))
    totals = F.array_compact(F.array(total("total", F.lit(True)), total("resolved", F.col("final_datetime").isNotNull()), total("has_exif", F.col("exif_original").isNotNull()), total("has_clip", F.col("embedding").isNotNull())))
    each = lambda kind, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: entry(kind, x))
    return items.select(F.explode(F.concat(totals, each("flag", "flags"), each("stage", "completed_stages"))).alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def json_rows(items: DataFrame, *columns: str) -> DataFrame:
    """One column, json: each row as an object of its columns."""
    return items.select(F.to_json(F.struct(*(columns or items.columns))).alias("json"))


def compact(log: DataFrame, key: str, order: str, path: str) -> None:
    """The last rows of a log as a table of their own at path (another folder than the log's)."""
    latest(log, key, order).write.mode("overwrite").parquet(path)
