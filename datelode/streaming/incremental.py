"""Incremental runs: new files and new log rows flow through the same operators by Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from datelode.operators.evidence import all_evidence
from datelode.operators.resolve import resolve
from datelode.plans.export import latest


def resolve_stream(spark: SparkSession, source: str, schema, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch of new item rows (Parquet files in source) is resolved once and appended to out; runs until no file is new."""

    def batch(items: DataFrame, number: int) -> None:
        resolve(all_evidence(items)).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Evidence as resolve() reads it.
EVIDENCE = "item_id string, ev_seq int, source string, dt timestamp_ntz, precision string, confidence double, is_direct boolean"
_REST = ["ev_seq", "source", "dt", "precision", "confidence", "is_direct"]


def _gathered(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """All evidence of one item, what it had and what is new; the state is that list."""
    held = json.loads(state.get[0]) if state.exists else []
    for f in frames:
        held += [[int(r.ev_seq), r.source, None if pd.isna(r.dt) else r.dt.isoformat(), r.precision, None if pd.isna(r.confidence) else float(r.confidence), None if r.is_direct is None else bool(r.is_direct)] for r in f.itertuples()]
    state.update((json.dumps(held),))
    out = pd.DataFrame(held, columns=_REST)
    out["dt"] = pd.to_datetime(out["dt"], format="ISO8601")
    out.insert(0, "item_id", key[0])
    yield out


def resolve_with_state(evidence: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Evidence rows in any order and any number of batches: each item's rows are kept as state, and an item that a batch touches is resolved again over all of them.

    Each batch writes the new results of its items to out/batch=N, over what a failed attempt left; current()
    reads the last one of each item. State holds an item's evidence, a handful of rows, and has no timeout:
    late evidence counts whenever it comes.
    """

    def batch(rows: DataFrame, number: int) -> None:
        resolve(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows = evidence.where("item_id IS NOT NULL AND ev_seq IS NOT NULL").selectExpr(*[f"CAST({x.rsplit(' ', 1)[0]} AS {x.rsplit(' ', 1)[1]}) AS {x.rsplit(' ', 1)[0]}" for x in EVIDENCE.split(", ")])
    kept = rows.groupBy("item_id").applyInPandasWithState(_gathered, EVIDENCE, "rows string", "update", "NoTimeout")
    return kept.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The last result of each item that resolve_with_state() has written."""
    return latest(spark.read.parquet(out), "item_id", "batch").drop("batch")


def session_counts(events: DataFrame, time: str, key: str, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions of a stream by gap: key, start, end, n. A row exactly gap later begins a new session here."""
    windows = events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return windows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def for_each_batch(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
