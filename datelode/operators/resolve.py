"""Resolution: rank the evidence of an item, choose one, count conflicts, derive the interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from datelode.functions.timeparts import interval_bounds, micros_between, precision_rank

CONFLICT_CONFIDENCE = 0.5
CONFLICT_DAYS = 30
_DAY = 86_400_000_000


def _by_rank() -> WindowSpec:
    return Window.partitionBy("item_id").orderBy(F.desc("is_direct"), F.desc("confidence"), F.desc(precision_rank(F.col("precision"))), "ev_seq")


def rank_evidence(evidence: DataFrame) -> DataFrame:
    """Adds rn: direct first, then confidence, precision, and order of emission."""
    return evidence.where("dt IS NOT NULL").withColumn("rn", F.row_number().over(_by_rank()))


def resolve(evidence: DataFrame) -> DataFrame:
    """item_id, final_datetime, confidence, precision, range_start, range_end, primary_source, source_summary, n_conflicts.

    One window and one aggregate on the same key: a single exchange and a single sort. The window holds the evidence of
    one item, a handful of rows.
    """
    first = _by_rank().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = {"rn": F.row_number().over(_by_rank()), "p_dt": F.first("dt").over(first), "p_source": F.first("source").over(first)}
    ranked = evidence.where("dt IS NOT NULL").withColumns(own)
    apart = F.abs(micros_between(F.col("p_dt"), F.col("dt")))
    limit = F.when(F.col("source") == F.col("p_source"), F.lit(2 * CONFLICT_DAYS * _DAY)).otherwise(F.lit(CONFLICT_DAYS * _DAY))
    conflict = (F.col("rn") > 1) & (F.col("confidence") >= CONFLICT_CONFIDENCE) & (apart > limit)
    found = ranked.groupBy("item_id").agg(
        F.min_by(F.struct("dt", "confidence", "precision", "source"), "rn").alias("p"),
        F.count_if(conflict).alias("n_conflicts"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rn", "source"))), lambda x: x["source"])).alias("source_summary"),
    )
    start, end = interval_bounds(F.col("p.dt"), F.col("p.precision"))
    return found.select("item_id", F.col("p.dt").alias("final_datetime"), F.col("p.confidence").alias("confidence"), F.col("p.precision").alias("precision"), start.alias("range_start"), end.alias("range_end"), F.col("p.source").alias("primary_source"), "source_summary", "n_conflicts")


def best_evidence(evidence: DataFrame) -> DataFrame:
    """The most certain row of each item, the first emitted of equal ones, whatever its kind."""
    rest = [c for c in evidence.columns if c != "item_id"]
    return evidence.groupBy("item_id").agg(F.max_by(F.struct(*rest), F.struct("confidence", -F.col("ev_seq"))).alias("e")).select("item_id", *[f"e.{c}" for c in rest])


def evidence_by(evidence: DataFrame, source: str | None = None, direct: bool | None = None) -> DataFrame:
    """Rows of one source, or only the direct (or indirect) ones."""
    rows = evidence if source is None else evidence.where(F.col("source") == source)
    return rows if direct is None else rows.where(F.col("is_direct") == direct)


def order_evidence(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Evidence at scale: the order date (direct) and each ship date (indirect) of an order."""
    made = orders.select(F.col("o_orderkey").alias("item_id"), F.lit(0).alias("ev_seq"), F.lit("order").alias("source"), F.col("o_orderdate").cast("timestamp_ntz").alias("dt"), F.lit("day").alias("precision"), F.lit(0.7).alias("confidence"), F.lit(True).alias("is_direct"))
    shipped = lineitem.select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("ev_seq"), F.lit("ship").alias("source"), F.col("l_shipdate").cast("timestamp_ntz").alias("dt"), F.lit("second").alias("precision"), F.lit(0.55).alias("confidence"), F.lit(False).alias("is_direct"))
    return made.unionByName(shipped)
