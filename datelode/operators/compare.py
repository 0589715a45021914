"""Before and after a pass: what it improved, and how its evidence is spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def improved(before: DataFrame, evidence: DataFrame, threshold: float = 0.6) -> DataFrame:
    """One row: newly (items without a time that now have evidence), boosted (those with a weak one). before(item_id, final_datetime, confidence)."""
    have = evidence.select("item_id").distinct()
    rows = before.join(have, "item_id", "left_semi")
    return rows.agg(F.count_if(F.col("final_datetime").isNull()).alias("newly"), F.count_if(F.col("final_datetime").isNotNull() & (F.col("confidence") < threshold)).alias("boosted"))


def bins(confidence: Column, edges: tuple[float, ...]) -> Column:
    """Name of the half-open bin of a confidence: '>=0.9', '0.7~0.9', ..., '<0.5' for edges from high to low."""
    out = F.when(confidence >= edges[0], F.lit(f">={edges[0]}"))
    for high, low in zip(edges, edges[1:], strict=False):
        out = out.when(confidence >= low, F.lit(f"{low}~{high}"))
    return out.otherwise(F.lit(f"<{edges[-1]}"))


def spread(evidence: DataFrame, edges: tuple[float, ...] = (0.6, 0.4)) -> DataFrame:
    """precision, bin, n of evidence(precision, confidence)."""
    return evidence.groupBy("precision", bins(F.col("confidence"), edges).alias("bin")).agg(F.count("*").alias("n"))
