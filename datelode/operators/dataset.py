"""Training samples for a date tagger from a dated album: segments of paths, their verdicts, intervals and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datelode.functions import paths
from datelode.functions.patterns import match_all
from datelode.functions.timeparts import precision_rank
from datelode.operators.profile import has_light_date
from datelode.sources.sampling import split

MAX_LENGTH = 64
CONFIDENT = 0.85


def segments(items: DataFrame) -> DataFrame:
    """items with source ('stem' or 'folder'), depth (-1, then 0 for the nearest of up to three folders) and text; empty names give none."""
    entry = lambda source, depth, text: F.struct(F.lit(source).alias("source"), depth.alias("depth"), text.alias("text"))
    folders = F.transform(paths.nearest_folders(F.col("relpath")), lambda t, k: entry("folder", k, t))
    return items.select("*", F.explode(F.concat(F.array(entry("stem", F.lit(-1), F.col("stem"))), folders)).alias("s")).select(*items.columns, "s.*").where("text <> ''")



def select_intervals(intervals: Column) -> Column:
    """Greedy choice from array<struct<rank, begin, end, ...>>: highest rank first, then the longest, then the first; none overlaps another."""
    ordered = F.array_sort(F.transform(intervals, lambda x: F.struct((-x["rank"]).alias("r"), (x["begin"] - x["end"]).alias("l"), x["begin"].alias("b"), x.alias("x"))))
    apart = lambda kept, x: ~F.exists(kept, lambda y: (y["x"]["begin"] < x["x"]["end"]) & (x["x"]["begin"] < y["x"]["end"]))
    chosen = F.aggregate(ordered, F.slice(ordered, 1, 0), lambda kept, x: F.when(apart(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return F.transform(chosen, lambda x: x["x"])


def verdicts(rows: DataFrame, max_length: int = MAX_LENGTH, confident: float = CONFIDENT) -> DataFrame:
    """Adds status to segments(text, exif_original, confidence): toolong, neg (no pattern fits), no_conf, noise or pos.

    pos needs a sure time and a pattern whose year, month and day (as far as it has them) are those of it.
    """
    found = match_all(F.col("text"))
    when = F.col("exif_original")

    def agrees(m: Column) -> Column:
        rank = precision_rank(m["precision"])
        return (F.year(m["dt"]) == F.year(when)) & ((rank < 2) | (F.month(m["dt"]) == F.month(when))) & ((rank < 3) | (F.dayofmonth(m["dt"]) == F.dayofmonth(when)))

    rows = rows.withColumn("__m", found)
    unsure = when.isNull() | (F.coalesce("confidence", F.lit(0.0)) < confident)
    status = F.when(F.length("text") > max_length, "toolong").when(F.size("__m") == 0, "neg").when(unsure, "no_conf").when(F.exists("__m", agrees), "pos").otherwise("noise")
    return rows.withColumn("status", status).drop("__m")


def segment_counts(rows: DataFrame, confident: float = 0.9) -> DataFrame:
    """One row: pos (dated by a light test, item surely dated), ambiguous (dated, item not sure), neg, ratio neg / pos."""
    dated, sure = has_light_date(F.col("text")), F.col("exif_original").isNotNull() & (F.coalesce("confidence", F.lit(0.0)) >= confident)
    counts = rows.agg(F.count_if(dated & sure).alias("pos"), F.count_if(dated & ~sure).alias("ambiguous"), F.count_if(~dated).alias("neg"))
    return counts.withColumn("ratio", F.round(F.col("neg") / F.nullif("pos", F.lit(0)), 1))


def write_dataset(samples: DataFrame, path: str, key: str = "item_id") -> None:
    """JSON lines below path, one folder a split; all samples of a key fall together."""
    samples.withColumn("split", split(F.col(key))).write.mode("overwrite").partitionBy("split").json(path)


def read_samples(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """chars, labels, clf_label of each sample; where the two arrays differ in length both are cut to the shorter."""
    rows = spark.read.schema("chars array<string>, labels array<string>, clf_label int").json(path)
    n = F.least(F.size("chars"), F.size("labels"))
    rows = rows.where(n > 0).select(F.slice("chars", F.lit(1), n).alias("chars"), F.slice("labels", F.lit(1), n).alias("labels"), "clf_label")
    return rows if limit is None else rows.limit(limit)
