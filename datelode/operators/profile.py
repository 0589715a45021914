"""Profiles of a collection: histograms, coverage and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datelode.operators.components import saved

# Light date tests of a name.
LIGHT_DATES = [
    r"(?<![0-9])(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])(?:[_-](?:[01][0-9]|2[0-3])[0-5][0-9][0-5][0-9])?(?![0-9])",
    r"(?:19|20)[0-9]{2}[-_.](?:0[1-9]|1[0-2])[-_.](?:0[1-9]|[12][0-9]|3[01])",
    r"(?:19|20)[0-9]{2}年(?:0?[1-9]|1[0-2])月(?:0?[1-9]|[12][0-9]|3[01])日",
    r"(?<![0-9])(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?![0-9])",
    r"(?:19|20)[0-9]{2}[-_.](?:0[1-9]|1[0-2])(?![-_.0-9])",
    r"(?:19|20)[0-9]{2}年(?:0?[1-9]|1[0-2])月",
    r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])",
    r"(?:19|20)[0-9]{2}年",
]


def histogram(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def confidence_bucket(c: Column) -> Column:
    return F.when(c >= 0.9, ">=0.9").when(c >= 0.7, "0.7-0.9").when(c >= 0.5, "0.5-0.7").when(c >= 0.3, "0.3-0.5").otherwise("<0.3")


def length_bucket(n: Column) -> Column:
    out = F.when(n <= 4, "0-4")
    for low, high in ((5, 8), (9, 12), (13, 16), (17, 24), (25, 32), (33, 48), (49, 64)):
        out = out.when(n <= high, f"{low}-{high}")
    return out.otherwise("65+")


# Classes of characters; what is in none is 'other'.
CLASSES = {"digit": "[0-9]", "latin": "[A-Za-z]", "han": "[\\x{4E00}-\\x{9FFF}]", "separator": "[-_. /:]"}


def char_histogram(texts: DataFrame, column: str) -> DataFrame:
    """char_class, n over all characters: five counts a text are summed, no character becomes a row."""
    t = F.coalesce(F.col(column), F.lit(""))
    counts = {name: F.length(t) - F.length(F.regexp_replace(t, r, "")) for name, r in CLASSES.items()}
    counts["other"] = F.length(F.regexp_replace(t, "|".join(CLASSES.values()), ""))
    sums = texts.agg(*[F.sum(c.cast("long")).alias(name) for name, c in counts.items()])  # one row
    return sums.select(F.explode(F.array(*[F.struct(F.lit(name).alias("char_class"), F.col(name).alias("n")) for name in counts])).alias("x")).select("x.*").where("n > 0")


def percentile_at(values: DataFrame, column: str, p: int) -> DataFrame:
    """One row: the value at place min(floor(n * p / 100), n - 1) of the sorted column, without interpolation.

    Values are counted, dealt by range and saved; the running count goes over the values of one range, on
    top of the sums of the ranges before it (one row a range).
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("c"))
    ranges = saved(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    sums = ranges.groupBy("part").agg(F.sum("c").alias("s"))
    every = Window.orderBy("part")
    before = sums.select("part", (F.sum("s").over(every) - F.col("s")).alias("before"), F.sum("s").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("part").orderBy("value"))
    place = F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1)
    return ranges.join(F.broadcast(before), "part").withColumn("upto", upto).where(F.col("upto") > place).agg(F.min("value").alias("value"), F.lit(p).alias("p"))


def coverage(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """source, items: how many items have evidence of a source; and n_items in all."""
    have = evidence.select("item_id", "source").distinct().groupBy("source").agg(F.count("*").alias("items"))
    return have.crossJoin(F.broadcast(items.agg(F.count("*").alias("n_items"))))


def path_profile(items: DataFrame) -> DataFrame:
    """depth (parts of relpath), n, and over the stems of that depth: mean and greatest length, distinct stems."""
    n = F.length("stem")
    return items.groupBy(F.size(F.split("relpath", "/")).alias("depth")).agg(F.count("*").alias("n"), F.round(F.avg(n), 3).alias("mean_length"), F.max(n).alias("max_length"), F.count_distinct("stem").alias("stems"))


def exif_quality(items: DataFrame, resolved: DataFrame, sure: float = 0.9) -> DataFrame:
    """One row: with an original time, with any metadata time, without, sure ones, and those that only the file system dates."""
    rows = items.select("item_id", "exif_original", "exif_digitized").join(resolved.select("item_id", "confidence", "source_summary"), "item_id", "left")
    any_ = F.coalesce("exif_original", "exif_digitized").isNotNull()
    only = (F.size("source_summary") == 1) & (F.get("source_summary", F.lit(0)) == "filesystem")
    return rows.agg(F.count_if(F.col("exif_original").isNotNull()).alias("original"), F.count_if(any_).alias("any_time"), F.count_if(~any_).alias("no_exif"), F.count_if(F.col("exif_original").isNotNull() & (F.col("confidence") >= sure)).alias("sure"), F.count_if(F.coalesce(only, F.lit(False))).alias("filesystem_only"))


def date_coverage(items: DataFrame) -> DataFrame:
    """level ('segment' or 'item'), dated, n: how many names of paths, and how many items by any of them, a light date test knows."""
    names = F.concat(F.array("stem"), F.slice(F.split("relpath", "/"), F.lit(1), F.size(F.split("relpath", "/")) - 1))
    hits = items.select(F.transform(names, has_light_date).alias("d"))
    each = F.concat(F.transform("d", lambda x: F.struct(F.lit("segment").alias("level"), x.alias("dated"))), F.array(F.struct(F.lit("item").alias("level"), F.exists("d", lambda x: x).alias("dated"))))
    return hits.select(F.explode(each).alias("x")).groupBy("x.level", "x.dated").agg(F.count("*").alias("n"))


def run_summary(items: DataFrame, resolved: DataFrame, threshold: float = 0.6) -> DataFrame:
    """One row: total, resolved, has_exif, no_exif, low_confidence, conflicts."""
    rows = items.select("item_id", "exif_original").join(resolved, "item_id", "left")
    return rows.agg(
        F.count("*").alias("total"), F.count_if(F.col("final_datetime").isNotNull()).alias("resolved"), F.count_if(F.col("exif_original").isNotNull()).alias("has_exif"), F.count_if(F.col("exif_original").isNull()).alias("no_exif"),
        F.count_if(F.coalesce(F.col("confidence") < threshold, F.lit(True))).alias("low_confidence"), F.count_if(F.coalesce(F.col("n_conflicts") > 0, F.lit(False))).alias("conflicts"),
    )


def has_light_date(text: Column) -> Column:
    out = F.lit(False)
    for r in LIGHT_DATES:
        out = out | text.rlike(r)
    return out
