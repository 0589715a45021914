"""Tagger data: BIO labels of date fields in names, their decoding, metrics, vocabulary and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELD_WIDTH = {"DATETIME14": [("YEAR", 0, 4), ("MONTH", 4, 2), ("DAY", 6, 2), ("HOUR", 8, 2), ("MINUTE", 10, 2), ("SECOND", 12, 2)], "DATETIME8_6": [("YEAR", 0, 4), ("MONTH", 4, 2), ("DAY", 6, 2), ("HOUR", 9, 2), ("MINUTE", 11, 2), ("SECOND", 13, 2)], "DATE8": [("YEAR", 0, 4), ("MONTH", 4, 2), ("DAY", 6, 2)], "YEAR4": [("YEAR", 0, 4)]}


def _template(fields: list[tuple[str, int, int]]) -> list[str]:
    """The labels of a pattern's own characters."""
    out = ["O"] * max(offset + width for _, offset, width in fields)
    for field, offset, width in fields:
        out[offset : offset + width] = ["B-" + field, *["I-" + field] * (width - 1)]
    return out


def bio_labels(text: Column, pattern: Column, start: Column) -> Column:
    """One label a character: B-/I- of the fields of the pattern that starts at start (0-based), O elsewhere.

    The labels of a pattern are fixed, so they are laid between O's as a whole instead of being asked for one by one.
    """
    own = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, fields in FIELD_WIDTH.items():
        own = own.when(pattern == name, F.array(*map(F.lit, _template(fields))))
    own = F.when(start.isNotNull(), own).otherwise(F.lit(None))
    own = F.coalesce(own, F.array().cast("array<string>"))
    at, n = F.greatest(F.coalesce(start, F.lit(0)), F.lit(0)).cast("int"), F.length(text)
    cut = F.greatest(-F.coalesce(start, F.lit(0)), F.lit(0)).cast("int")  # what stands before the text
    outside = lambda k: F.array_repeat(F.lit("O"), k)
    every = F.concat(outside(F.least(at, n)), F.slice(own, cut + 1, F.size(own)), outside(n))
    return F.slice(every, F.lit(1), n)


def span_array(labels: Column) -> Column:
    """Spans (field, begin, end behind) of one label array: a B, an O or another field ends a span; a stray I opens one.

    Borders are the places where a span begins or an O stands, and the end; a span reaches to the next border.
    """
    label = lambda k: F.get(labels, k)
    field = lambda k: F.when(label(k) != "O", F.substring_index(label(k), "-", -1))
    border = lambda k: field(k).isNull() | label(k).startswith("B-") | ~field(k).eqNullSafe(field(k - 1))
    borders = F.filter(F.sequence(F.lit(0), F.size(labels)), border)  # the place behind the last label has no field
    found = F.transform(borders, lambda k, i: F.struct(field(k).alias("field"), k.alias("begin"), F.get(borders, i + 1).alias("end")))
    return F.filter(found, lambda x: x["field"].isNotNull())


def spans(labels: DataFrame) -> DataFrame:
    """id, field, begin, end for labels(id, labels); found inside each row, nothing is shuffled."""
    return labels.select("id", F.explode(span_array(F.col("labels"))).alias("s")).select("id", "s.field", "s.begin", "s.end")


def span_metrics(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """field, tp, fp, fn, precision, recall, f1 of equal spans."""
    p, g = predicted.select("id", "field", "begin", "end", F.lit(1).alias("p")), gold.select("id", "field", "begin", "end", F.lit(1).alias("g"))
    both = p.join(g, ["id", "field", "begin", "end"], "full_outer")
    counts = both.groupBy("field").agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    precision, recall = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return counts.withColumns({"precision": precision, "recall": recall}).withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9)))


def overall_scores(predicted: DataFrame, gold: DataFrame, texts: DataFrame) -> DataFrame:
    """One row over all fields and texts(id): micro precision, recall and f1 of spans, and whether a text has any: clf_tp, clf_fp, clf_fn, clf_tn."""
    spans = span_metrics(predicted, gold).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    p, g = (df.select("id").distinct().withColumn(name, F.lit(True)) for df, name in ((predicted, "p"), (gold, "g")))
    said, true = F.coalesce("p", F.lit(False)), F.coalesce("g", F.lit(False))
    clf = texts.select("id").join(p, "id", "left").join(g, "id", "left").agg(F.count_if(said & true).alias("clf_tp"), F.count_if(said & ~true).alias("clf_fp"), F.count_if(~said & true).alias("clf_fn"), F.count_if(~said & ~true).alias("clf_tn"))
    precision, recall = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    rows = spans.crossJoin(F.broadcast(clf)).withColumns({"precision": precision, "recall": recall})  # one row each
    return rows.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9)))


def vocabulary(texts: DataFrame, column: str, special: int = 2, min_freq: int = 1, min_freq_han: int | None = None) -> DataFrame:
    """char, n, id: dense ids behind the special ones, most frequent first, ties by character; Han characters may have a bound of their own."""
    counts = texts.select(F.explode(F.split(column, "")).alias("char")).where("char <> ''").groupBy("char").agg(F.count("*").alias("n"))
    least = F.when(F.col("char").rlike(r"^\p{IsHan}"), F.lit(min_freq if min_freq_han is None else min_freq_han)).otherwise(F.lit(min_freq))
    counts = counts.where(F.col("n") >= least)
    return counts.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "char")) + special - 1)  # the alphabet, not the corpus


def label_weights(labels: DataFrame, low: float = 1.0, high: float = 5.0) -> DataFrame:
    """label, n, weight: total / (labels * n), clipped; O weighs 1."""
    counts = labels.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    raw = F.col("total") / (F.col("k") * F.col("n"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", F.when(F.col("label") == "O", F.lit(low)).otherwise(F.round(F.greatest(F.lit(low), F.least(F.lit(high), raw)), 6)).alias("weight"))


def exact_dates(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: total texts whose gold spans(id, field, begin, end) have a year, a month and a day, correct ones whose predicted spans of these fields are just those, accuracy."""
    day = F.col("field").isin("YEAR", "MONTH", "DAY")
    sets = lambda df: df.where(day).groupBy("id").agg(F.array_sort(F.collect_set(F.struct("field", "begin", "end"))).alias("s"), F.count_distinct("field").alias("fields"))
    whole = sets(gold).where("fields = 3").select("id", F.col("s").alias("g"))
    both = whole.join(sets(predicted).select("id", "s"), "id", "left")
    counts = both.agg(F.count("*").alias("total"), F.count_if(F.col("g").eqNullSafe(F.col("s"))).alias("correct"))
    return counts.withColumn("accuracy", F.round(F.col("correct") / F.greatest("total", F.lit(1)), 4))
