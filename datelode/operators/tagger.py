"""What a character tagger's output becomes: ids in, spans to dates, evidence, and its errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = 1
FIELDS = ["YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND"]
# Discount of tagged evidence, of folders and their depth, least and largest confidence.
DISCOUNT, FOLDER_DISCOUNT, DEPTH_DECAY, LEAST, MOST = 0.95, 0.85, [1.0, 0.85, 0.7], 0.30, 0.82


def encode(texts: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """texts with ids: the number of each character in vocabulary(char, id), UNKNOWN for others.

    The vocabulary is an alphabet, one map broadcast as one row; its size is bounded by Unicode.
    """
    table = vocabulary.agg(F.map_from_entries(F.collect_list(F.struct("char", "id"))).alias("__ids"))
    chars = F.filter(F.split(F.coalesce(F.col(column), F.lit("")), ""), lambda c: c != "")
    return texts.crossJoin(F.broadcast(table)).withColumn("ids", F.transform(chars, lambda c: F.coalesce(F.try_element_at("__ids", c), F.lit(UNKNOWN)))).drop("__ids")


def softmax(logits: Column) -> Column:
    """Shares of an array of logits, shifted by the largest so that nothing overflows."""
    top = F.array_max(logits)
    parts = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(parts, lambda x: x / total)


def argmax(values: Column) -> Column:
    """Place (from 0) of the largest value, the first of equal ones."""
    return F.array_position(values, F.array_max(values)) - 1


def dates(spans: DataFrame) -> DataFrame:
    """One candidate a text for spans(id, field, value, confidence, clf): id, fields (map), precision, dt, confidence.

    Of equal fields the most certain one holds; dt is null if the fields are no date; confidence is the
    classifier's times the mean of the fields'.
    """
    best = spans.groupBy("id", "field").agg(F.max_by("value", "confidence").alias("value"), F.max("confidence").alias("confidence"), F.max("clf").alias("clf"))
    one = best.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"), F.avg("confidence").alias("mean"), F.max("clf").alias("clf"))
    value = lambda f, low: F.coalesce(F.try_element_at("fields", F.lit(f)).try_cast("int"), F.lit(low))
    y = value("YEAR", 0)
    dt = F.try_make_timestamp_ntz(y, value("MONTH", 1), value("DAY", 1), value("HOUR", 0), value("MINUTE", 0), value("SECOND", 0).cast("decimal(16,6)"))
    precision = F.lit(None).cast("string")
    for f in FIELDS:
        precision = F.when(F.map_contains_key("fields", F.lit(f)), F.lit(f.lower())).otherwise(precision)
    return one.select("id", "fields", precision.alias("precision"), F.when(y.between(1900, 2100), dt).alias("dt"), F.round(F.col("clf") * F.col("mean"), 4).alias("confidence"))


def evidence(candidates: DataFrame) -> DataFrame:
    """Evidence from candidates(id, precision, dt, confidence, source, depth): source 'stem' or 'folder' (depth from 0, the nearest)."""
    folder = F.col("source") == "folder"
    decay = F.get(F.array(*map(F.lit, DEPTH_DECAY)), F.least("depth", F.lit(2)))
    raw = F.when(folder, F.col("confidence") * FOLDER_DISCOUNT * decay).otherwise(F.col("confidence"))
    confidence = F.least(raw * DISCOUNT, F.lit(MOST))
    capped = F.when(folder & F.col("precision").isin("hour", "minute", "second"), F.lit("day")).otherwise(F.col("precision"))
    kept = candidates.withColumn("c", confidence).where(F.col("c") >= LEAST)
    return kept.select(F.col("id").alias("item_id"), F.when(folder, F.lit("foldername")).otherwise(F.lit("filename")).alias("source"), "dt", capped.alias("precision"), F.round("c", 3).alias("confidence"), (~folder).alias("is_direct"))


def error_types(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """id, types: for texts whose spans(id, field, begin, end) differ, what is too much and what is missing, by field.

    A text's spans are gathered in its row (bounded by the text); clf_FP and clf_FN: spans where none are, or none where some are.
    """
    span = F.struct("begin", "end", "field")
    p, g = predicted.groupBy("id").agg(F.collect_set(span).alias("p")), gold.groupBy("id").agg(F.collect_set(span).alias("g"))
    both = p.join(g, "id", "full_outer")
    none = F.array().cast("array<struct<begin:int,end:int,field:string>>")
    p_, g_ = F.coalesce("p", none), F.coalesce("g", none)
    names = lambda a, b: F.array_join(F.array_sort(F.transform(F.array_except(a, b), lambda s: s["field"])), ",")
    extra, missed = names(p_, g_), names(g_, p_)
    types = F.array(F.when(F.size(g_) == 0, F.lit("clf_FP")).when(F.size(p_) == 0, F.lit("clf_FN")), F.when(extra != "", F.concat(F.lit("ner_FP:"), extra)), F.when(missed != "", F.concat(F.lit("ner_FN:"), missed)))
    return both.select("id", F.array_compact(types).alias("types")).where(F.size("types") > 0)


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.select(F.explode("types").alias("type")).groupBy("type").agg(F.count("*").alias("n"))
