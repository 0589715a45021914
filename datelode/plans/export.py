"""Export plan: bucket and action of each file, notes, counts and the status log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Formats that each extension may hold, and the extension of each format.
FORMATS = {"jpg": ["JPEG", "MPO"], "jpeg": ["JPEG", "MPO"], "png": ["PNG"], "heic": ["HEIF"], "heif": ["HEIF"], "tiff": ["TIFF"], "tif": ["TIFF"], "webp": ["WEBP"], "gif": ["GIF"], "bmp": ["BMP"]}
EXTENSION = {"JPEG": "jpg", "PNG": "png", "HEIF": "heic", "TIFF": "tiff", "WEBP": "webp", "GIF": "gif", "BMP": "bmp"}
KINDS = {"sha1": "byte-identical (sha1)", "phash": "visually identical (phash)", "clip": "visually similar (clip)"}
THRESHOLD = 0.6


def _case(value: Column, table: dict, otherwise: Column) -> Column:
    out = F.when(F.lit(False), otherwise)
    for k, v in table.items():
        out = out.when(value == k, F.lit(v))
    return out.otherwise(otherwise)


def format_mismatch(ext: Column, real: Column) -> Column:
    """Whether the content's format is one that the extension does not stand for (unknown ones fit)."""
    out = F.lit(False)
    for e, allowed in FORMATS.items():
        out = out | ((ext == e) & ~real.isin(allowed))
    return out & (F.coalesce(real, F.lit("")) != "")


def plan(items: DataFrame, resolved: DataFrame, dups: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One action row for each item.

    items: item_id, relpath, ext, format_real, unsupported; resolved: as resolve() gives it; dups:
    item_id, group_id, dup_rank, kind, needs_review. Joins are on item_id alone.
    """
    rows = items.select("item_id", "relpath", "ext", "format_real", "unsupported").join(resolved, "item_id", "left").join(dups, "item_id", "left")
    real = F.upper(F.coalesce("format_real", F.lit("")))
    convert = format_mismatch(F.col("ext"), real)
    target = F.when(convert, _case(real, EXTENSION, F.col("ext"))).otherwise(F.col("ext"))
    unsupported = F.col("unsupported") | (F.col("ext") == "livp")
    duplicate = F.coalesce(F.col("dup_rank") > 0, F.lit(False))
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("final_datetime").isNull(), F.lit("time unresolved")).when(F.col("confidence") < threshold, F.concat(F.lit("low confidence ("), F.format_number("confidence", 2), F.lit(f" < {threshold})"))),
        F.when(F.col("n_conflicts") > 0, F.lit("time conflict detected")),
        F.when(F.coalesce(F.col("needs_review"), F.lit(False)), F.lit("visually similar to another photo")),
        F.when(convert, F.concat(F.lit("format mismatch: ."), "ext", F.lit(" but actually "), real)),
    )
    dest = F.when(target != F.col("ext"), F.concat(F.regexp_replace("relpath", r"\.[^./]*$", "."), target)).otherwise(F.col("relpath"))
    kind = _case(F.col("kind"), KINDS, F.coalesce("kind", F.lit("unknown")))
    return rows.select(
        "item_id",
        F.col("relpath").alias("source_relpath"),
        F.when(unsupported, F.lit("skip_unsupported")).when(duplicate, F.lit("duplicate")).when(convert, F.lit("convert")).otherwise(F.lit("copy")).alias("action"),
        F.when(unsupported, F.lit("unsupported")).when(duplicate, F.lit("duplicate")).when(reasons != "", F.lit("review")).otherwise(F.lit("confident")).alias("bucket"),
        F.when(unsupported, F.concat(F.lit("unsupported format: ."), "ext"))
        .when(duplicate, F.concat(kind, F.lit(" duplicate (group="), F.substring("group_id", 1, 8), F.lit("…, rank="), F.col("dup_rank").cast("string"), F.lit(")")))
        .when(reasons != "", reasons)
        .otherwise(F.lit("ok"))
        .alias("reason"),
        F.when(unsupported | duplicate, F.col("relpath")).otherwise(dest).alias("dest_relpath"),
        F.col("ext").alias("source_ext"),
        F.when(unsupported | duplicate, F.col("ext")).otherwise(target).alias("target_ext"),
        "final_datetime",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("primary_source", F.lit("")).alias("primary_source"),
        F.coalesce("group_id", F.lit("")).alias("duplicate_group_id"),
        F.coalesce("dup_rank", F.lit(0)).alias("duplicate_rank"),
        F.coalesce("kind", F.lit("")).alias("duplicate_kind"),
    )


def with_kept(actions: DataFrame) -> DataFrame:
    """Adds duplicate_kept_relpath: the path of rank 0 of the same group.

    Rows without a group are joined by a key of their own, which nothing has: they are most of the table and
    would meet in one task under the empty group.
    """
    kept = actions.where("duplicate_group_id <> '' AND duplicate_rank = 0").select(F.concat(F.lit("g"), "duplicate_group_id").alias("__key"), F.col("source_relpath").alias("duplicate_kept_relpath"))
    key = F.when(F.col("duplicate_group_id") == "", F.concat(F.lit("i"), F.col("item_id").cast("string"))).otherwise(F.concat(F.lit("g"), "duplicate_group_id"))
    return actions.withColumn("__key", key).join(kept, "__key", "left").drop("__key")


def bucket_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("bucket").agg(F.count("*").alias("n"))


def notes(actions: DataFrame) -> DataFrame:
    """item_id and the text of the note that lies beside a reviewed or duplicate file."""
    line = F.lit("─" * 40)
    about_group = F.when(F.col("duplicate_group_id") != "", F.concat_ws("\n", F.lit(""), F.lit("duplicate info:"), F.concat(F.lit("  group  : "), "duplicate_group_id"), F.concat(F.lit("  rank   : "), F.col("duplicate_rank").cast("string")), F.concat(F.lit("  kind   : "), "duplicate_kind")))
    review = F.concat_ws(
        "\n", F.lit("review note"), line, F.concat(F.lit("file      : "), "source_relpath"), F.concat(F.lit("reason    : "), "reason"), F.lit(""), F.lit("resolved time:"),
        F.concat(F.lit("  datetime : "), F.coalesce(F.col("final_datetime").cast("string"), F.lit("unknown"))), F.concat(F.lit("  confidence: "), F.format_number("confidence", 2)),
        F.concat(F.lit("  source   : "), F.when(F.col("primary_source") == "", F.lit("-")).otherwise(F.col("primary_source"))), about_group,
    )
    duplicate = F.concat_ws(
        "\n", F.lit("duplicate file"), line, F.lit("This file is a duplicate and was not selected for export."), F.lit(""), F.concat(F.lit("file     : "), "source_relpath"),
        F.concat(F.lit("kept as  : "), F.coalesce("duplicate_kept_relpath", F.lit("(unknown)"))), F.concat(F.lit("kind     : "), "duplicate_kind"), F.concat(F.lit("group    : "), "duplicate_group_id"), F.concat(F.lit("rank     : "), F.col("duplicate_rank").cast("string")), F.lit(""), F.lit("You can safely delete this file."),
    )
    return actions.where("bucket IN ('review', 'duplicate')").select("item_id", "bucket", F.concat(F.when(F.col("bucket") == "review", review).otherwise(duplicate), F.lit("\n")).alias("note"))


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key of an append-only log: a partial aggregate, no window over hot keys."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, *[f"r.{c}" for c in rest])


def html_summary(actions: DataFrame, rows: int = 50) -> str:
    """A report page: the counts of all buckets, at most rows lines of each, and the largest duplicate groups with the file that is kept."""
    from html import escape

    counts = {r.bucket: r.n for r in bucket_counts(actions).collect()}
    out = ["<!DOCTYPE html><html><head><meta charset='utf-8'><title>Export plan</title></head><body><h1>Export plan</h1><table>"]
    out += [f"<tr><th>{b}</th><td>{counts.get(b, 0)}</td></tr>" for b in ("confident", "review", "duplicate", "unsupported")]
    out.append(f"<tr><th>total</th><td>{sum(counts.values())}</td></tr></table>")
    groups = actions.where("duplicate_group_id <> ''").groupBy("duplicate_group_id").agg(F.count("*").alias("n"), F.min_by("source_relpath", "duplicate_rank").alias("kept")).orderBy(F.desc("n"), "duplicate_group_id").limit(rows)
    out.append("<h2>duplicate groups</h2><ul>")
    out += [f"<li>{escape(r.kept)}: {r.n} files</li>" for r in groups.collect()]
    out.append("</ul>")
    for b in ("confident", "review", "duplicate", "unsupported"):
        out.append(f"<h2>{b}</h2><ul>")
        out += [f"<li>{escape(r.source_relpath)}: {escape(r.reason)}</li>" for r in actions.where(F.col("bucket") == b).orderBy("source_relpath").limit(rows).collect()]
        out.append("</ul>")
    return "".join([*out, "</body></html>"])
