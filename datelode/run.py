"""One run from a folder of files to an export folder, and its parts for other sources of items.

scan_items() lists and reads the files, date_items() finds the times, group_items() the duplicates, and run()
plans and carries out. Each table that later steps read more than once is written under work_dir or, without
one, under spark.checkpoint.dir, so a lost executor costs the step it was in. Nothing but counts, mined patterns
and the summary page (a bounded number of lines) comes to the driver.

Files that cannot be read as pictures keep their names and file-system times; hidden files and skipped
extensions are left out; extensions that are neither pictures nor videos are planned as unsupported. An
empty folder gives an empty plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datelode.functions import paths
from datelode.functions.patterns import BUILT_IN
from datelode.operators import dedup, evidence, mine, similar, timeline
from datelode.operators.components import saved
from datelode.operators.resolve import resolve
from datelode.options import Options
from datelode.plans import export, writer
from datelode.sources import logs, media
from datelode.sources.album import with_screenshot

# Videos that are taken along beside the pictures that can hold metadata.
VIDEOS = ["mp4", "mov", "avi", "mkv", "m4v", "3gp"]
PICTURES = [*evidence.METADATA_EXTENSIONS, "gif", "bmp"]
EVIDENCE = ["item_id", "ev_seq", "source", "dt", "precision", "confidence", "is_direct"]


@dataclass
class Outcome:
    """Tables of a run: items, resolved, plan and the status of each carried-out row (None for a dry run)."""

    items: DataFrame
    resolved: DataFrame
    plan: DataFrame
    status: DataFrame | None
    patterns: list[str]
    page: str


def scan_items(spark: SparkSession, options: Options) -> DataFrame:
    """One row a file: names, content hash, format, size, metadata and picture hashes, read once."""
    files = logs.scan(spark, options.input_dir, tuple(options.skip), content=True, keep=True)
    facts = media.read_media(media.hashes(files.withColumn("bytes", F.col("content"))), "bytes")
    return _named(facts)


def _named(facts: DataFrame) -> DataFrame:
    name = paths.file_name(F.col("relpath"))
    rows = facts.withColumns({"item_id": F.sha1("relpath"), "filename": name, "stem": paths.stem(name), "ext": paths.suffix(name), "has_gps": F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull(), "mtime": F.col("mtime").cast("timestamp_ntz"), "path": F.concat(F.lit("/"), "relpath")})
    rows = rows.withColumn("unsupported", ~F.col("ext").isin(PICTURES + VIDEOS)).withColumnRenamed("exif_modified", "exif_modify")
    return saved(with_screenshot(rows))


def date_items(items: DataFrame, options: Options) -> tuple[DataFrame, list[str]]:
    """resolve()'s rows for items, after names, mined patterns and the neighbours in time, and the names of the mined patterns."""
    patterns = mine.mined_patterns(items) if options.mine else []
    found = evidence.all_evidence(items, [*BUILT_IN, *patterns]).select(*EVIDENCE)
    first = saved(resolve(found))
    dated = items.select("item_id", "relpath", "stem", "mtime").join(first.select("item_id", "final_datetime", "confidence"), "item_id", "left")
    sessions = timeline.build_sessions(dated, [], options.gap_hours, options.anchor_confidence)
    between = timeline.interpolate_wide(sessions.join(dated, "item_id"), [])
    placed = between.where(F.col("dt").isNotNull()).select("item_id", F.lit(8000).alias("ev_seq"), F.lit("timeline").alias("source"), "dt", "precision", "confidence", F.lit(False).alias("is_direct"))
    return saved(resolve(found.unionByName(placed))), [p.name for p in patterns]


def group_items(items: DataFrame, resolved: DataFrame, options: Options, vectors: DataFrame | None = None) -> DataFrame:
    """Groups, ranks and review flags of items, as export.plan() reads them. Mode clip needs vectors(item_id, embedding)."""
    if options.dedup == "no":
        return items.limit(0).select("item_id", F.lit("").alias("group_id"), F.lit(0).alias("dup_rank"), F.lit("").alias("kind"), F.lit(False).alias("needs_review"))
    score = dedup.quality_score(F.col("confidence"), F.col("exif_original").isNotNull(), F.col("has_gps"), F.col("ext"), F.col("format_real"), F.col("is_screenshot"), F.lit(False))
    rows = items.where("NOT unsupported").join(resolved.select("item_id", "confidence"), "item_id", "left").withColumn("score", score)
    rows = saved(rows.select("item_id", "sha1", "h", "score", "filesize", "relpath").withColumn("id", F.xxhash64("item_id")))
    if rows.select("id").distinct().count() < rows.count():
        raise ValueError("two items have one 64-bit number")
    pairs = None
    if options.dedup == "clip":
        if vectors is None:
            raise ValueError("mode clip needs vectors")
        numbered = vectors.select(F.xxhash64("item_id").alias("id"), "embedding")
        pairs = lambda grouped: similar.cosine_pairs(numbered.join(grouped, "id", "left_anti"), options.min_cosine)
    names = rows.select("id", "item_id")
    groups = dedup.ranked(rows.drop("item_id"), options.dedup, options.hamming, pairs).join(names, "id")
    keeper = names.select(F.col("id").cast("string").alias("group_id"), F.col("item_id").alias("group_item"))  # a group is called by the item it is named after
    return groups.join(keeper, "group_id", "left").select("item_id", F.coalesce("group_item", F.lit("")).alias("group_id"), "dup_rank", "kind", "needs_review")


def run(spark: SparkSession, options: Options, vectors: DataFrame | None = None, dry: bool = False) -> Outcome:
    """Everything: scan, date, group, plan and, unless dry, export with notes, plan, status log and summary page."""
    if not dry:
        writer.check_target(options.export_dir, options.input_dir)
    items = scan_items(spark, options)
    resolved, patterns = date_items(items, options)
    dups = group_items(items, resolved, options, vectors)
    plan = saved(export.with_kept(export.plan(items, resolved, dups, options.confidence_threshold)))
    page, status = export.html_summary(plan), None
    if not dry:
        status = writer.execute(plan, options.input_dir, options.export_dir, export.notes(plan))
        logs.append_log(plan.select(F.to_json(F.struct(*plan.columns)).alias("json")), f"{options.export_dir}/run/plan")
        logs.append_log(status.withColumn("at", F.current_timestamp()), f"{options.export_dir}/run/status")
        spark.createDataFrame([(page,)], "page string").coalesce(1).write.mode("overwrite").text(f"{options.export_dir}/run/summary")
    return Outcome(items, resolved, plan, status, patterns, page)


def retry(spark: SparkSession, options: Options) -> DataFrame:
    """Carries out again what the status log of an export folder has as failed or not at all; returns the new status rows."""
    kind = "item_id string, action string, bucket string, source_relpath string, dest_relpath string"
    plan = spark.read.json(f"{options.export_dir}/run/plan").select(F.from_json("json", kind).alias("p")).select("p.*")
    log = spark.read.schema("item_id string, status string, error string, at timestamp").json(f"{options.export_dir}/run/status")
    done = export.latest(log, "item_id", "at").where("status <> 'failed'").select("item_id")
    status = writer.execute(plan.dropDuplicates(["item_id"]).join(done, "item_id", "left_anti"), options.input_dir, options.export_dir)
    logs.append_log(status.withColumn("at", F.current_timestamp()), f"{options.export_dir}/run/status")
    return status
