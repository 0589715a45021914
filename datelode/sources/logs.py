"""Snapshots, caches and status logs: append-only JSON or Parquet tables of which the last row of a key holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from datelode.plans.export import latest
from datelode.sources.checkpoint import first_rows


def read_log(spark: SparkSession, path: str, schema: StructType | str, key: str, order: str | None = None) -> DataFrame:
    """The last row of each key of a JSON-lines folder; lines that do not parse are skipped."""
    schema = spark.createDataFrame([], schema).schema
    rows = spark.read.schema(schema.add("_corrupt_record", "string")).json(path)
    rows = rows.select("*", "_metadata.file_modification_time", "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("__line"))
    rows = rows.where(F.col("_corrupt_record").isNull() & F.col(key).isNotNull()).drop("_corrupt_record")
    place = F.col(order) if order else F.struct("file_modification_time", "file_name", "file_block_start", "__line")
    return latest(rows.withColumn("__at", place).drop("file_modification_time", "file_name", "file_block_start", "__line"), key, "__at").drop("__at")


def write_snapshot(items: DataFrame, path: str, key: str = "item_id", order: str | None = None) -> None:
    """One row a key, as JSON lines: the first by order, or by place in items; rows without a key are left out."""
    place = order or "__line"
    rows = items if order else items.withColumn(place, F.monotonically_increasing_id())
    first = first_rows(rows, key, place)
    (first if order else first.drop(place)).write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def cached_and_new(files: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Files that the cache knows by all keys, and those that must be read."""
    return files.join(cache.select(*keys).distinct(), keys, "left_semi"), files.join(cache.select(*keys).distinct(), keys, "left_anti")


def scan(spark: SparkSession, root: str, skip: tuple[str, ...] = (), content: bool = False, keep: bool = False) -> DataFrame:
    """Files below root, hidden ones and skipped extensions left out: path, relpath, filesize, mtime, with content also sha1, with keep also content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1] + "/"
    at = F.instr("path", base)
    more = [*([F.sha1("content").alias("sha1")] if content else []), *(["content"] if keep else [])]
    rows = files.where(at > 0).select("path", F.substring("path", at + F.lit(len(base)), F.length("path")).alias("relpath"), F.col("length").alias("filesize"), F.col("modificationTime").alias("mtime"), *more)
    ext = F.lower(F.regexp_extract("relpath", r"[^/]\.([^./]*)$", 1))
    return rows.where(~F.concat(F.lit("/"), "relpath").rlike(r"/\.") & ~ext.isin(list(skip)) if skip else ~F.concat(F.lit("/"), "relpath").rlike(r"/\."))


def first_photo(entries: DataFrame) -> DataFrame:
    """archive, name: of entries(archive, name) the photo by type heic, heif, jpg, jpeg, png; entries under __ are none."""
    ext = F.lower(F.regexp_extract("name", r"\.([^./]*)$", 1))
    rank = F.array_position(F.array(*map(F.lit, ("heic", "heif", "jpg", "jpeg", "png"))), ext)
    return entries.where((rank > 0) & ~F.col("name").startswith("__")).groupBy("archive").agg(F.min_by("name", F.struct(rank, F.col("name"))).alias("name"))
