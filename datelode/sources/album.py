"""A media album derived from the events table: names, folders, metadata and file facts by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datelode.functions import paths

#: Expressions that read the same in any SQL engine with lpad, extract and ||.
PART = {"y": ("year", 4), "mo": ("month", 2), "d": ("day", 2), "h": ("hour", 2), "mi": ("minute", 2), "s": ("second", 2)}
NAME = """CASE event_id % 8
  WHEN 0 THEN 'IMG_' || y || mo || d || '_' || h || mi || s || '.jpg'
  WHEN 1 THEN y || '-' || mo || '-' || d || ' ' || h || '.' || mi || '.' || s || '.png'
  WHEN 2 THEN 'WeiXin_' || y || mo || d || '.jpg'
  WHEN 3 THEN '照片_' || y || '年' || mo || '月' || d || '日.jpg'
  WHEN 4 THEN 'Screenshot_' || y || '_' || mo || d || '_' || h || mi || s || '.png'
  WHEN 5 THEN 'IMG_' || CAST(event_id AS STRING) || '.jpg'
  WHEN 6 THEN 'album ' || y || mo || '.heic'
  ELSE 'clip_' || CAST(event_id AS STRING) || '.mp4' END"""
FOLDER = """CASE event_id % 4 WHEN 0 THEN y || '-' || mo WHEN 1 THEN mo || d WHEN 2 THEN event_type ELSE y || '年' END"""
FACTS = {
    "sha1": "CASE WHEN event_id % 10 = 0 THEN sha1('c' || CAST(event_id - event_id % 50 AS STRING)) WHEN event_id % 101 = 1 THEN '' ELSE sha1('e' || CAST(event_id AS STRING)) END",
    "filesize": "1000 + (event_id * 37) % 5000",
    "width": "CASE WHEN event_id % 5 = 0 THEN 1170 WHEN event_id % 7 = 0 THEN 3000 ELSE 4000 END",
    "height": "CASE WHEN event_id % 5 = 0 THEN 2532 WHEN event_id % 7 = 0 THEN 1000 ELSE 3000 END",
    "has_gps": "event_id % 6 = 0",
    "unsupported": "event_id % 97 = 0",
    "exif_original": "CASE WHEN event_type IN ('click', 'view') AND event_id % 8 <> 7 THEN CASE WHEN event_id % 11 = 0 THEN ts + INTERVAL '45' DAY ELSE ts END END",
    "exif_digitized": "CASE WHEN event_type = 'click' AND event_id % 8 <> 7 THEN ts + INTERVAL '1' SECOND END",
    "mtime": "ts + INTERVAL '400' DAY",
}
FORMAT = "CASE WHEN event_id % 104 = 0 THEN 'PNG' WHEN event_id % 104 = 8 THEN 'MPO' WHEN ext = 'jpg' THEN 'JPEG' WHEN ext = 'png' THEN 'PNG' WHEN ext = 'heic' THEN 'HEIF' ELSE '' END"


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, where its files make fewer; larger tables are left as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def album(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a file; item_id is a SHA-1 of path and event, so it is stable across runs."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts")
    rows = spread(events).selectExpr("event_id", "user_id", "event_type", "ts", *[f"lpad(CAST(CAST(extract({unit} FROM ts) AS INT) AS STRING), {n}, '0') AS {name}" for name, (unit, n) in PART.items()])
    rows = rows.withColumns({"filename": F.expr(NAME), "folder_name": F.expr(FOLDER), **{k: F.expr(v) for k, v in FACTS.items()}})
    rows = rows.withColumn("relpath", F.expr("'u' || CAST(user_id AS STRING) || '/' || folder_name || '/' || filename"))
    rows = rows.withColumns({"path": F.concat(F.lit("/album/"), "relpath"), "item_id": F.expr("sha1(relpath || ':' || CAST(event_id AS STRING))"), "stem": paths.stem(F.col("filename")), "ext": paths.suffix(F.col("filename"))})
    return rows.withColumn("format_real", F.expr(FORMAT)).select("item_id", "event_id", "user_id", "path", "relpath", "filename", "stem", "ext", "width", "height", "format_real", "has_gps", "unsupported", "exif_original", "exif_digitized", "mtime", "sha1", F.col("filesize").cast("long").alias("filesize"))


# Known screen sizes (either way up) and the ratio beyond which a picture is taken for a screenshot.
SCREENS = [(750, 1334), (1080, 1920), (1170, 2532), (1284, 2778), (1440, 3088), (1080, 2340), (2560, 1440), (1920, 1080), (2560, 1600), (2880, 1800), (3024, 1964)]
SCREEN_RATIO = 2.2


def with_screenshot(items: DataFrame) -> DataFrame:
    """Adds is_screenshot."""
    low, high = F.least("width", "height"), F.greatest("width", "height")
    known = F.lit(False)
    for w, h in SCREENS:
        known = known | ((low == min(w, h)) & (high == max(w, h)))
    return items.withColumn("is_screenshot", F.coalesce((low > 0) & (known | (high / low > SCREEN_RATIO)), F.lit(False)))
