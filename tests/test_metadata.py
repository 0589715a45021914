"""Raw metadata fields, samples and splits."""

from datetime import datetime

from pyspark.sql import functions as F

from datelode.functions import metadata as m
from datelode.sources.sampling import sample_rows, split


def test_times(spark):
    rows = ["2019:02:13 14:30:05", "2019:02:13 14:30:05\0", " 2019-02-13 14:30:05 ", "2019:02:13", "0000:00:00 00:00:00", "", None, "2019:02:30 00:00:00", "x"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(m.parse_time(F.col("t"))).collect()]
    t = datetime(2019, 2, 13, 14, 30, 5)
    assert got == [t, t, t, datetime(2019, 2, 13), None, None, None, None, None]


def test_fields(spark):
    df = spark.createDataFrame([(30, 30, 0.0, "S", 5.0, 1, "Canon\0 ")], "d int, mi int, s double, ref string, alt double, below int, make string")
    got = df.select(m.decimal_degrees(F.col("d"), F.col("mi"), F.col("s"), F.col("ref")), m.altitude(F.col("alt"), F.col("below")), m.device(F.col("make")), m.rational(F.lit(3), F.lit(0)), m.rational(F.lit(3), F.lit(2)), m.low_confidence(F.lit(None), F.lit(0.9))).first()
    assert tuple(got) == (-30.5, -5.0, "Canon", None, 1.5, True)


def test_sampling(spark):
    df = spark.range(1000)
    a = {r.id for r in sample_rows(df, "id", 20).collect()}
    assert len(a) == 20 and a == {r.id for r in sample_rows(df.repartition(7), "id", 20).collect()}
    counts = {r.s: r["count"] for r in df.groupBy(split(F.col("id")).alias("s")).count().collect()}
    assert set(counts) == {"train", "val", "test"} and 700 < counts["train"] < 900
