"""Fixtures for patterns, resolution, sessions, disambiguation, interpolation, duplicates and logs."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from datelode.functions import paths
from datelode.functions.patterns import match_all
from datelode.operators import dedup, similar, timeline
from datelode.operators.components import components
from datelode.operators.resolve import resolve
from datelode.plans import export
from datelode.sources import logs

BASE = datetime(2019, 2, 13, 10)


@pytest.mark.parametrize("text,want", [
    ("IMG_20200101_143022", ["DATETIME8_6", "DATE8"]), ("IMG_20200101143022", ["DATETIME14"]), ("IMG_20200101_1430", ["DATETIME12", "DATE8"]), ("2023-12-05 08-30-11", ["DATETIME_SEP", "DATE_SEP", "YEAR4"]),
    ("WeiXin_20190821", ["DATE8"]), ("照片_2019年8月21日", ["DATE_CN", "YEARMONTH_CN", "YEAR_CN", "YEAR4"]), ("album_202001", ["YEARMONTH6"]), ("Screenshot_2019_0723_152344", ["YEAR4"]), ("20190230", []), ("", []),
])
def test_patterns(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(F.transform(match_all(F.col("t")), lambda x: x["pattern_name"]).alias("n")).first().n
    assert got == want


EV = "item_id string, ev_seq int, source string, dt timestamp_ntz, precision string, confidence double, is_direct boolean"


def test_resolver(spark):
    d = lambda m, day=1: datetime(2019, m, day)
    rows = [
        ("a", 0, "exif", datetime(2019, 2, 13, 14, 30), "second", 1.0, True), ("a", 100, "filename", d(5), "second", 0.9, True),
        ("b", 0, "exif", d(2, 13), "second", 1.0, True), ("b", 1, "exif", d(3, 30), "second", 0.6, True),
        ("c", 100, "filename", d(1), "year", 0.3, True), ("c", 1000, "foldername", d(2), "day", 0.6, False),
        ("d", 3, "filesystem", datetime(2024, 1, 1), "second", 0.2, False), ("d", 100, "filename", d(1), "day", 0.75, True),
        ("e", 101, "filename", d(6), "second", 0.9, True), ("e", 100, "filename", d(7), "second", 0.9, True), ("f", 0, "exif", None, "second", 1.0, True),
        ("g", 0, "x", d(2, 10), "month", 0.5, True),
    ]
    got = {r.item_id: r for r in resolve(spark.createDataFrame(rows, EV)).collect()}
    assert got["a"].primary_source == "exif" and got["a"].n_conflicts == 1
    assert got["b"].n_conflicts == 0 and got["c"].primary_source == "filename" and got["d"].n_conflicts == 0
    assert got["e"].final_datetime == d(7) and "f" not in got
    assert (got["g"].range_start, got["g"].range_end) == (d(2), datetime(2019, 2, 28, 23, 59, 59, 999999))


def items(spark, rows):
    """rows: (id, folder, hours or None, confidence)"""
    data = [(i, 1, f"{f}/{i}.jpg", i, None if h is None else BASE + timedelta(hours=h), c, BASE) for i, f, h, c in rows]
    return spark.createDataFrame(data, "item_id string, user_id int, relpath string, stem string, final_datetime timestamp_ntz, confidence double, mtime timestamp_ntz")


def test_sessions(spark):
    got = timeline.build_sessions(items(spark, [(f"a{h}", "x", h, 1.0) for h in (0, 1, 2, 10, 11)]), ["user_id"]).groupBy("session_idx").count().collect()
    assert {r.session_idx: r["count"] for r in got} == {0: 3, 1: 2}
    got = timeline.build_sessions(items(spark, [("a", "x", 0, 1.0), ("b", "x", 6, 1.0)]), ["user_id"])  # a gap of exactly 6 h does not split
    assert got.select("session_idx").distinct().count() == 1
    got = timeline.build_sessions(items(spark, [("a", "t/c", 0, 1.0), ("b", "t/q", 12, 1.0), ("f", "t/c", None, None), ("g", "t/q", None, None), ("h", "w", None, None)]), ["user_id"])
    assert {r.item_id: r.session_idx for r in got.collect()} == {"a": 0, "b": 1, "f": 0, "g": 1, "h": 0}
    assert {r.session_idx for r in timeline.build_sessions(items(spark, [("f", "x", None, None), ("g", "y", 1, 0.4)]), ["user_id"]).collect()} == {0}


def interpolated(spark, rows):
    members = items(spark, rows).withColumn("session_idx", F.lit(0)).withColumn("is_anchor", F.coalesce(F.col("confidence") >= 0.6, F.lit(False)))
    return {r.item_id: r for r in timeline.interpolate(members, ["user_id"]).collect()}


def test_interpolation(spark):
    got = interpolated(spark, [("IMG_001", "x", 0, 1.0), ("IMG_005", "x", None, None), ("IMG_010", "x", 2, 1.0)])["IMG_005"]
    assert (got.dt, got.precision, got.confidence) == (BASE + timedelta(hours=1), "minute", 0.8)
    got = interpolated(spark, [("IMG_005", "x", 1, 1.0), ("IMG_003", "x", None, None)])["IMG_003"]
    assert (got.precision, got.confidence) == ("day", 0.6)
    assert interpolated(spark, [("IMG_1", "x", None, None)]) == {}
    got = interpolated(spark, [("IMG_1", "x", 2, 1.0), ("IMG_2", "x", None, None), ("IMG_3", "x", 0, 1.0)])["IMG_2"]  # times run backwards
    assert BASE <= got.dt <= BASE + timedelta(hours=2)


@pytest.mark.parametrize("dates,years,ends,anchors,depth,want", [
    (["2013-02-01", "2019-02-13"], [2019], None, 1, 0, ("2019-02-13", "day", 0.65)), (["2000-09-01", "2009-01-01"], [2019], None, 1, 0, ("2019-09-01", "day", 0.65)),
    (["2019-02-01", "2019-09-01"], [2019], "2019-02-13", 1, 0, ("2019-02-01", "month", 0.65)), (["2019-02-13", "2019-09-01"], [2019], None, 0, 0, ("2019-01-01", "year", 0.30)),
    (["2000-02-13", "2002-01-03"], [], None, 0, 0, None), (["2000-05-01", "2005-01-01"], [2019], None, 0, 2, ("2019-05-01", "day", 0.40)),
])
def test_disambiguation(spark, dates, years, ends, anchors, depth, want):
    row = [("0901", depth, [datetime.fromisoformat(d) for d in dates], years, ends and datetime.fromisoformat(ends), ends and datetime.fromisoformat(ends), anchors)]
    df = spark.createDataFrame(row, "folder_text string, depth int, candidates array<timestamp_ntz>, year_candidates array<int>, time_start timestamp_ntz, time_end timestamp_ntz, n_anchors int")
    got = [(str(r.dt.date()), r.precision, r.struct_confidence) for r in timeline.disambiguate(df).collect()]
    assert got == ([want] if want else [])


@pytest.mark.parametrize("text,want", [("0213", ["2000-02-13"]), ("0901", ["2000-09-01", "2009-01-01"]), ("190213", ["2019-02-13"]), ("20190213", []), ("2019", ["2019-01-01"]), ("02_13", ["2000-02-13"]), ("x", [])])
def test_digit_candidates(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(timeline.digit_candidates(F.col("t")).alias("c")).first().c
    assert [str(d.date()) for d in got] == want


def test_paths(spark):
    df = spark.createDataFrame([("a/b/.bashrc",), ("IMG_12x034y.tar.gz",), ("",)], "p string")
    got = df.select(paths.folder(F.col("p")), paths.stem(paths.file_name(F.col("p"))), paths.suffix(paths.file_name(F.col("p"))), paths.tail_number(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("a/b", ".bashrc", "", 0), (".", "IMG_12x034y.tar", "gz", 34), (".", "", "", 0)]


def test_hamming_and_components(spark):
    df = spark.createDataFrame([(1, 0), (2, 0b111), (3, 0b1111111), (4, -1), (5, 0)], "id long, h long")
    assert {(r.id_a, r.id_b, r.distance) for r in dedup.hamming_pairs(df, 4).collect()} == {(1, 2, 3), (2, 3, 4), (1, 5, 0), (2, 5, 3)}
    assert {r.id: r.group_id for r in dedup.near_groups(df, 4).collect()} == {1: 1, 2: 1, 3: 1, 5: 1}
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.root) for r in components(chain).collect()} == {(k, 0) for k in range(61)} | {(100, 100), (101, 100)}
    assert components(chain.limit(0)).count() == 0


def test_lending(spark):
    near = spark.createDataFrame([(1, 2, 0.99, 1), (3, 2, 0.86, 1), (2, 1, 0.99, 1)], "query_id long, vec_id long, score double, rk int")
    known = spark.createDataFrame([(1, None, None), (2, BASE, 0.6), (3, BASE, 0.5)], "item_id long, final_datetime timestamp_ntz, confidence double")
    assert {(r.item_id, r.related_id, r.confidence) for r in similar.lend(near, known).collect()} == {(1, 2, 0.75), (3, 2, 0.45)}


def test_cells_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    queries = v.where("id % 100 = 0")
    top = lambda probes: {(r.query_id, r.vec_id) for r in similar.nearest(queries, v, 5, 0.0, probes).collect()}
    exact, cells = top(None), top(30)
    assert len(exact) == 5 * queries.count() and len(exact & cells) >= 0.9 * len(exact)
    assert similar.nearest(queries, v.limit(0), 5, 0.0, 4).count() == 0 and top(45) == exact


def test_plan(spark):
    items_ = spark.createDataFrame([("u", "a.xyz", "xyz", "", True), ("j", "b/j.jpg", "jpg", "PNG", False), ("m", "m.jpg", "jpg", "MPO", False), ("v", "v.mp4", "mp4", "", False)], "item_id string, relpath string, ext string, format_real string, unsupported boolean")
    res = spark.createDataFrame([("j", BASE, 1.0, "exif", 0), ("m", BASE, 0.5, "exif", 1)], "item_id string, final_datetime timestamp_ntz, confidence double, primary_source string, n_conflicts long")
    dups = spark.createDataFrame([], "item_id string, group_id string, dup_rank int, kind string, needs_review boolean")
    got = {r.item_id: r for r in export.plan(items_, res, dups).collect()}
    assert (got["u"].action, got["u"].bucket) == ("skip_unsupported", "unsupported")
    assert (got["j"].action, got["j"].dest_relpath, got["j"].reason) == ("convert", "b/j.png", "format mismatch: .jpg but actually PNG")
    assert got["m"].reason == "low confidence (0.50 < 0.6); time conflict detected" and got["v"].reason == "time unresolved"
    assert "<td>4</td>" in export.html_summary(export.plan(items_, res, dups))


def test_log_and_scan(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.json").write_text('{"id": "x", "n": 1}\nbroken\n{"id": "x", "n": 2}\n{"id": "y", "n": 5}\n')
    assert {(r.id, r.n) for r in logs.read_log(spark, str(log), "id string, n int", "id").collect()} == {("x", 2), ("y", 5)}
    files = tmp_path / "files"
    for p in ("a/b.jpg", ".hidden/c.jpg", "d.db"):
        (files / p).parent.mkdir(parents=True, exist_ok=True)
        (files / p).write_bytes(b"abc")
    got = logs.scan(spark, str(files), ("db",), content=True).collect()
    assert [(r.relpath, r.filesize, r.sha1) for r in got] == [("a/b.jpg", 3, "a9993e364706816aba3e25717850c26c9cd0d89d")]


def test_stream(spark, tmp_path):
    from datelode.sources.album import album
    from datelode.streaming.incremental import resolve_stream

    rows = album(spark, "/root/testdata/sf0.001").limit(50)
    rows.write.parquet(str(tmp_path / "in"))
    resolve_stream(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert 0 < spark.read.parquet(str(tmp_path / "out")).count() <= 50
