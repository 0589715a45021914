"""Stages, options, writers, samples and checkpoints: the parts around the queries."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from datelode import options, stages
from datelode.functions import values
from datelode.operators import dataset, dedup, labels, mine, similar, tagger
from datelode.plans import writer
from datelode.sources import checkpoint, logs


def test_options():
    assert options.parse_skip("", frozenset({"db"})) == {"db"} and options.parse_skip(" PDF, txt,", frozenset({"db"})) == {"db", "pdf", "txt"} and options.parse_skip("=pdf", frozenset({"db"})) == {"pdf"}
    at = datetime(2026, 5, 19, 15, 8, 30)
    assert options.run_prefix("/home/x/pri mary/", at) == "20260519150830_pri_mary" and options.run_prefix("", at) == "20260519150830"
    with pytest.raises(ValueError):
        options.Options(dedup="all")


def test_stages(spark):
    df = spark.createDataFrame([(1, ["UNSUPPORTED"], []), (2, [], ["a"]), (3, None, None)], "id int, flags array<string>, completed_stages array<string>")
    a = stages.Stage("a", lambda df: {"flags": stages.add_flag("A"), "n": F.lit(1)})
    whole = stages.Stage("w", lambda df: df.withColumn("flags", stages.remove_flag("A")), whole=True)
    got = {r.id: (r.flags, r.completed_stages, r.n) for r in stages.run_stages(df, a).collect()}
    assert got == {1: (["UNSUPPORTED"], [], None), 2: ([], ["a"], None), 3: (["A"], ["a"], 1)}
    assert {r.id: (r.flags, r.completed_stages) for r in stages.run_stages(df, a, whole).collect()}[3] == ([], ["a", "w"])


def test_writer(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    (source / "a").mkdir(parents=True)
    (source / "a/x.jpg").write_bytes(b"x" * 3_000_000)
    (source / "y.jpg").write_bytes(b"y")
    plan = spark.createDataFrame([("1", "copy", "confident", "a/x.jpg", "a/x.jpg"), ("2", "duplicate", "duplicate", "y.jpg", "y.jpg"), ("3", "copy", "review", "gone.jpg", "gone.jpg"), ("4", "convert", "confident", "y.jpg", "y.png")], "item_id string, action string, bucket string, source_relpath string, dest_relpath string")
    notes = spark.createDataFrame([("2", "a note\n")], "item_id string, note string")
    run = lambda: {r.item_id: (r.status, r.error[:17]) for r in writer.execute(plan, str(source), str(out), notes).collect()}
    first = run()
    assert (first["1"][0], first["2"][0], first["3"][0], first["4"][0]) == ("done", "done", "failed", "failed") and first["3"][1] == "FileNotFoundError"
    assert (out / "confident/a/x.jpg").read_bytes() == b"x" * 3_000_000 and (out / "duplicate/y.jpg.duplicate.txt").read_text() == "a note\n"
    assert [run()[k][0] for k in "12"] == ["skipped", "skipped"]
    (out / "confident/a/x.jpg").write_bytes(b"half")
    assert run()["1"][0] == "done" and sorted(p.name for p in (out / "confident/a").iterdir()) == ["x.jpg"]
    for bad in (str(source), f"{source}/sub"):
        with pytest.raises(ValueError):
            writer.check_target(bad, str(source))
    writer.check_target(f"{source}2", str(source))


def test_samples_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(str(k), list("ab1"), ["O", "O", "B-YEAR"][: 3 - k % 2], k % 2) for k in range(60)], "item_id string, chars array<string>, labels array<string>, clf_label int")
    dataset.write_dataset(rows, str(tmp_path / "d"))
    assert {p.name for p in (tmp_path / "d").iterdir() if p.is_dir()} <= {"split=train", "split=val", "split=test"}
    back = dataset.read_samples(spark, str(tmp_path / "d"))
    assert back.count() == 60 and back.where("size(chars) <> size(labels)").count() == 0 and dataset.read_samples(spark, str(tmp_path / "d"), 7).count() == 7


def test_intervals_and_spans(spark):
    one = lambda r, b, e: (r, b, e)
    df = spark.createDataFrame([([one(3, 0, 8), one(6, 0, 15), one(1, 20, 24), one(1, 22, 30)],), ([],)], "x array<struct<rank:int,begin:int,end:int>>")
    assert [[(s.begin, s.end) for s in r.k] for r in df.select(dataset.select_intervals(F.col("x")).alias("k")).collect()] == [[(0, 15), (22, 30)], []]
    tags = spark.createDataFrame([(1, ["I-DAY", "I-DAY", "O", "B-YEAR", "I-YEAR", "B-YEAR", "I-DAY"]), (2, []), (3, ["O"])], "id int, labels array<string>")
    assert sorted(tuple(r) for r in labels.spans(tags).collect()) == [(1, "DAY", 0, 2), (1, "DAY", 6, 7), (1, "YEAR", 3, 5), (1, "YEAR", 5, 6)]


def test_tagger(spark):
    spans = spark.createDataFrame([("a", "YEAR", "2020", 0.9, 0.8), ("a", "YEAR", "1999", 0.5, 0.8), ("a", "MONTH", "13", 0.7, 0.8), ("b", "DAY", "x", 0.5, 1.0)], "id string, field string, value string, confidence double, clf double")
    got = {r.id: r for r in tagger.dates(spans).collect()}
    assert got["a"].dt is None and got["a"].fields == {"YEAR": "2020", "MONTH": "13"} and got["a"].confidence == 0.64 and got["a"].precision == "month" and got["b"].dt is None
    vocabulary = spark.createDataFrame([("a", 2), ("b", 3)], "char string, id int")
    assert [r.ids for r in tagger.encode(spark.createDataFrame([("abx",), ("",), (None,)], "t string"), "t", vocabulary).collect()] == [[2, 3, 1], [], []]


def test_checkpoint(spark, tmp_path):
    log = spark.createDataFrame([("x", 1, ["A"], None, "h", 5), ("x", 2, None, ["s"], "", 0), (None, 3, ["B"], None, "z", 1)], "item_id string, seq int, flags array<string>, completed_stages array<string>, sha1 string, width int")
    items = spark.createDataFrame([("x", ["Q"], [], "old", 7), ("y", ["K"], [], "o", 1)], "item_id string, flags array<string>, completed_stages array<string>, sha1 string, width int")
    got = {r.item_id: tuple(r)[1:] for r in checkpoint.restore(items, log).collect()}
    assert got == {"x": ([], ["s"], "old", 7), "y": (["K"], [], "o", 1)}
    assert [(r.item_id, r.seq) for r in checkpoint.first_rows(log, "item_id", "seq").collect()] == [("x", 1)]
    checkpoint.compact(log.where("item_id IS NOT NULL"), "item_id", "seq", str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1


def test_values(spark):
    df = spark.createDataFrame([(b"Canon\0\0", 1.5), (b"\xff\x01", 0.0), (b"", -1.0)], "raw binary, s double")
    got = df.select(values.bytes_text(F.col("raw")), values.from_epoch(F.col("s")), values.get(F.create_map(F.lit("a"), F.lit("b")), "c", "d")).collect()
    assert [tuple(r) for r in got] == [("Canon", datetime(1970, 1, 1, 0, 0, 1, 500000), "d"), ("0xff01", datetime(1970, 1, 1), "d"), ("", datetime(1969, 12, 31, 23, 59, 59), "d")]


def test_dedup_modes(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", None), (3, "b", 0b11), (4, "", 0b111), (5, "", None), (6, "c", -1)], "id long, sha1 string, h long")
    by = lambda mode: {r.id: (r.group_id, r.kind) for r in dedup.grouped(df, mode, 2).collect()}
    assert by("no") == {} and by("sha1") == {1: (1, "sha1"), 2: (1, "sha1")} and by("phash") == {k: (1, "phash") for k in (1, 2, 3, 4)}
    pairs = spark.createDataFrame([(1, 5, 0.9), (5, 6, 0.8)], "id_a long, id_b long, score double")
    assert {(r.id, r.related_id) for r in dedup.review_flags(dedup.grouped(df, "phash", 2), pairs).collect()} == {(5, 6), (6, 5)}


def test_improve_cascades_with_passes(spark):
    ev = spark.createDataFrame([(1, 0, "known", datetime(2020, 1, 1), "second", 0.9, True)], "item_id long, ev_seq int, source string, dt timestamp_ntz, precision string, confidence double, is_direct boolean")
    near = spark.createDataFrame([(2, 1, 0.99), (3, 2, 0.96)], "query_id long, vec_id long, score double")
    assert {r.item_id for r in similar.improve(ev, near, 1).collect()} == {1, 2} and {r.item_id: r.confidence for r in similar.improve(ev, near, 2).collect()} == {1: 0.9, 2: 0.75, 3: 0.65}


def test_digit_readings(spark):
    df = spark.createDataFrame([("a2020x02x30",), ("2020-02-29",), ("20200229 235960",), ("202013",), ("x",)], "t string")
    assert [r.p and (r.p.precision, str(r.p.dt.date())) for r in df.select(mine.parse_digits(F.col("t")).alias("p")).collect()] == [None, ("day", "2020-02-29"), None, None, None]


def test_live_photos(spark, tmp_path):
    import zipfile

    from datelode.sources import livephoto

    (tmp_path / "a").mkdir()
    for name, entries in {"a/x.livp": {"__M/y.heic": b"no", "b.jpg": b"jpg", "c.HEIC": b"heic"}, "n.livp": {"v.mov": b"v"}}.items():
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for n, content in entries.items():
                z.writestr(n, content)
    (tmp_path / "broken.livp").write_bytes(b"PK")
    (tmp_path / "other.jpg").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: (r.name, r.content and bytes(r.content), (r.error or "").split(":")[0]) for r in livephoto.unpack(spark, str(tmp_path)).collect()}
    assert got == {"x.livp": ("c.HEIC", b"heic", ""), "n.livp": (None, None, "ValueError"), "broken.livp": (None, None, "BadZipFile")}


def test_small_functions(spark):
    from datelode.functions import metadata, paths

    df = spark.createDataFrame([("a/b/c", "a/b/d", "2020:02:30", 1.0, 2.0, 3.9), (".", "a", "2020:02:29", 23.0, 59.0, 59.9)], "a string, b string, d string, h double, m double, s double")
    got = df.select(paths.overlap(F.col("a"), F.col("b")), metadata.gps_time(F.col("d"), F.col("h"), F.col("m"), F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(4, None), (0, datetime(2020, 2, 29, 23, 59, 59))]
    texts = spark.createDataFrame([("aab",), ("年年a",)], "t string")
    assert {r.char: r.id for r in labels.vocabulary(texts, "t", min_freq=2).collect()} == {"a": 2, "年": 3} and {r.char for r in labels.vocabulary(texts, "t", min_freq=1, min_freq_han=3).collect()} == {"a", "b"}


def test_snapshots_keep_the_first_row(spark, tmp_path):
    rows = spark.createDataFrame([("a", 3, "late"), ("b", 1, None), ("a", 1, "first"), (None, 0, "no key"), ("a", 2, "later")], "item_id string, seq int, note string").coalesce(1)
    logs.write_snapshot(rows, str(tmp_path / "by"), order="seq")
    logs.write_snapshot(rows, str(tmp_path / "place"))
    read = lambda name: {r.item_id: (r.seq, r.note) for r in spark.read.schema("item_id string, seq int, note string").json(str(tmp_path / name)).collect()}
    assert read("by") == {"a": (1, "first"), "b": (1, None)} and read("place") == {"a": (3, "late"), "b": (1, None)}


def test_scan_of_a_folder_with_an_apostrophe(spark, tmp_path):
    root = tmp_path / "o'clock 100%"
    (root / "in").mkdir(parents=True)
    (root / "in/a.jpg").write_bytes(b"x")
    got = logs.scan(spark, str(root), content=True, keep=True).collect()
    assert [(r.relpath, r.filesize, bytes(r.content)) for r in got] == [("in/a.jpg", 1, b"x")]
