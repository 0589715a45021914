"""The log by generations against plain lists, and streams in any order of batches against the batch result."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from datelode.operators.resolve import resolve
from datelode.sources.generations import Generations
from datelode.streaming import incremental


def test_generations(spark, tmp_path):
    rng = random.Random(2)
    log = Generations(spark, str(tmp_path / "log"), "key string, value int, note string", files=4)
    assert log.last().count() == log.first(keys=["k1"]).count() == log.rows().count() == log.merge() == 0
    seen = []
    for batch in range(9):
        rows = [(f"k{rng.randrange(60):03}" if rng.random() < 0.95 else None, rng.randrange(99), rng.choice([None, "a"])) for _ in range(40)]
        log.append(spark.createDataFrame(rows, "key string, value int, note string").coalesce(1))
        seen += [r for r in rows if r[0] is not None]
        if batch == 6:
            assert log.merge(3) == 2  # three of level 0, twice
    log.append(spark.createDataFrame([], "key string, value int, note string"))
    last, first = {k: (v, n) for k, v, n in seen}, {k: (v, n) for k, v, n in reversed(seen)}
    as_dict = lambda df: {r.key: (r.value, r.note) for r in df.collect()}
    assert as_dict(log.last()) == last and as_dict(log.first()) == first
    while log.merge(2):
        pass
    assert as_dict(log.last()) == last and as_dict(log.first()) == first
    some = ["k003", "k017", "nothing"]
    assert as_dict(log.last(keys=some)) == {k: v for k, v in last.items() if k in some} and as_dict(log.first(low="k010", high="k019")) == {k: v for k, v in first.items() if "k010" <= k <= "k019"}
    levels = [r.level for r in log.manifest().collect()]
    assert len({r.gen for r in log.manifest().collect()}) < 4 and max(levels) >= 2
    files = spark.createDataFrame([(f"k{k:03}",) for k in range(55, 65)], "key string")
    known, new = log.split_known(files)
    assert {r.key for r in known.collect()} == {r.key for r in files.collect()} & set(last) and known.count() + new.count() == 10


def test_lookups_read_touched_ranges_only(spark, tmp_path):
    log = Generations(spark, str(tmp_path / "log"), "key string, value int", files=8)
    for part in range(3):
        log.append(spark.createDataFrame([(f"k{k:05}", part) for k in range(part * 1000, part * 1000 + 1000)], "key string, value int"))
    every, one = log.rows(), log.rows(keys=["k01500"])
    assert len(every.inputFiles()) >= 20 and len(one.inputFiles()) == 1 and [r.value for r in one.collect()] == [1]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(key,k01500)" in plan
    assert len(log.rows(low="k00990", high="k01010").inputFiles()) == 2 and log.rows(keys=["a"]).count() == 0
    before = {r.file for r in log.manifest().collect()}
    assert log.merge(4) == 0 and {r.file for r in log.manifest().collect()} == before
    log.append(spark.createDataFrame([("k00000", 9)], "key string, value int"))
    assert log.merge(4) == 1 and log.rows(keys=["k00000"]).count() == 2 and {r.value for r in log.last(keys=["k00000"]).collect()} == {9}


def test_a_lost_append_is_never_read(spark, tmp_path):
    log = Generations(spark, str(tmp_path / "log"), "key string, value int", files=2)
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int")
    log.append(rows)
    rows.withColumns({"__gen": F.lit(7).cast("long"), "__line": F.lit(0).cast("long")}).write.parquet(str(tmp_path / "log/data/2-lost"))  # without its manifest rows
    log.append(rows.where("value = 2"))
    assert sorted((r.key, r["__gen"]) for r in log.rows().collect()) == [("a", 1), ("b", 1), ("b", 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_batches_gives_the_batch_result(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(12):
        for k in range(rng.randint(1, 5)):
            dt = None if rng.random() < 0.1 else datetime(2024, 1, 1) + timedelta(days=rng.randint(0, 200), microseconds=rng.randint(0, 10**6))
            rows.append((f"i{i}", k, rng.choice(["exif", "filename"]), dt, rng.choice(["second", "day", "year"]), rng.choice([0.4, 0.6, 0.9]), rng.random() < 0.5))
    rng.shuffle(rows)
    want = resolve(spark.createDataFrame(rows, incremental.EVIDENCE))
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    for k in range(0, len(rows), -(-len(rows) // 4)):  # evidence of an item comes in several batches
        spark.createDataFrame(rows[k : k + -(-len(rows) // 4)], incremental.EVIDENCE).coalesce(1).write.mode("append").parquet(source)
        incremental.resolve_with_state(spark.readStream.schema(incremental.EVIDENCE).parquet(source), out, checkpoint).awaitTermination()
    got = incremental.current(spark, out)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect())) and got.count() > 9
    assert spark.read.parquet(out).count() > 12  # items were resolved again


def test_session_windows_of_a_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    events = [("a", start), ("a", start + timedelta(hours=5)), ("a", start + timedelta(hours=12)), ("b", start), ("z", start + timedelta(days=30))]
    spark.createDataFrame(events, "k string, t timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []

    def keep(rows, number):
        got.extend((r.k, r.n) for r in rows.collect())

    stream = spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "in"))
    counts = incremental.session_counts(stream, "t", "k")
    incremental.for_each_batch(counts, str(tmp_path / "check"), keep).awaitTermination()
    assert sorted(got) == [("a", 1), ("a", 2), ("b", 1)]  # the last one is open until the watermark has passed it
