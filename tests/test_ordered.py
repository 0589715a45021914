"""Scans by ranges against the same scans by windows, with ties, nulls, one hot key and none."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from datelode.operators import ordered, timeline

START = datetime(2024, 1, 1)


def times(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows, t = [], START
    for k in range(n):
        t += timedelta(minutes=rng.choice([0, 0, 1, 20, 400]))
        rows.append((k, rng.choice(["hot", "hot", "hot", "b", None]), None if k % 41 == 0 else t))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id int, k string, t timestamp_ntz")


def as_set(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("key", [[], ["k"]])
@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_sessions_by_ranges(spark, key, ranges):
    rows = times(spark)
    want = timeline.sessionize(rows, "t", key, "id", 6)
    got = ordered.sessions(rows, "t", key, "id", 6, ranges)
    assert as_set(got.select(want.columns)) == as_set(want)
    assert as_set(ordered.sessions(rows.limit(0), "t", key, "id", 6, ranges)) == []


def test_global_sessions_have_no_unpartitioned_window(spark):
    plan = ordered.sessions(times(spark), "t", [], "id", 6, 5)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Scan")[0] and "Window" not in plan  # scanned ranges are written, only their edges are joined


@pytest.mark.parametrize("ranges", [1, 3, 30])
def test_numbers_by_ranges(spark, ranges):
    rows = times(spark)
    order = [F.desc("t"), F.asc("id")]
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(*order)) - 1)
    assert as_set(ordered.numbered(rows, ["k"], order, "n", ranges).select(want.columns)) == as_set(want)
    every = ordered.numbered(rows, [], order, "n", ranges)
    assert [r.n for r in every.orderBy(*order).collect()] == list(range(rows.count()))


@pytest.mark.parametrize("ranges", [1, 4, 60])
def test_one_key_is_spread_over_tasks(spark, ranges):
    rows = times(spark).withColumn("k", F.lit("one"))
    dealt = ordered.dealt(rows, ["k"], ["t", "id"], ranges)
    sizes = [r["count"] for r in dealt.groupBy(ordered.RANGE).count().collect()]
    assert len(sizes) >= ranges * 0.6 and max(sizes) <= 3 * 400 / ranges + 10


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("ranges", [1, 5, 50])
def test_interpolation_by_ranges(spark, seed, ranges):
    rng = random.Random(seed)
    rows = []
    for k in range(300):
        session = rng.choice([0, 0, 0, 0, 1, 2]) if k < 280 else 3  # session 3 has no anchor
        anchor = rng.random() < 0.3 and session != 3
        dt = START + timedelta(minutes=rng.randint(0, 9000)) if anchor or rng.random() < 0.2 else None
        rows.append((f"i{k:03}", rng.choice(["u", "v"]) if session == 1 else "u", session, anchor, f"{rng.choice('ab')}/{rng.choice('cd')}/x", f"IMG_{rng.randint(0, 60)}", dt, round(rng.random(), 2), START + timedelta(minutes=rng.randint(0, 9000))))
    members = spark.createDataFrame(rows, "item_id string, user string, session_idx int, is_anchor boolean, relpath string, stem string, final_datetime timestamp_ntz, confidence double, mtime timestamp_ntz")
    want = timeline.interpolate(members, ["user"])
    assert as_set(timeline.interpolate_wide(members, ["user"], ranges)) == as_set(want) and want.count() > 100
    assert as_set(timeline.interpolate_wide(members.drop("user"), [], ranges)) == as_set(timeline.interpolate(members.withColumn("user", F.lit(1)), ["user"]))
