"""What the findings of round 4 named: far times, wide hash limits, vectors over several passes, fits in batches, scores without a shuffle of labels."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from datelode import catalog
from datelode.functions import values
from datelode.operators import allpairs, char_tagger, dedup, labels, profile, resolve, similar


def test_far_epochs_are_exact(spark):
    seconds = [0.0, -0.25, 1.5, 3336827 * 86400.5, 3340693 * 86400.5]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(seconds)], "k int, s double")
    far = rows.select("k", values.from_epoch(F.col("s")).cast("string").alias("t"))
    assert [r.t for r in far.orderBy("k").collect()] == ["1970-01-01 00:00:00", "1969-12-31 23:59:59.75", "1970-01-01 00:00:01.5", "+11105-12-23 07:26:53.5", "+11116-07-24 07:59:06.5"]
    assert spark.range(1).select(values.from_epoch(F.lit(7))).first()[0] == datetime(1970, 1, 1) + timedelta(seconds=7)


def test_folders_of_users_are_names_like_others(spark):
    """a folder u1999 holds a year of four digits, as the light tests have it; date_coverage's SQL takes the folders of users for undated."""
    rows = spark.createDataFrame([("a", "u1999/x/a.jpg"), ("a", "u1899/x/a.jpg")], "stem string, relpath string")
    assert {(r.level, r.dated): r.n for r in profile.date_coverage(rows).collect()} == {("segment", True): 1, ("segment", False): 5, ("item", True): 1, ("item", False): 1}


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind,piece", [("long", 1 << 20), ("string", 1 << 20), ("long", 400)])
def test_wide_limits_compare_hashes_in_blocks(spark, monkeypatch, kind, piece):
    monkeypatch.setattr(allpairs, "PIECE", piece)  # 400: six pieces
    rng = random.Random(3)
    rows = [(k, rng.getrandbits(64) - (1 << 63)) for k in range(290)]
    rows += [(300, rows[0][1]), (301, rows[1][1] ^ 0b111), (302, -1), (303, 0), (304, None), (5, rows[5][1] ^ 1)]  # equal, near, and an id that is there twice
    want = sorted((*sorted((str(i), str(j)) if kind == "string" else (i, j)), d) for n, (i, x) in enumerate(rows) for j, y in rows[:n] if i != j and None not in (x, y) and (d := ((x ^ y) & (1 << 64) - 1).bit_count()) <= 18)
    got = dedup.hamming_pairs(spark.createDataFrame(rows, "id long, h long").withColumn("id", F.col("id").cast(kind)), 18)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10
    assert "Join" not in planned(got)  # bands of three bits made nearly all pairs rows of a join
    assert dedup.hamming_pairs(spark.createDataFrame([], "id long, h long"), 18).count() == 0


def vectors(spark, n=150, size=8, seed=5, kind="float"):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, size)).astype("f4")
    x[n // 2 :: 7] = x[3]  # equal scores, so ids decide
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(int(k), v.tolist()) for k, v in zip(rng.permutation(n), x, strict=True)] + [(n + 1, None)]
    return spark.createDataFrame(rows, f"id long, embedding array<{kind}>"), {i: np.array(v, dtype="f4" if kind == "float" else "f8").astype("f8") for i, v in rows if v}


def by_hand(x, least):
    score = lambda a, b: round(float(np.cumsum(a * b)[-1]), 6)
    return {(i, j): s for i in x for j in x if i != j and (s := score(x[i], x[j])) >= least}


@pytest.mark.parametrize("piece,kind", [(1 << 20, "float"), (3000, "float"), (3000, "double")])
def test_vectors_meet_in_passes(spark, monkeypatch, piece, kind):
    monkeypatch.setattr(allpairs, "PIECE", piece)  # 3000: four pieces
    monkeypatch.setattr(similar, "TILE", (16, 40))
    monkeypatch.setattr(similar, "FIRST", 7)
    df, x = vectors(spark, kind=kind)
    want = by_hand(x, 0.2)
    pairs = similar.cosine_pairs(df, 0.2)
    assert sorted(map(tuple, pairs.collect())) == sorted((i, j, s) for (i, j), s in want.items() if i < j)
    best = similar.nearest(df, df, 4, 0.2)
    ranked = {(i, j, s, k + 1) for i in x for k, (s, j) in enumerate(sorted(((s, j) for (a, j), s in want.items() if a == i), key=lambda z: (-z[0], z[1]))[:4])}
    assert {tuple(r) for r in best.collect()} == ranked
    assert "Join" not in planned(pairs) and "Join" not in planned(best)  # no row of a block is sent once for each other block
    odd = spark.createDataFrame([(1, [1e20, 0.0]), (2, [1e20, 1.0]), (3, [float("nan"), 1.0]), (4, [0.0, 0.0]), (5, [1.0, 0.5])], "id long, embedding array<double>")
    assert sorted(map(tuple, similar.cosine_pairs(odd, 0.2).collect())) == [(1, 2, 1e40), (1, 5, 1e20), (2, 5, 1e20)]
    with pytest.raises(Exception, match="different sizes"):
        similar.cosine_pairs(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0, 4.0])], "id long, embedding array<double>"), 0.2).collect()


def test_flags_need_no_pairs_of_groups(spark):
    """only vectors outside of all groups are compared, with the same flags."""
    items = spark.createDataFrame([(k, "" if k > 5 else "same", None, 1.0, k, f"p{k}") for k in range(12)], "id long, sha1 string, h long, score double, filesize int, relpath string")
    pairs = spark.createDataFrame([(0, 6, 0.9), (6, 7, 0.8), (7, 8, 0.9), (1, 2, 0.9)], "id_a long, id_b long, score double")
    seen = []

    def alone(grouped):
        seen.extend(r.id for r in grouped.collect())
        return pairs.join(grouped.select(F.col("id").alias("id_a")), "id_a", "left_anti").join(grouped.select(F.col("id").alias("id_b")), "id_b", "left_anti")

    assert sorted(map(tuple, dedup.ranked(items, "clip", 2, alone).collect())) == sorted(map(tuple, dedup.ranked(items, "clip", 2, pairs).collect())) and sorted(seen) == list(range(6))
    flags = dedup.review_flags(items.where("id < 6").select("id"), pairs)
    assert sorted(map(tuple, flags.collect())) == [(6, 7, 0.8), (7, 8, 0.9), (8, 7, 0.9)]


def test_plans_by_likeness_resolve_once_and_sort_once(spark, monkeypatch):
    """evidence is found, and resolved, once a plan."""
    calls, real = [], resolve.resolve
    monkeypatch.setattr(resolve, "resolve", lambda *a: calls.append(a) or real(*a))
    assert catalog.export_plan_phash(spark, "/root/testdata/sf0.001").count() == catalog.album(spark, "/root/testdata/sf0.001").count() and len(calls) == 1
    rows = spark.createDataFrame([(str(k), 0, "exif", datetime(2024, 1, 1), "day", 0.5, True) for k in range(9)], "item_id string, ev_seq int, source string, dt timestamp_ntz, precision string, confidence double, is_direct boolean")
    assert planned(real(rows)).split("== Initial")[0].count("Sort [") == 1


def tagged_names(spark, n):
    rows = []
    for k in range(n):
        date = f"{1990 + k % 40}{1 + k % 12:02}{1 + k % 28:02}"
        rows.append((f"n{k}", f"IMG_{date}" if k % 3 else f"no{k}", "DATE8" if k % 3 else "", 4))
    df = spark.createDataFrame(rows, "id string, text string, p string, start int")
    return df.select("id", "text", F.filter(F.split("text", ""), lambda c: c != "").alias("chars"), labels.bio_labels(F.col("text"), F.col("p"), F.col("start")).alias("labels"))


def test_fits_go_over_batches(spark, monkeypatch):
    monkeypatch.setattr(char_tagger, "BATCH", 70)
    seen, real = [], char_tagger._summed
    monkeypatch.setattr(char_tagger, "_summed", lambda rows, *a: seen.append(rows.count()) or real(rows, *a))
    df = tagged_names(spark, 260)
    one, log = char_tagger.fit(df, steps=4, tasks=1)
    assert len(seen) == 6 and seen[:3] == seen[3:] and max(seen) < 150  # two rounds of three batches
    assert sum(seen[:3]) == df.where(char_tagger.split(F.col("id")) != "test").count()  # a round reads every row
    many, other = char_tagger.fit(df, steps=4, tasks=5)
    assert np.allclose(one.theta, many.theta) and np.allclose(log, other)


def test_labels_are_laid_as_a_whole(spark):
    text = "xx20240101_101112yy"
    rows = [(text, "DATETIME8_6", 2), (text, "DATE8", 14), (text, "DATE8", -2), (text, "", 2), (text, None, None), ("", "DATE8", 0), (None, "DATE8", 0)]
    got = [r.x for r in spark.createDataFrame(rows, "t string, p string, s int").select(labels.bio_labels(F.col("t"), F.col("p"), F.col("s")).alias("x")).collect()]
    y, m, d = ["B-YEAR", *["I-YEAR"] * 3], ["B-MONTH", "I-MONTH"], ["B-DAY", "I-DAY"]
    time = ["B-HOUR", "I-HOUR", "B-MINUTE", "I-MINUTE", "B-SECOND", "I-SECOND"]
    none = ["O"] * 19
    assert got == [["O", "O", *y, *m, *d, "O", *time, "O", "O"], [*["O"] * 14, *y, "B-MONTH"], [*y[2:], *m, *d, *["O"] * 13], none, none, [], None]


def test_overall_scores_label_names_once(spark, monkeypatch):
    """names are matched with the two patterns that are asked for, labelled once, and their spans are written once."""
    asked, real = [], catalog.evidence.filename_evidence
    monkeypatch.setattr(catalog.evidence, "filename_evidence", lambda items, patterns=None: asked.append([p.name for p in patterns]) or real(items, patterns))
    plan = planned(catalog.overall_scores(spark, "/root/testdata/sf0.001"))
    assert asked == [["DATETIME8_6", "DATE8"]] and "events.parquet" not in plan
