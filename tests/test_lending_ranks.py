"""Lending in order and ranks of nested groups against plain loops; the writer's attempts; kept paths without a hot key."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from datelode.operators import dedup, similar
from datelode.plans import export, writer

EVIDENCE = "item_id long, ev_seq int, source string, dt timestamp_ntz, precision string, confidence double, is_direct boolean"
RANKS = {"second": 6, "minute": 5, "hour": 4, "day": 3, "month": 2, "year": 1}
STEPS = [(0.98, 0.75), (0.95, 0.65), (0.90, 0.55), (0.85, 0.45)]


def best(rows):
    rows = [r for r in rows if r[3] is not None]
    return min(rows, key=lambda r: (not r[6], -r[5], -RANKS[r[4]], r[1])) if rows else None


def one_by_one(evidence, neighbours, threshold):
    """The loop over items in order of id."""
    held = {}
    for r in evidence:
        held.setdefault(r[0], []).append(r)
    lent = {}
    for i in sorted({q for q, _, _ in neighbours}):
        now = best(held.get(i, []))
        if now and now[5] >= threshold:
            continue
        near = sorted(((s, v) for q, v, s in neighbours if q == i and v != i), key=lambda x: (-x[0], x[1]))
        new = []
        for s, v in near:
            o = best(held.get(v, []))
            if o and o[5] >= threshold:
                new.append((i, 9001 + len(new), "similar", o[3], o[4], next((c for low, c in STEPS if s >= low), 0.40), False))
        held.setdefault(i, []).extend(new)
        lent[i] = len(new)
    return {i: (b[3], b[4], b[5], lent.get(i, 0)) for i, rows in held.items() if (b := best(rows))}


@pytest.mark.parametrize("seed,threshold", [(1, 0.6), (2, 0.4), (3, 0.6)])
def test_lending_in_order(spark, seed, threshold):
    rng = random.Random(seed)
    evidence = [(i, k, "known", None if rng.random() < 0.1 else datetime(2024, 1, 1) + timedelta(days=rng.randint(0, 900)), rng.choice([*RANKS]), rng.choice([0.3, 0.5, 0.6, 0.9]), rng.random() < 0.5) for i in range(60) if rng.random() < 0.5 for k in range(rng.randint(1, 2))]
    neighbours = [(i, j, rng.choice([0.99, 0.96, 0.92, 0.87, 0.7])) for i in range(60) for j in rng.sample(range(60), 5)]
    neighbours += [(i, i - 1, 0.99) for i in range(1, 60) if not any(q == i and v == i - 1 for q, v, _ in neighbours)]  # one long chain
    got = similar.improve_in_order(spark.createDataFrame(evidence, EVIDENCE), spark.createDataFrame(neighbours, "query_id long, vec_id long, score double"), threshold).collect()
    want = one_by_one(evidence, neighbours, threshold)
    assert {r.item_id: (r.final_datetime, r.precision, r.confidence, r.n_lent) for r in got} == want
    assert similar.improve_in_order(spark.createDataFrame(evidence, EVIDENCE), spark.createDataFrame([], "query_id long, vec_id long, score double"), threshold).count() == len({r[0] for r in evidence if r[3]})


@pytest.mark.parametrize("ranges", [1, 9])
def test_ranks_of_nested_groups(spark, ranges):
    rng = random.Random(7)
    rows = [(i, rng.choice(["", "hot", "hot", f"c{i % 9}"]), rng.choice([None, 5, 5, 6, 1 << 40]), float(rng.randint(0, 3)), rng.randint(0, 5), f"p{rng.randint(0, 30)}") for i in range(250)]
    items = spark.createDataFrame(rows, "id long, sha1 string, h long, score double, filesize int, relpath string")
    groups = {r.id: (str(r.group_id), r.kind) for r in dedup.grouped(items, "phash", 2).collect()}
    members = {}
    for r in rows:
        if r[0] in groups:
            members.setdefault(groups[r[0]], []).append((-r[3], -r[4], r[5], r[0]))
    want = {(i, g, k, kind) for (g, kind), m in members.items() for k, (*_, i) in enumerate(sorted(m))}
    got = dedup.ranked(items, "phash", 2, ranges=ranges).collect()
    assert {(r.id, r.group_id, r.dup_rank, r.kind) for r in got} == want and len(got) == len(want) and max(len(m) for m in members.values()) > 100
    pairs = spark.createDataFrame([(a, b, 0.9) for a, b in ((500, 501), (501, 502), (0, 503))], "id_a long, id_b long, score double")
    clip = dedup.ranked(items, "clip", 2, pairs, ranges).where("needs_review").collect()
    assert sorted((r.id, r.group_id, r.dup_rank, r.kind) for r in clip) == [(i, "", -1, "clip") for i in (500, 501, 502)] + ([] if 0 in groups else [(0, "", -1, "clip"), (503, "", -1, "clip")])


def test_kept_paths_have_no_hot_key(spark):
    actions = spark.createDataFrame([(str(i), f"p{i}", "g" if i in (3, 4) else "", 1 if i == 4 else 0) for i in range(50)], "item_id string, source_relpath string, duplicate_group_id string, duplicate_rank int")
    out = export.with_kept(actions)
    assert {r.item_id: r.duplicate_kept_relpath for r in out.collect()} == {str(i): "p3" if i in (3, 4) else None for i in range(50)}
    key = F.when(F.col("duplicate_group_id") == "", F.concat(F.lit("i"), "item_id")).otherwise(F.concat(F.lit("g"), "duplicate_group_id"))
    assert actions.select(key).distinct().count() == 49  # as many keys as rows and groups
    assert out.columns == [*actions.columns, "duplicate_kept_relpath"]


def test_writer_attempts_have_names_of_their_own(tmp_path, monkeypatch):
    from pyarrow import fs as arrow_fs

    (tmp_path / "a").write_bytes(b"a" * 10)
    target, local, seen = str(tmp_path / "out/a"), arrow_fs.LocalFileSystem(), []

    class Slow:
        """Lets a second attempt write while the first one is about to rename."""

        def __getattr__(self, name):
            return getattr(local, name)

        def move(self, part, to):
            seen.append(part)
            if len(seen) == 1:
                writer._put(self, str(tmp_path / "a"), target, 2)
            local.move(part, to)

    writer._put(Slow(), str(tmp_path / "a"), target, 1)
    assert len(set(seen)) == 2 and (tmp_path / "out/a").read_bytes() == b"a" * 10 and [p.name for p in (tmp_path / "out").iterdir()] == ["a"]


def test_writer_copies_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.jpg").write_bytes(b"x")
    plan = spark.createDataFrame([("1", "copy", "confident", "x.jpg", "x.jpg")], "item_id string, action string, bucket string, source_relpath string, dest_relpath string")
    out = writer.execute(plan, str(tmp_path / "in"), str(tmp_path / "out"))
    (tmp_path / "out/confident/x.jpg").unlink()
    assert [r.status for r in out.collect()] == ["done"] and not (tmp_path / "out/confident/x.jpg").exists()
