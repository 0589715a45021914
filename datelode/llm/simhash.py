"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: lower-case A-Z, words between ASCII white space, 3-word shingles with repeats (fewer
words: the whole sequence); a bit is 1 if it is set in over half the shingles' XXH64 (seed 42).
Texts without words have fingerprint zero and link like any other.

Search: bit i of a fingerprint gets a code m(i) of radius+1 bits; table v (each code but zero) keeps
the bits with an even number of ones in m(i) & v. Any radius differing bits leave some v orthogonal
to all their codes, so each pair within the radius agrees in full in one of the 2**(radius+1)-1
tables: nothing is missed. Only distinct fingerprints are searched. Inside a bucket no pairs are
listed: a breadth-first search emits one link for each fingerprint that it reaches. A bucket of more
than BUCKET fingerprints is split again by the same kind of masks over the bits that it does not
share; since that halves the free bits each time, buckets are bounded after a few levels.

Rows get their component by fingerprint: the few that many rows share by a broadcast of bounded size, the
others by a join. Components: large-star and small-star rounds over the links, each written to the shared folder.

Null ids keep their row (component: the smallest id of the group, null if it has none); repeated rows
stay; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datelode.llm.common import doc_bytes, materialize, parts

RADIUS = 3
#: Fingerprints in a bucket above which it is split by further masks.
BUCKET = 4096
#: Fingerprints that are broadcast with their component are fewer than this.
HOT = 50_000


def fingerprint(body: bytes, shingle: int = 3) -> int:
    """SimHash of one text, unsigned."""
    import xxhash

    words = body.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    size = min(shingle, len(words))
    grams = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype=np.uint64, count=len(words) - size + 1)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 8192):
        ones += np.unpackbits(h[k : k + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""
    rows = doc_bytes(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(b.as_py()) for b in batch.column("body")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the given bit positions of which one keeps no bit of any radius of them."""
    codes = 1 << (radius + 1)
    return [sum(1 << b for k, b in enumerate(bits) if ((k % (codes - 1) + 1) & v).bit_count() % 2 == 1) for v in range(1, codes)]


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what lies within radius, one for each fingerprint reached."""
    links, rest = [], fps.copy()
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            found = rest[near]
            links += [(int(at), int(x)) for x in found]
            queue += list(found)
            rest = rest[~near]
    return links


def bucket_links(fps: np.ndarray, free: int, radius: int = RADIUS, limit: int = BUCKET) -> list[tuple[int, int]]:
    """Links inside one bucket of distinct fingerprints (uint64) that agree outside the bits of free."""
    bits = [b for b in range(64) if free >> b & 1]
    if len(fps) <= limit or len(bits) <= 8:
        return _forest(fps, radius)
    links = []
    for mask in covering_masks(bits, radius):
        key = fps & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for some in np.split(fps[order], cuts):
            if len(some) > 1:
                links += bucket_links(some, free & ~mask, radius, limit)
    return links


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links between distinct fingerprints of fps(fp) that span every group within radius."""
    masks = covering_masks(list(range(64)), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for v, m in enumerate(signed)])
    dealt = fps.select("fp", F.explode(tables).alias("t")).select("t.v", "t.key", "fp")
    dealt = dealt.repartition(parts(fps.sparkSession), "v", "key").sortWithinPartitions("v", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # pieces of the bucket at the end of a batch, which may go on in the next

        def search(v: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((np.diff(v) != 0) | (np.diff(key) != 0)) + 1
            begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(v)]])
            many = end - begin > 1
            found = [x for a, b in zip(begin[many].tolist(), end[many].tolist(), strict=True) for x in bucket_links(fp[a:b].view(np.uint64), ~masks[v[a]] & (1 << 64) - 1, radius)]
            pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            if not len(now[0]):
                continue
            new = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = int(new[-1]) + 1 if len(new) else 0
            if cut or held and (held[-1][0][-1], held[-1][1][-1]) != (now[0][0], now[1][0]):
                held.append([x[:cut] for x in now])
                yield search(*map(np.concatenate, zip(*held, strict=True)))
                held = []
            held.append([x[cut:] for x in now])
        if held:
            yield search(*map(np.concatenate, zip(*held, strict=True)))

    return dealt.select(F.col("v").cast("long"), "key", "fp").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """node, root (the smallest node of its component) for each node of edges, by star rounds."""
    pair = lambda x, y: F.explode(F.array(F.struct(F.col(x).alias("u"), F.col(y).alias("v")), F.struct(F.col(y).alias("u"), F.col(x).alias("v")))).alias("e")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.hash("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())

    now = materialize(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = state(now)
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.select(pair("u", "v")).select("e.*")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")  # repeats go with those of small
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = materialize(small)
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of docs."""
    marked = materialize(fingerprints(docs))
    ids = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    roots = components(links(ids.select("fp"), radius))
    groups = ids.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))
    groups = materialize(groups)
    lowest = groups.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialize(groups.join(lowest, "root").select("fp", "n", "component_id"))
    # fingerprints of more than 1 in HOT rows (so fewer than HOT of them) are broadcast, the others joined
    hot = F.col("n") > F.lit(max(1, marked.count() // HOT))
    often = marked.join(F.broadcast(named.where(hot).select("fp", F.col("component_id").alias("found"), F.lit(True).alias("hot"))), "fp", "left")
    rest = often.where("hot IS NULL").select("doc_id", "fp").join(named.where(~hot).select("fp", "component_id"), "fp")
    both = often.where("hot").select("doc_id", "fp", F.col("found").alias("component_id")).unionByName(rest)
    return both.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
