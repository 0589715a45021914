"""Duplicate groups: equal content, near perceptual hashes, and similar embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datelode.functions.vectors import hamming
from datelode.operators import allpairs, ordered
from datelode.operators.components import components, saved

HAMMING = 4
#: Bits of a band below which a join by bands is nearly all pairs, row by row; hashes are compared in blocks then.
NARROW = 8
# The format that counts as right for an extension in the quality score.
RIGHT_FORMAT = {"jpg": "JPEG", "jpeg": "JPEG", "png": "PNG", "heic": "HEIF", "heif": "HEIF", "tif": "TIFF", "tiff": "TIFF", "webp": "WEBP"}


def quality_score(confidence: Column, has_original: Column, has_gps: Column, ext: Column, real: Column, screenshot: Column, scan: Column) -> Column:
    right = F.lit(False)
    for e, f in RIGHT_FORMAT.items():
        right = right | ((ext == e) & (F.upper(real) == f))
    points = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), F.lit(n)).otherwise(F.lit(0.0))
    return F.when(confidence >= 0.9, F.lit(2.0)).when(confidence >= 0.7, F.lit(1.0)).otherwise(F.lit(0.0)) + points(has_original, 3.0) + points(has_gps, 0.5) + points(right, 1.0) - points(screenshot, 1.0) - points(scan, 0.5)


def exact_groups(items: DataFrame) -> DataFrame:
    """sha1, n, first_id for each content that two or more items share (empty hashes never group)."""
    return items.where("sha1 <> ''").groupBy("sha1").agg(F.count("*").alias("n"), F.min("item_id").alias("first_id")).where("n > 1")


def _within(limit: int) -> allpairs.Find:
    def find(_a: pa.Array, a: np.ndarray, _b: pa.Array, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        a, b = a.view(np.uint64), b.view(np.uint64)  # of signed numbers the absolute value's bits would be counted
        for k in range(0, len(a), 16):
            for j in range(0, len(b), 16_384):  # what a core keeps at hand
                apart = np.bitwise_count(a[k : k + 16, None] ^ b[None, j : j + 16_384])
                at = np.flatnonzero(apart <= limit)
                p, q = np.divmod(at, apart.shape[1])
                yield p + k, q + j, apart.ravel()[at].astype(np.int32)

    return find


def hamming_pairs(hashes: DataFrame, limit: int = HAMMING, bits: int = 64) -> DataFrame:
    """id_a < id_b and distance of all pairs of hashes(id, h) within limit.

    The hash is cut into limit+1 bands; two hashes within limit agree in one of them (pigeonhole), so
    candidates come from an equi-join on (band, value) instead of all pairs. A pair is kept in the first
    band that it agrees in, so no distinct is needed. Where bands would have less than NARROW bits, all pairs
    are compared in blocks.
    """
    n = limit + 1
    if bits // n < NARROW:
        rows = hashes.select("id", F.col("h").alias("x"))
        return allpairs.compared(rows, rows, _within(limit), ("id_a", "id_b", "distance"), "int", half=True)
    edges = [bits * k // n for k in range(n + 1)]
    band = lambda h, k: F.shiftrightunsigned(h, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1))
    if edges[1] >= 63:
        raise ValueError("limit must be 1 at least")
    dealt = hashes.where("h IS NOT NULL").select("id", "h", F.posexplode(F.array(*[band(F.col("h"), k) for k in range(n)])).alias("band", "value"))
    a, b = dealt.alias("a"), dealt.alias("b")
    found = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.id") < F.col("b.id")))
    first = F.lit(n - 1)
    for k in range(n - 2, -1, -1):
        first = F.when(band(F.col("a.h"), k) == band(F.col("b.h"), k), F.lit(k)).otherwise(first)
    distance = hamming(F.col("a.h"), F.col("b.h"))
    return found.where((distance <= limit) & (first == F.col("a.band"))).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), distance.alias("distance"))


def hamming_matches(queries: DataFrame, hashes: DataFrame, limit: int = HAMMING, bits: int = 64) -> DataFrame:
    """query_id, id, distance, rk: what lies within limit of each query(id, h), nearest first; by the same bands as hamming_pairs."""
    n = limit + 1
    edges = [bits * k // n for k in range(n + 1)]
    band = lambda h, k: F.shiftrightunsigned(h, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1))
    dealt = lambda df: df.where("h IS NOT NULL").select("id", "h", F.posexplode(F.array(*[band(F.col("h"), k) for k in range(n)])).alias("band", "value"))
    q = dealt(queries).withColumnsRenamed({"id": "query_id", "h": "qh"})
    first = F.lit(n - 1)
    for k in range(n - 2, -1, -1):
        first = F.when(band(F.col("qh"), k) == band(F.col("h"), k), F.lit(k)).otherwise(first)
    found = q.join(dealt(hashes), ["band", "value"]).where((F.col("query_id") != F.col("id")) & (first == F.col("band")))
    found = found.select("query_id", "id", hamming(F.col("qh"), F.col("h")).alias("distance")).where(F.col("distance") <= limit)
    return found.withColumn("rk", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))


def near_groups(hashes: DataFrame, limit: int = HAMMING) -> DataFrame:
    """id, group_id (smallest id), for hashes in transitive groups of two or more. Equal hashes are searched once."""
    one = hashes.where("h IS NOT NULL").groupBy("h").agg(F.min("id").alias("id"))
    pairs = hamming_pairs(one, limit)
    roots = components(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    named = one.join(roots, F.col("id") == F.col("node"), "left").select("h", F.coalesce("root", "id").alias("group_id"))
    groups = hashes.where("h IS NOT NULL").join(named, "h").select("id", "group_id")
    return groups.join(groups.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1"), "group_id").select("id", "group_id")


def ranked_groups(items: DataFrame, key: str = "sha1") -> DataFrame:
    """item_id, group_id, dup_rank, kind for items(item_id, key, score, filesize, relpath) that share a key.

    Rank 0 has the best score, then the largest file, then the first path. The sort of a group is by
    Spark's external sorter; singles are dropped first by a join with the grouped keys.
    """
    shared = items.where(F.col(key) != "").groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("filesize"), "relpath")
    return items.join(shared, key, "left_semi").select("item_id", F.col(key).alias("group_id"), (F.row_number().over(w) - 1).alias("dup_rank"), F.lit("sha1").alias("kind"))


def group_kind(members: DataFrame) -> DataFrame:
    """group_id, n, kind for members(group_id, sha1): 'sha1' if all share one content, else 'phash'."""
    distinct = F.count_distinct(F.nullif(F.col("sha1"), F.lit("")))
    return members.groupBy("group_id").agg(F.count("*").alias("n"), F.when(distinct == 1, F.lit("sha1")).otherwise(F.lit("phash")).alias("kind"))


def grouped(items: DataFrame, mode: str = "sha1", limit: int = HAMMING) -> DataFrame:
    """id, group_id, kind of items(id, sha1, h) in groups of two or more. Each mode takes in the one before it.

    no: none. sha1: equal content (an empty hash stands alone). phash: groups are joined where their
    representatives, the smallest ids with an h, are within limit; kind is sha1 if all contents are equal.
    """
    if mode == "no":
        return items.select("id", F.col("id").alias("group_id"), F.lit("").alias("kind")).limit(0)
    key = F.when(F.coalesce("sha1", F.lit("")) == "", F.concat(F.lit("nosha1_"), F.col("id").cast("string"))).otherwise(F.col("sha1"))
    rows = items.select("id", "sha1", "h", key.alias("key"))
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.min(F.when(F.col("h").isNotNull(), F.struct("id", "h"))).alias("r"))
    if mode == "sha1":
        named = groups.where("n > 1").select("key", F.col("first").alias("group_id"))
    else:
        groups = saved(groups.where("n > 1 OR r IS NOT NULL"))  # all others stand alone, most of an album
        near = saved(near_groups(groups.where("r IS NOT NULL").select("r.id", "r.h"), limit).select(F.col("id").alias("rid"), F.col("group_id").alias("near")))
        joined = groups.join(near, F.col("r.id") == F.col("rid"), "left").select("key", "first", F.coalesce("near", "first").alias("near"), ((F.col("n") > 1) | F.col("rid").isNotNull()).alias("shared")).where("shared")
        named = joined.join(joined.groupBy("near").agg(F.min("first").alias("group_id")), "near").select("key", "group_id")
    members = saved(rows.join(named, "key").select("id", "sha1", "group_id"))
    kinds = group_kind(members).where("n > 1").select("group_id", "kind")
    return members.join(kinds, "group_id").select("id", "group_id", "kind")


def review_flags(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, related_id, score: rows in no group whose best pair(id_a, id_b, score) is in none either; for review only, they form no group."""
    ways = [F.struct(F.col(a).alias("id"), F.col(b).alias("related_id")) for a, b in (("id_a", "id_b"), ("id_b", "id_a"))]
    both = pairs.select(F.explode(F.array(*ways)).alias("w"), "score").select("w.*", "score")  # pairs are found once
    known = groups.select("id")
    alone = both.join(known, "id", "left_anti").join(known.withColumnRenamed("id", "related_id"), "related_id", "left_anti")
    return alone.groupBy("id").agg(F.min_by("related_id", F.struct(-F.col("score"), "related_id")).alias("related_id"), F.max("score").alias("score"))


def ranked(items: DataFrame, mode: str = "sha1", limit: int = HAMMING, pairs: DataFrame | Callable[[DataFrame], DataFrame] | None = None, ranges: int | None = None) -> DataFrame:
    """id, group_id, dup_rank, kind, needs_review of items(id, sha1, h, score, filesize, relpath), as export.plan() reads them.

    Groups are those of grouped(); rank 0 is kept: the best score, then the largest file, then the first path
    and id. Ranks are counted by ranges of that order, so one group may hold most of the table. Mode clip
    ranks as phash does; rows of pairs(id_a, id_b, score) that stand in no group come with rank -1, no group and
    needs_review. Rows that are in neither are left out. pairs may be a function of the ids that stand in groups: what
    is in one need not be compared at all.
    """
    groups = saved(grouped(items, "phash" if mode == "clip" else mode, limit))
    members = groups.join(items.select("id", "score", "filesize", "relpath"), "id")
    order = [F.desc("score"), F.desc("filesize"), F.asc("relpath"), F.asc("id")]
    placed = ordered.numbered(members, ["group_id"], order, "dup_rank", ranges)
    out = placed.select("id", F.col("group_id").cast("string").alias("group_id"), F.col("dup_rank").cast("int").alias("dup_rank"), "kind", F.lit(False).alias("needs_review"))
    if mode == "clip" and pairs is not None:
        pairs = pairs(groups.select("id")) if callable(pairs) else pairs
        out = out.unionByName(review_flags(groups, pairs).select("id", F.lit("").alias("group_id"), F.lit(-1).alias("dup_rank"), F.lit("clip").alias("kind"), F.lit(True).alias("needs_review")))
    return out
