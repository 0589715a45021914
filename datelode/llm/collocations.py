"""Phrase collocations per language.

Texts are lower-cased (A-Z), split at [.,;:!?] and line ends into pieces, and pieces at blanks and tabs
into words. All contiguous phrases of one word, of two, up to max_n become rows (lang, phrase, c), hash
aggregated to a = f(phrase). Phrases of two words or more with a >= min_count are candidates. One that
stands inside a candidate of one word more with 100 * f(longer) >= cover * a is dropped by an anti-join
(what stands inside a still longer one with that share stands inside one of one word more, too, as that
occurs at least as often). The rest are cut after each word, prefix and suffix counts l and r joined,
scored floor(1000000 * a * a / (l * r)) in Decimal(38), and take the lowest cut, the first of equal ones.
Each language's best `top` are numbered by windows: first within SALTS shares of a language, then over
what these leave, so that no task sorts a language.

Phrases are exploded level by level. A phrase occurs no more often than its first and last n-1 words do,
so level n leaves out places where one of these stays below min_count. A Bloom filter tells: its size
is bounded (MAX_BITS), what it wrongly lets through is counted like the rest and falls to min_count, so
results are the same with a full filter and with none (prune=False), only the shuffle grows. A task
explodes slices of SLICE_BYTES of one language, counts equal phrases of a slice before they become
rows, and windows of at most WINDOW words keep memory flat in texts of any length.

Null text is empty; null lang is `und`; the empty language is one of its own. Repeated rows count
each time; other columns are not read; an empty table, or one without candidates, gives no rows. Ties
go by score and a descending, then the phrase in UTF-8 byte order, so ranks are 1, 2, 3 without gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datelode.llm.common import materialize, slices

MAX_N, MIN_COUNT, TOP, COVER = 3, 10, 2000, 50
#: Bytes of text exploded at once, and words of a window.
SLICE_BYTES, WINDOW = 4_000_000, 2_000_000
#: Bits of a filter for one frequent phrase, bits at most (16 MB), probes.
ITEM_BITS, MAX_BITS, PROBES = 12, 1 << 27, 4
SALTS = 64
_BLOCK = 1 << 15  # bits of a row that goes to the driver
_NEWLINE, _BLANK = 10, 32
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_COUNT = "lang string, phrase string, c long"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def folded(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n neighbours."""
    out = hashes[: len(hashes) - n + 1]
    for k in range(1, n):
        out = _mixed(out * _ODD + hashes[k : len(hashes) - n + 1 + k])
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def spots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of a filter for each hash."""
    step = _mixed(h) | np.uint64(1)
    return [(h + np.uint64(k) * step) % np.uint64(bits) for k in range(PROBES)]


def holds(packed: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), dtype=bool)
    for at in spots(h, 8 * len(packed)):
        found &= (packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


class Slice:
    """The words of some text: number, dictionary and piece of each."""

    def __init__(self, body: bytes) -> None:
        letters = np.frombuffer(body.translate(_TABLE), dtype=np.uint8)
        line = letters == _NEWLINE
        gap = line | (letters == _BLANK)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
        self.start, end = edge[::2], edge[1::2]
        self.piece = np.cumsum(line, dtype=np.int32)[self.start]
        self.letters = letters[~gap]
        self.offset = np.concatenate(([0], np.cumsum(end - self.start)))

    def windows(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
        """(numbers, pieces, dictionary) of WINDOW places each, with the n - 1 words behind them."""
        for a in range(0, len(self.start), WINDOW):
            b = min(a + WINDOW + n - 1, len(self.start))
            offset = (self.offset[a : b + 1] - self.offset[a]).astype(np.int32)
            letters = self.letters[self.offset[a] : self.offset[b]]
            coded = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offset), pa.py_buffer(letters)]).dictionary_encode()
            yield coded.indices.to_numpy().astype(np.int64), self.piece[a:b], coded.dictionary


def phrases(words: np.ndarray, piece: np.ndarray, dictionary: pa.Array, n: int, packed: np.ndarray | None) -> tuple[pa.Array, np.ndarray]:
    """Different phrases of n words and how often each occurs."""
    if n == 1:
        return dictionary, np.bincount(words, minlength=len(dictionary))
    if len(words) < n:
        return dictionary.slice(0, 0), np.zeros(0, dtype=np.int64)
    good = piece[: len(piece) - n + 1] == piece[n - 1 :]
    if packed is not None:
        part = holds(packed, folded(word_hashes(dictionary.to_pylist())[words], n - 1))
        good &= part[:-1] & part[1:]
    at = np.flatnonzero(good)
    code = words[at]
    for k in range(1, n):
        if k > 1:  # numbers below the window's places, so that the next product fits
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(dictionary) + words[at + k]
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    at = at[first]
    return pc.binary_join_element_wise(*[dictionary.take(pa.array(words[at + k])) for k in range(n)], b" "), counts


def exploded(docs: DataFrame, n: int, packed: bytes | None = None) -> DataFrame:
    """Rows (lang, phrase, c) of all phrases of n words, counted within a slice; packed: a filter of frequent phrases of n - 1 words."""
    kept = docs.sparkSession.sparkContext.broadcast(packed)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if kept.value is None else np.frombuffer(kept.value, dtype=np.uint8)
        for batch in batches:
            for rows in slices(batch, "body", SLICE_BYTES):
                by_lang: dict[str, list[bytes]] = {}
                for lang, body in zip(rows.column("lang").to_pylist(), rows.column("body").to_pylist(), strict=True):
                    by_lang.setdefault(lang, []).append(body)
                for lang, bodies in by_lang.items():
                    for window in Slice(b"\n".join(bodies)).windows(n):
                        phrase, c = phrases(*window, n, bits)
                        for k in range(0, len(c), 100_000):
                            some = phrase.slice(k, 100_000).cast(pa.string())
                            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), some, pa.array(c[k : k + 100_000], pa.int64())], names=["lang", "phrase", "c"])

    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    return rows.mapInArrow(work, _COUNT)


def counted(rows: DataFrame) -> DataFrame:
    """(lang, phrase, a): occurrences of each phrase."""
    return rows.groupBy("lang", "phrase").agg(F.sum("c").alias("a"))


def bloom(frequent: DataFrame, n: int, items: int) -> bytes:
    """A filter of the frequent phrases of n words, made in tasks; at most MAX_BITS / 8 bytes come to the driver."""
    bits = -(-min(max(ITEM_BITS * items, _BLOCK), MAX_BITS) // _BLOCK) * _BLOCK

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = b" ".join(batch.column("phrase").to_pylist()).split(b" ")  # n words a row
            h = folded(word_hashes(words), n)[::n] if words != [b""] else np.zeros(0, np.uint64)
            at = np.concatenate(spots(h, bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["word", "bit"])

    def packed(table: pa.Table) -> pa.Table:  # at most _BLOCK / 64 rows
        out = np.zeros(_BLOCK // 64, dtype="<i8")
        word = table.column("word").to_numpy()
        out[word % len(out)] = table.column("bits").to_numpy()
        return pa.table({"block": [int(word[0]) // len(out)], "bits": [out.tobytes()]})

    words = frequent.select(F.col("phrase").cast("binary").alias("phrase")).mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = bytearray(bits // 8)
    for r in words.groupBy(F.expr(f"word div {_BLOCK // 64}")).applyInArrow(packed, "block long, bits binary").collect():
        out[r.block * _BLOCK // 8 : (r.block + 1) * _BLOCK // 8] = r.bits
    return bytes(out)


def levels(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, prune: bool = True) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) with all words counted, and (lang, phrase, a) with a >= min_count for one word, two, up to max_n."""
    words = materialize(counted(exploded(docs, 1)))
    found = [words.where(F.col("a") >= min_count)]
    for n in range(2, max_n + 1):
        items = found[-1].count() if prune else 0
        packed = bloom(found[-1], n - 1, items) if prune else None
        found.append(materialize(counted(exploded(docs, n, packed)).where(F.col("a") >= min_count)))
    return words.groupBy("lang").agg(F.sum("a").alias("n")), found


def uncovered(found: list[DataFrame], cover: int = COVER) -> list[DataFrame]:
    """The candidates, by length, that no candidate of one word more stands for."""
    out = []
    for n in range(2, len(found) + 1):
        rows = found[n - 1]
        if n < len(found):
            inside = F.explode(F.array(F.substring_index("phrase", " ", n), F.substring_index("phrase", " ", -n)))
            longer = found[n].select("lang", inside.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
            c, x = rows.alias("c"), longer.alias("x")
            rows = c.join(x, (F.col("c.lang") == F.col("x.lang")) & (F.col("c.phrase") == F.col("x.phrase")) & (100 * F.col("x.most") >= cover * F.col("c.a")), "left_anti")
        out.append(rows)
    return out


def scored(found: list[DataFrame], candidates: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the lowest-scoring cut; exact while 1000000 * a * a has 38 digits at most."""
    cuts = None
    for n, rows in enumerate(candidates, 2):
        cut = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.substring_index("phrase", " ", k).alias("first"), F.substring_index("phrase", " ", k - n).alias("rest")) for k in range(1, n)]))
        some = rows.select("lang", "phrase", "a", cut.alias("cut")).select("lang", "phrase", "a", "cut.*")
        cuts = some if cuts is None else cuts.union(some)
    parts = found[0]
    for rows in found[1:-1]:
        parts = parts.union(rows)
    joined = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"]).join(parts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    joined = joined.withColumns({"x": F.lit(1_000_000).cast("decimal(38,0)") * wide("a") * wide("a"), "y": wide("l") * wide("r")}).withColumn("score", F.expr("x div y"))
    return joined.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def ranked(scores: DataFrame, top: int = TOP) -> DataFrame:
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = scores.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("share")


def collocations(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, top: int = TOP, cover: int = COVER, prune: bool = True) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the top phrases of each language of docs(text, lang)."""
    totals, found = levels(docs, max_n, min_count, prune)
    scores = materialize(scored(found, uncovered(found, cover)))
    return ranked(scores, top).join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
