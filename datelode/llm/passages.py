"""Passages: runs of WORDS words that also start somewhere else, in the same text or another.

A byte rule of 400 leaves shorter passages alone, so these are counted in words, `[^\\x20\\x09-\\x0D]+`;
the white space between them is not compared. As in suffix_dedup, content alone decides where texts are
parsed, so equal content is parsed alike whatever stands before it:

1. Each window of WORDS words has a core, that of its runs of CORE words with the least hash (by 40 bits, the
   first such). Equal windows have equal cores. Neighbouring windows share theirs, so a core stands for a range of
   windows, about one in 16 words. If the core is unique in the corpus, so are its windows.
2. If the words of the whole range occur twice with that core, all its windows do.
3. The windows of the other ranges, and of one range of each class of equal ones whose core such a
   range has, are compared by a 128-bit hash.

Hashes of runs are differences of prefix sums of two polynomials modulo 2**64 over 64-bit word hashes,
and so are those of words over their bytes; words of more than LONG bytes go through XXH3.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datelode.llm.common import materialize, slices
from datelode.llm.suffix_dedup import _known, _runs

WORDS = 50
CORE = 20
_BASES = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B)  # both 3 modulo 8
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HIGH, _LOW = np.uint64(2**64 - 2**24), np.uint64(2**24 - 1)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
SLICE = 500_000  # bytes of text handled at once
SALTS = 1023  # ways that rows of a locally known core or window are spread: many to a task, so tasks get about as many
LONG = 32  # words of more bytes are hashed one by one


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


_BYTES = _mixed(_mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASES[1])))


@cache
def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


class Runs:
    """Hashes of the runs of some 64-bit values, as differences of prefix sums."""

    def __init__(self, values: np.ndarray, base: int) -> None:
        n = len(values)
        up, self.down = (_powers(b, 2 * SLICE)[:n] if n <= 2 * SLICE else _powers.__wrapped__(b, n) for b in (base, pow(base, -1, 1 << 64)))
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * up, out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The hash of the values from each a to each b."""
        return (self.sums[b] - self.sums[a]) * self.down[a]


class Texts:
    """The words of some texts one behind the other: those of text k from start[k] to start[k + 1]."""

    def __init__(self, bodies: list[bytes]) -> None:
        joined = b"\n".join(bodies)
        x = np.frombuffer(joined, dtype=np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[x], [True]])))
        a, b = edges[::2], edges[1::2]
        self.start = np.searchsorted(a, np.concatenate([[0], np.cumsum([len(y) + 1 for y in bodies])]))
        h = Runs(_BYTES[x], _BASES[0])(a, b) if len(a) else np.zeros(0, dtype=np.uint64)
        for k in np.flatnonzero(b - a > LONG).tolist():
            h[k] = _long(joined[a[k] : b[k]])
        h = _mixed(h)
        self.sums = (Runs(h, _BASES[0]), Runs(_mixed(h + np.uint64(1)), _BASES[1]))

    def hashes(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The k-th hash of the words from each a to each b."""
        return self.sums[k](a, b)


def _long(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def ranges(texts: Texts, words: int, core: int) -> tuple[np.ndarray, ...]:
    """text, a, n, at: windows a..a+n-1 of a text share the core at that place; places count from its first word."""
    total, width = int(texts.start[-1]), words - core + 1
    if total < words:
        return (np.zeros(0, dtype=np.int64),) * 4
    a = np.arange(total - core + 1)
    g = texts.hashes(0, a, a + core) & _HIGH  # the other bits hold the place in a block
    best, block = np.empty(total - words + 1, dtype=np.int64), 1 << 15
    for s in range(0, len(best), block):
        least = g[s : s + block + width - 1]
        least = least | np.arange(len(least), dtype=np.uint64)
        span = 1  # the least of span runs from each place; the first of equals
        while span < width:
            step = min(span, width - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        best[s : s + block] = (least & _LOW).view(np.int64) + s
    text = np.repeat(np.arange(len(texts.start) - 1), np.diff(texts.start))[: len(best)]
    at = np.flatnonzero(np.arange(len(best)) + words <= texts.start[text + 1])  # windows that end in their text
    text, best = text[at], best[at]
    new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (text[1:] != text[:-1])])) if len(at) else at
    n = np.diff(np.append(new, len(at)))
    first = texts.start[text[new]]
    return text[new], at[new] - first, n, best[new] - first


def _cores(bodies: DataFrame, words: int, core: int) -> DataFrame:
    """row, a, n, tag, g (hash of the core), e (hash of all words of the range)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "body", SLICE):
                texts = Texts(piece.column("body").to_pylist())
                text, a, n, at = ranges(texts, words, core)
                if not len(text):
                    continue
                first = texts.start[text]
                g = texts.hashes(0, first + at, first + at + core).view(np.int64)
                e = np.maximum(texts.hashes(1, first + a, first + a + n - 1 + words), np.uint64(1)).view(np.int64)
                row = piece.column("row").to_numpy()[text]
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(a, pa.int32()), pa.array(n, pa.int32()), *map(pa.array, (_known(g, e, SALTS), g, e))], names=["row", "a", "n", "tag", "g", "e"])

    return bodies.mapInArrow(run, "row long, a int, n int, tag int, g long, e long")


def _windows(bodies: DataFrame, compare: DataFrame, words: int) -> DataFrame:
    """row, a, tag, g, e: a 128-bit hash (g, e) of each window that is compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "body", SLICE):
                texts = Texts(piece.column("body").to_pylist())
                a, n = (np.concatenate([x.values.to_numpy() for x in piece.column(c)]).astype(np.int64) for c in ("a", "n"))
                text = np.repeat(np.arange(piece.num_rows), [len(x) for x in piece.column("a")])
                place = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
                text = np.repeat(text, n)
                at = texts.start[text] + place
                g = texts.hashes(0, at, at + words).view(np.int64)
                e = np.maximum(texts.hashes(1, at, at + words), np.uint64(1)).view(np.int64)
                row = piece.column("row").to_numpy()[text]
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(place, pa.int32()), *map(pa.array, (_known(g, e, SALTS), g, e))], names=["row", "a", "tag", "g", "e"])

    return bodies.join(compare, "row").select("row", "body", "a", "n").mapInArrow(run, "row long, a int, tag int, g long, e long")


def passages(bodies: DataFrame, words: int = WORDS, core: int = CORE) -> DataFrame:
    """row, n_passages (maximal runs), n_passage_words of the texts that have any; bodies are row and body, and rows differ."""
    seen = materialize(_runs(_cores(bodies, words, min(core, words)), 1))
    alone = seen.where("NOT whole")
    stands = seen.where("whole AND first").join(alone.select("g").distinct().hint("merge"), "g", "left_semi")
    compare = alone.select("row", "a", "n").union(stands.select("row", "a", "n"))
    compare = compare.groupBy("row").agg(F.collect_list(F.struct("a", "n")).alias("x")).select("row", "x.a", "x.n")  # bounded by the document
    found = _runs(_windows(bodies, compare, words), 2).select("row", "a", (F.col("a") + words).alias("b"))
    runs = seen.where("whole").select("row", "a", (F.col("a") + F.col("n") - 1 + words).alias("b")).union(found)
    runs = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("x"))  # bounded by the document
    done = F.aggregate(
        "x",
        F.struct(F.lit(0).cast("long").alias("runs"), F.lit(0).cast("long").alias("words"), F.lit(-1).alias("end")),
        lambda s, x: F.struct(
            (s["runs"] + F.when(x["a"] > s["end"], 1).otherwise(0)).alias("runs"),
            (s["words"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("words"),
            F.greatest(s["end"], x["b"]).alias("end"),
        ),
    )
    return runs.select("row", done.alias("x")).select("row", F.col("x.runs").alias("n_passages"), F.col("x.words").alias("n_passage_words"))
