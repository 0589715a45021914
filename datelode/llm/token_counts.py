"""Token counts: a two-tier lookup on the map side.

Pre-tokens are maximal runs of spaces followed by what comes up to the next space; no piece of such
a vocabulary spans the end of one, so the counts of pre-tokens add up to the count of a text.
Tier 1 is a compact table (UTF-8 blob, ends, counts) of the pre-tokens that a mergeable heavy-hitter
sketch over all documents finds frequent; it is broadcast and its size is bounded by its capacity.
Tier 2 is a cache in each Python worker: what misses tier 1 is encoded once and remembered. Pre-tokens
are never shuffled, only one bounded sketch row per task is; sketches are merged in a tree of tasks, and the
driver gets one.

Null text counts as empty; empty text has no tokens; null ids, repeated rows and extra columns pass
through untouched (one output row per input row); an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datelode.llm.common import doc_bytes, slices

#: Entries of the broadcast table and of each sketch; about 20 bytes an entry.
CAPACITY = 16_384
#: Pre-tokens that a worker's cache holds before it starts afresh.
CACHE_ENTRIES = 300_000
_PRETOKEN = re.compile(r" *[^ ]+| +$")


def pretokens(text: str) -> list[str]:
    """Pre-tokens without the space that stands before each: 'a  b' -> ['a', ' b']."""
    if "▁" in text:
        text = text.replace("▁", " ")
    if text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [p[1:] for p in _PRETOKEN.findall(" " + text)] if text else []


def _merge(counts: Counter, capacity: int) -> Counter:
    """Misra-Gries reduction: subtract the (capacity+1)-th count from all, keep what stays above 0."""
    if len(counts) <= capacity:
        return counts
    values = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    cut = int(np.partition(values, len(values) - capacity - 1)[len(values) - capacity - 1])
    return Counter({k: v - cut for k, v in counts.items() if v > cut})


def _pack(counts: Counter) -> tuple[bytes, bytes, bytes]:
    keys = [k.encode() for k in counts]
    ends = np.cumsum([len(k) for k in keys], dtype=np.int64).astype("<u4") if keys else np.zeros(0, "<u4")
    return b"".join(keys), ends.tobytes(), np.fromiter(counts.values(), dtype="<i8", count=len(keys)).tobytes()


def _unpack(blob: bytes, ends: bytes, counts: bytes) -> Counter:
    at = [0, *np.frombuffer(ends, "<u4").tolist()]
    return Counter({blob[a:b].decode(): c for a, b, c in zip(at, at[1:], np.frombuffer(counts, "<i8").tolist(), strict=False)})


_SKETCH = pa.schema([("slot", pa.int32()), ("blob", pa.binary()), ("ends", pa.binary()), ("counts", pa.binary())])


def frequent_pretokens(docs: DataFrame, capacity: int = CAPACITY, fan_in: int = 32) -> Counter:
    """Heavy hitters over every document; error of a count at most total / capacity."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: Counter = Counter()
        for batch in batches:
            for piece in slices(batch, "body"):
                for body in piece.column("body").to_pylist():
                    total.update(pretokens(body.decode("utf-8", "replace")))
                if len(total) > 12 * capacity:
                    total = _merge(total, capacity)
        row = _pack(_merge(total, capacity))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *(pa.array([x], pa.binary()) for x in row)], schema=_SKETCH)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, any_ = Counter(), False
        for batch in batches:
            for k in range(batch.num_rows):
                total, any_ = _merge(total + _unpack(*(batch.column(c)[k].as_py() for c in ("blob", "ends", "counts"))), capacity), True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *(pa.array([x], pa.binary()) for x in _pack(total))], schema=_SKETCH)

    schema = "slot int, blob binary, ends binary, counts binary"
    rows = doc_bytes(docs).select("body").mapInArrow(sketch, schema)
    left = rows.rdd.getNumPartitions()
    while True:  # a tree of merges: one sketch is held at a time, and about fan_in of them meet in a task
        left = max(1, -(-left // fan_in))
        rows = rows.repartition(left, F.pmod("slot", F.lit(left))).mapInArrow(merge, schema)
        if left <= 1:
            break
    found = rows.collect()  # one row, none without documents
    return _unpack(*(bytes(x) for x in (found[0].blob, found[0].ends, found[0].counts))) if found else Counter()


def piece_counts(model, words: list[str]) -> list[int]:
    """Pieces of each pre-token; the empty one is a lone space at the end of a text, one piece."""
    return [len(x) if w else 1 for w, x in zip(words, model.encode(words, num_threads=1), strict=True)]


class PieceCounter:
    """Both tiers; used inside a Python worker."""

    def __init__(self, model_path: str, table: tuple[bytes, bytes, bytes]) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.cache: dict[str, int] = {}
        self.table = _Tiers(_unpack(*table), self.cache)

    def of(self, texts: list[str]) -> list[int]:
        split = [pretokens(t) for t in texts]
        table, cache = self.table, self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        new = list({w for words in split for w in words if w not in table and w not in cache})
        if new:
            cache.update(zip(new, piece_counts(self.model, new), strict=True))
        return [sum(map(table.__getitem__, words)) for words in split]


class _Tiers(dict):
    """The broadcast table, with the worker's cache behind it."""

    def __init__(self, first: dict, second: dict) -> None:
        super().__init__(first)
        self.second = second

    def __missing__(self, key: str) -> int:
        return self.second[key]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs."""
    spark = docs.sparkSession
    top = sorted(frequent_pretokens(docs, capacity))
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    table = spark.sparkContext.broadcast(_pack(Counter(dict(zip(top, piece_counts(model, top), strict=True))))) if top else spark.sparkContext.broadcast(_pack(Counter()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model_path, table.value)
        for batch in batches:
            for piece in slices(batch, "body"):
                bodies = piece.column("body").to_pylist()
                n = counter.of([b.decode("utf-8", "replace") for b in bodies])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(map(len, bodies), pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = doc_bytes(docs)
    out = rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))

