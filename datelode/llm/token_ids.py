"""Token-id output: documents as Simple-8b coded segments in ascending doc_id order, and the reader.

Documents are dealt by ranges of (doc_id, hash of the text) and sorted inside a range, so a hot or
null id is split like any other. Each task writes its range as segments of whole documents (about
SEGMENT_IDS ids; a longer document is a segment of its own): doc ids, Simple-8b coded lengths, and
Simple-8b coded ids with an offset table per block. Files are written by Spark's committer, so a lost
task leaves nothing behind. Where a document starts in the whole sequence is the sum of the shards
before it (one number per shard, kept on the driver: bounded by the number of partitions) and its
place inside the shard, which the writer knows.

Null text is empty (only the end id); ids may be of any type that sorts, null ids come first; repeated rows are kept, ordered
by id, then by the hash of their text; other columns are dropped; an empty table gives no segments.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datelode.llm import bpe, simple8b
from datelode.llm.common import parts, scratch_dir, slices

SEGMENT_IDS = 1 << 17
#: Pre-tokens that a worker remembers.
CACHE_ENTRIES = 600_000


class _Numbers(dict):
    """Pre-token -> its number, in order of appearance; new holds those that have no ids yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class ChunkEncoder:
    """Encodes with the tokenizers library; each pre-token is encoded once per worker.

    Texts are lowered and split as the vocabulary's rules say, pre-tokens are numbered, and the ids of all
    are one array with offsets, from which those of many texts are gathered at once. Pre-tokens written with
    blanks between are split into themselves, each ending in a word-end token: many new ones go through the
    library in one call. Texts with special strings or characters beyond the stable ones go through it whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.split = bpe.pretoken_pattern()
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for s, i in vocabulary.items() if s.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids, self.offsets = _Numbers(), np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    @staticmethod
    def odd(text: str) -> bool:
        """Does text hold a special string or a character beyond STABLE, the last one with its first UTF-8 byte?"""
        return "<|" in text or not text.isascii() and np.frombuffer(text.encode(), dtype=np.uint8).max() > bpe.STABLE.encode()[0]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self) -> None:
        """Ids of the new pre-tokens."""
        new, ids, offsets = self.words.new, [self.ids], [self.offsets]
        for k in range(0, len(new), 4000):
            some = new[k : k + 4000]
            ids.append(self._whole(" ".join(some)))
            ends = np.flatnonzero(self.ends[ids[-1]]) + 1
            if len(ends) != len(some):
                raise ValueError(f"{len(some)} pre-tokens have {len(ends)} ends")
            offsets.append(ends + offsets[-1][-1])
        if new:
            self.ids, self.offsets = np.concatenate(ids), np.concatenate(offsets)
            new.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > CACHE_ENTRIES or self.words.new:  # new ones are left where a call broke off
            self._forget()
        number, split = self.words.__getitem__, self.split.findall
        none = np.zeros(0, dtype=np.int64)
        odd = [self.odd(t) for t in texts]
        numbers = [none if o else np.fromiter(map(number, split(t.lower())), dtype=np.int64) for t, o in zip(texts, odd, strict=True)]
        self._learn()
        n = np.concatenate([none, *numbers])
        sizes = self.offsets[n + 1] - self.offsets[n]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        raw = self.ids[np.repeat(self.offsets[n] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[np.cumsum([0, *map(len, numbers)])]).tolist()
        return [self._whole(t).tobytes() if o else raw[a:b] for t, o, a, b in zip(texts, odd, cuts, cuts[1:], strict=False)]


@cache
def _encoder(path: str) -> ChunkEncoder:
    """One a worker process, so that what it remembers serves all its tasks."""
    return ChunkEncoder(path)


_FIELDS = [("shard", pa.int32()), ("segment", pa.int32()), ("shard_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", None), ("lengths", pa.binary()), ("length_offsets", pa.binary()), ("words", pa.binary()), ("offsets", pa.binary())]
_DDL = "shard int, segment int, shard_start long, n_ids long, doc_ids array<{}>, lengths binary, length_offsets binary, words binary, offsets binary"


def write_token_ids(docs: DataFrame, vocabulary: str, path: str, end_id: int) -> None:
    """Write all documents of docs (doc_id, text) as coded segments under path."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("tie", F.crc32("body"))
    rows = rows.repartitionByRange(parts(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard = _encoder(vocabulary), TaskContext.get().partitionId()
        segment = start = size = 0
        ids: list[int | None] = []
        raws: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal segment, start, size, ids, raws
            lengths, length_offsets = simple8b.encode(np.array([len(r) // 4 for r in raws]))
            words, offsets = simple8b.encode(np.frombuffer(b"".join(raws), dtype="<u4"))
            row = [shard, segment, start, size, ids, *(x.astype(x.dtype.newbyteorder("<")).tobytes() for x in (lengths, length_offsets, words, offsets))]
            segment, start, size, ids, raws = segment + 1, start + size, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array([v], t or pa.list_(batch.schema.field("doc_id").type)) for v, (_, t) in zip(row, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])

        for batch in batches:
            for piece in slices(batch, "body"):
                coded = encoder.encode([b.decode("utf-8", "replace") for b in piece.column("body").to_pylist()])
                for doc_id, raw in zip(piece.column("doc_id").to_pylist(), coded, strict=True):
                    raw += end
                    if size and size + len(raw) // 4 > SEGMENT_IDS:
                        yield flush()
                    ids.append(doc_id)
                    raws.append(raw)
                    size += len(raw) // 4
        if ids:
            yield flush()

    rows.drop("tie").mapInArrow(run, _DDL.format(docs.schema["doc_id"].dataType.simpleString())).write.parquet(path)


def read_token_ids(spark, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files; with ids=True also ids (array<long>)."""
    coded = spark.read.parquet(path)
    kind = coded.schema["doc_ids"].dataType.elementType.simpleString()
    totals = {r.shard: r.n for r in coded.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}  # one row a shard
    bases, total = {}, 0
    for shard in sorted(totals):
        bases[shard] = total
        total += totals[shard]
    bases = spark.sparkContext.broadcast(bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = lambda k, kind: np.frombuffer(r[k], dtype=kind)  # noqa: B023, E731
                lengths = simple8b.decode(at("lengths", "<u8"), at("length_offsets", "<u4"), len(r["doc_ids"])).astype(np.int64)
                values = simple8b.decode(at("words", "<u8"), at("offsets", "<u4"), r["n_ids"]).astype("<u4")
                ends = np.cumsum(lengths)
                raw, begins = values.tobytes(), ends - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                out = [pa.array(r["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array(begins + (bases.value[r["shard"]] + r["shard_start"]), pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    out.append(pa.array([values[a:b].astype(np.int64) for a, b in zip(begins, ends, strict=True)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return coded.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def token_ids(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write docs to the shared folder and read the files back."""
    path = scratch_dir(docs.sparkSession)
    write_token_ids(docs, vocabulary, path, end_id)
    return read_token_ids(docs.sparkSession, path)
