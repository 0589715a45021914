"""Benchmark decontamination: an FM-index for each shard of training text, searched for all test phrases.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. A phrase is 10
consecutive words of an item, or the whole of a shorter item with words. Each shard (at most
SHARD_WORDS words, or one longer document) is indexed in the task that reads it, with all its words and
without a look at the test set: words are numbered as they come, and the FM-index is built over those
numbers. Test phrases are then translated to the shard's numbers; backward search
gives the row interval of each phrase, sampled suffix positions place the occurrences, and spans are
merged in each document. Nothing is shuffled for a test set of one block. The driver reads the test
items one after the other into blocks of about PHRASES words; each block is broadcast on its own, and a pass over
the corpus searches BLOCKS of them in the same indexes. A pass is written and its blocks are dropped before those of
the next are read, so what the driver holds and sends is bounded however many test items there are. All
passes search the unchanged text, what they find is joined row by row, and text is cut once.

Null texts have no words: never contaminated, and null items are never found. Item ids that are null
are left out of the list of ids and count as one item. Repeated rows give one output row each; other columns are dropped;
without documents the result is empty, without items no document is hit.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datelode.llm.common import beside, column, doc_bytes, fresh, materialize, slices

WINDOW = 10
SHARD_WORDS = 500_000
#: Phrases searched and broadcast at once.
PHRASES = 500_000
#: Blocks that one pass over the corpus searches, one after the other in each shard's index.
BLOCKS = 8
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isdigit() or 97 <= c <= 122 else 32 for c in range(256))


def words_of(body: bytes) -> list[bytes]:
    return body.translate(_TABLE).split()


class Phrases:
    """Phrases of a block of items: word numbers, patterns by length, and the items of each pattern."""

    def __init__(self, items: list[tuple[int, bytes]], window: int) -> None:
        found: dict[tuple[bytes, ...], set] = {}
        for item, body in items:
            w = words_of(body)
            for k in range(max(1, len(w) - window + 1) if w else 0):
                found.setdefault(tuple(w[k : k + window]), set()).add(item)
        self.numbers = {w: k + 1 for k, w in enumerate(sorted({w for p in found for w in p}))}
        self.by_length = []
        for length in sorted({len(p) for p in found}):
            some = [p for p in found if len(p) == length]
            self.by_length.append((length, np.array([[self.numbers[w] for w in p] for p in some], dtype=np.int64), [list(found[p]) for p in some]))


class Shard:
    """Documents gathered for one index, and the numbers of their words."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        self.docs: list[np.ndarray] = []
        self.total = 0

    def add(self, body: bytes) -> int:
        """Returns the number of words."""
        words = words_of(body)
        self.docs.append(np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int64, count=len(words)))
        self.total += len(words) + 1
        return len(words)

    def hits(self, blocks: Iterable[Phrases]) -> tuple[list[np.ndarray], list[set]]:
        """For each document the hit word places (sorted, unique) and the items found, over all blocks."""
        from datelode.llm.fm_index import FmIndex

        places: list[list[np.ndarray]] = [[] for _ in self.docs]
        items: list[set] = [set() for _ in self.docs]
        if self.total > len(self.docs):
            sizes = np.array([len(d) + 1 for d in self.docs])
            first = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(sizes)), sizes)
            seq = np.zeros(self.total, dtype=np.int64)  # each document is closed by a 0
            seq[np.delete(np.arange(self.total), first + sizes - 1)] = np.concatenate(self.docs)
            index = None
            for phrases in blocks:
                index = index or FmIndex(seq)
                known = np.array([0, *(self.numbers.get(w, 0) for w in phrases.numbers)], dtype=np.int64)  # numbers stand in the order of their words
                for length, patterns, of in phrases.by_length:
                    patterns = known[patterns]
                    here = np.flatnonzero(patterns.all(axis=1))  # a phrase with a word that the shard has not occurs nowhere in it
                    lo, hi = index.search(patterns[here])
                    some = np.flatnonzero(hi > lo)
                    found, lo, hi = here[some], lo[some], hi[some]
                    if not len(found):
                        continue
                    n = hi - lo
                    rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    pattern, start = np.repeat(found, n), index.locate(rows)
                    doc = owner[start]
                    for d, p in np.unique(np.stack([doc, pattern]), axis=1).T.tolist():
                        items[d].update(of[p])
                    by = np.argsort(doc, kind="stable")
                    doc, begin = doc[by], (start - first[doc])[by]
                    cuts = np.flatnonzero(np.diff(doc)) + 1
                    for d, some in zip(doc[np.concatenate([[0], cuts])].tolist(), np.split(begin, cuts), strict=True):
                        places[d].append((some[:, None] + np.arange(length)).ravel())
        merged = [np.unique(np.concatenate(p)) if p else np.zeros(0, dtype=np.int64) for p in places]
        return merged, items


class Sent:
    """Blocks broadcast one by one; a task holds one at a time."""

    def __init__(self, docs: DataFrame, blocks: list[Phrases]) -> None:
        self.each = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks]

    def __iter__(self) -> Iterator[Phrases]:
        for b in self.each:
            yield b.value
            if len(self.each) > 1:
                b.__dict__.pop("_value", None)  # read again from the executor's disk for the next shard


def _scan(docs: DataFrame, blocks: list[Phrases], ddl: str, row) -> DataFrame:
    """Index shard by shard; row(bodies, n_words, places, items) gives the output columns after doc_id."""
    sent = Sent(docs, blocks)
    rows = doc_bytes(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, bodies, n = Shard(), [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal shard, ids, bodies, n
            places, items = shard.hits(sent)
            out = pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("doc_id").type), *row(bodies, n, places, items)], names=["doc_id", *[x.split()[0] for x in ddl.split(", ")]])
            shard, ids, bodies, n = Shard(), [], [], []
            return out

        for batch in batches:
            for piece in slices(batch, "body"):
                for doc_id, body in zip(piece.column("doc_id").to_pylist(), piece.column("body").to_pylist(), strict=True):
                    ids.append(doc_id)
                    bodies.append(body)
                    n.append(shard.add(body))
                    if shard.total >= SHARD_WORDS or len(ids) >= 4000:
                        yield flush()
        if ids:
            yield flush()

    return rows.mapInArrow(run, f"doc_id {kind}, {ddl}")


def phrase_blocks(items: DataFrame, window: int = WINDOW, limit: int = PHRASES) -> Iterator[Phrases]:
    """The test set in blocks of about limit words, made as they are asked for; one at least."""
    some, size = [], 0
    rows = items.select("item_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    for r in rows.toLocalIterator():
        body = bytes(r.body)
        n = len(words_of(body))
        if some and size + n > limit:
            yield Phrases(some, window)
            some, size = [], 0
        some.append((r.item_id, body))
        size += n
    yield Phrases(some, window)


def _passes(items: DataFrame, window: int) -> tuple[list[Phrases], Iterator[list[Phrases]]]:
    """The blocks of the first pass over the corpus, and those of the others, if there are any."""
    each = phrase_blocks(items, window)
    passes = iter(lambda: list(islice(each, BLOCKS)), [])
    return next(passes), passes


def _listed(items) -> str:
    return ",".join(sorted(str(x) for x in items if x is not None))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    blocks, passes = _passes(items, window)
    more = next(passes, None)
    if more is None:

        def row(bodies, n, places, found):
            return [pa.array(n, pa.int64()), pa.array([len(p) for p in places], pa.int64()), pa.array(map(len, found), pa.int64()), pa.array([hashlib.sha256(_listed(x).encode()).hexdigest() for x in found], pa.string()), pa.array([len(p) > 0 for p in places], pa.bool_())]

        return _scan(docs, blocks, "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean", row)

    keyed, row = _keyed(docs.select("doc_id", "text"))
    merged = _found(keyed, row, chain([blocks, more], passes))
    n_words = _scan(keyed.select(F.col(row).alias("doc_id"), "text"), [], "n_words long", lambda bodies, n, places, found: [pa.array(n, pa.int64())])
    joined = keyed.select(row, "doc_id").join(n_words.select(F.col("doc_id").alias(row), "n_words"), row).join(merged, row, "left")
    return joined.select("doc_id", "n_words", F.coalesce(F.size("places").cast("long"), F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("found", ","), F.lit("")), 256).alias("items_sha256"), F.col("places").isNotNull().alias("contaminated"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, written once and for all, and the name of its column."""
    row = fresh(docs, "row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id())), row


def _found(keyed: DataFrame, row: str, passes: Iterable[list[Phrases]]) -> DataFrame:
    """row, places (hit words, sorted), found (item ids as text, sorted), n_items for each row that a block hits."""

    def hit(bodies, n, places, found):
        return [pa.array([p.tolist() for p in places], pa.list_(pa.int64())), pa.array([[None if x is None else str(x) for x in f] for f in found], pa.list_(pa.string()))]

    texts = keyed.select(F.col(row).alias("doc_id"), "text")
    each = [materialize(_scan(texts, blocks, "places array<long>, found array<string>", hit).where(F.size("places") > 0)) for blocks in passes]
    rows = reduce(DataFrame.unionByName, each).groupBy(F.col("doc_id").alias(row))  # bounded by the document's words
    all_ = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    return rows.agg(F.array_sort(all_("places")).alias("places"), all_("found").alias("f")).select(row, "places", F.array_sort(F.filter("f", lambda x: x.isNotNull())).alias("found"), F.size("f").alias("n_items"))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the hit words cut out of the text (from the first word of a merged span to the end of its last), n_chars set anew.

    A row keeps its other columns; a null text without hits becomes empty.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    blocks, passes = _passes(items, window)
    more = next(passes, None)
    if more is None:
        text = _with_columns(docs, blocks, others)
    else:
        keyed, row = _keyed(docs.select(*map(column, others), "text"))
        places = fresh(keyed, "places")
        text = _cut_places(keyed.join(_found(keyed, row, chain([blocks, more], passes)).select(row, F.col("places").alias(places)), row, "left"), others, places)
    text = text.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else text
    return text.select(*map(column, docs.columns))


_WORD = re.compile(rb"[^ ]+")


def _kept(body: bytes, hit: np.ndarray) -> str:
    """The text without the words at places hit (sorted)."""
    if len(hit):
        spans = [m.span() for m in _WORD.finditer(body.translate(_TABLE))]
        kept, at = [], 0
        for run in np.split(hit, np.flatnonzero(np.diff(hit) != 1) + 1):
            kept.append(body[at : spans[run[0]][0]])
            at = spans[run[-1]][1]
        body = b"".join([*kept, body[at:]])
    return body.decode("utf-8", "replace")


def _with_columns(docs: DataFrame, blocks: list[Phrases], others: list[str]) -> DataFrame:
    """others and the text without the words that blocks hit; a shard is what one task holds at once."""
    sent = Sent(docs, blocks)

    def run(bodies: list[bytes]) -> list[pa.Array]:
        shard = Shard()
        for b in bodies:
            shard.add(b)
        places, _ = shard.hits(sent)
        return [pa.array(map(_kept, bodies, places), pa.string())]

    return beside(docs, others, run, "text string")


def _cut_places(rows: DataFrame, others: list[str], places: str) -> DataFrame:
    """others and text for rows(others, text, places), cut at places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "body", 4_000_000):
                texts = [_kept(b, np.array(p, dtype=np.int64)) for b, p in zip(piece.column("body").to_pylist(), piece.column("places").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(others)], pa.array(texts, pa.string())], names=[*(f"c{k}" for k in range(len(others))), "text"])

    safe = [column(c).alias(f"c{k}") for k, c in enumerate(others)]
    kinds = [f"c{k} {rows.schema[c].dataType.simpleString()}" for k, c in enumerate(others)]
    rows = rows.select(*safe, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"), F.coalesce(places, F.array().cast("array<long>")).alias("places"))
    return rows.mapInArrow(run, ", ".join([*kinds, "text string"])).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(others)], "text")
