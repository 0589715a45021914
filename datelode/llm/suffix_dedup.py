"""Exact substring dedup by prefix-free parsing.

Removed is each byte covered by a LENGTH-byte string that also starts somewhere else (or, with
by_words, each word covered by that many consecutive words that also start somewhere else: a text is
then the sequence of its words' 32-bit hashes, and strings start at words only). The text is
parsed by a rolling hash (the 8 bytes as a base-256 polynomial modulo 2**64, scaled): a place where it
is below a bound is a trigger, so equal content has equal triggers whatever stands before it. A phrase runs from one trigger to the next; the first starts
with the document. Which suffixes of the corpus agree in their first LENGTH bytes is decided in three
steps, each a class of equal suffixes kept as 64-bit hashes instead of a sorted list (only classes are
needed here, not the order between different ones):

1. dictionary: for each phrase a key of the content from its trigger over CORE bytes to the next
   trigger. A suffix that starts in phrase i and reaches LENGTH bytes holds the key content of the
   phrases behind it; if one of those is unique in the corpus, so is the suffix. Most of a corpus
   ends here.
2. parse: a phrase together with the bytes that its last suffix needs (a 64-bit key of its own beside
   the first, so a first key that many different phrases share does not weaken the comparison). If it
   occurs twice, every suffix that starts in the phrase does.
3. corpus: the suffixes that neither step decides, at the ends of repeats, are compared by a 128-bit
   hash of their LENGTH bytes.

Keys are dealt by hash and equal ones stream by in sorted order, so a hot key costs no memory; rows
whose answer their own task knows are salted, so it costs no time in one task either. Texts travel zstd-compressed. Rows are told apart by an id of their own, so repeated rows and null ids are
distinct documents (and repeat each other). Null text is empty: nothing removed. Other columns are
dropped by the report and kept by removed(); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datelode.llm.common import column, fresh, materialize, numbered, parts, slices

LENGTH = 400
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Unit:
    """What a text is to the parser: bytes, or words of 4 bytes each. All measures are in bytes."""

    length: int = LENGTH  # of a string that is removed where it repeats
    step: int = 1  # between places where a string may start
    spacing: int = 40  # places from one trigger to the next, on average
    core: int = 48  # least content of a dictionary key

    def symbols(self, body: bytes) -> bytes:
        return body if self.step == 1 else np.fromiter(map(_word_hashes().__getitem__, body.split()), dtype="<u4").tobytes()

    def spans(self, body: bytes, a: list[int], b: list[int]) -> list[tuple[int, int]]:
        """Places in body of the symbols from each a to each b; words take the white space behind them along."""
        if self.step == 1:
            return list(zip(a, b, strict=True))
        at = [*(m.start() for m in _WORD.finditer(body)), len(body)]
        return [(at[x // self.step], at[y // self.step]) for x, y in zip(a, b, strict=True)]


def words_unit(words: int) -> Unit:
    """Strings of that many words; a trigger each 6 words, keys of 8 words."""
    return Unit(4 * words, 4, 6, 32)


class _Hashes(dict):
    """Word -> 32-bit hash, remembered while there is room."""

    ROOM = 200_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        got = xxhash.xxh32_intdigest(word)
        if len(self) < self.ROOM:
            self[word] = got
        return got


@cache
def _word_hashes() -> _Hashes:
    """One a worker process."""
    return _Hashes()


def triggers(body: np.ndarray, unit: Unit = Unit()) -> np.ndarray:  # noqa: B008
    """Places whose next 8 bytes hash below 2**64 / spacing."""
    n = (len(body) - 8) // unit.step + 1
    if len(body) < 8:
        return np.zeros(0, dtype=np.int64)
    h = np.lib.stride_tricks.as_strided(body, (n, 8), (unit.step, 1)).copy().view("<u8").ravel()
    h *= _MULTIPLIER
    h ^= h >> np.uint64(29)
    h *= _MULTIPLIER
    return np.flatnonzero(h < np.uint64((1 << 64) // unit.spacing)) * unit.step


class Parse:
    """Phrases of the symbols of one text of at least the unit's length."""

    def __init__(self, body: bytes, unit: Unit = Unit()) -> None:  # noqa: B008
        n, length = len(body), unit.length
        t = triggers(np.frombuffer(body, dtype=np.uint8), unit)
        self.start = t if len(t) and t[0] == 0 else np.concatenate([[0], t])
        self.next = np.concatenate([self.start[1:], [n]])  # where the phrase ends
        self.last = np.minimum(self.next, n - length + unit.step)  # behind the last suffix of the phrase that has length bytes
        self.live = self.last > self.start
        self.end = np.where(self.live, np.minimum(n, self.next - unit.step + length), self.start)  # what its suffixes need
        k = np.searchsorted(self.start, self.start + unit.core)  # the first trigger that many bytes on
        self.core = np.where(k < len(self.start), self.start[np.minimum(k, len(self.start) - 1)], n + 1)
        #: How many phrases behind this one have their key content, and the trigger behind it, in every suffix of it.
        self.guards = np.searchsorted(self.core, self.start + length - 8, side="right") - 1 - np.arange(len(self.start))
        self.guards = np.maximum(self.guards, 0)


#: Ways that rows of a locally known key are spread.
SALTS = 63


def _known(g: np.ndarray, e: np.ndarray, salts: int = SALTS) -> np.ndarray:
    """What one task sees of its own keys, as tag: known (1: g occurs twice, 2: g and e do) + 4 * salt.

    The first row of each (g, e) has salt 0 and goes where all of its key meet; the others already know
    their answer and are spread, so a hot key sends one row a slice to its own task.
    """
    order = np.lexsort((e, g))
    g, e = g[order], e[order]
    up = np.concatenate([[False], g[1:] == g[:-1]])
    same = np.concatenate([[False], up[1:] & (e[1:] == e[:-1])])
    known = (up | np.append(up[1:], False)) + 2 * ((same | np.append(same[1:], False)) & (e != 0))
    tag = np.empty(len(g), dtype=np.int32)
    tag[order] = known + 4 * np.where(same, 1 + np.arange(len(g)) % salts, 0)
    return tag


def _phrases(rows: DataFrame, unit: Unit) -> DataFrame:
    """For each phrase: row, k (its number), at and n (the places at..at+n-1 where suffixes start in it), need (guards of the phrase before it; -1 if no suffix starts there), g (dictionary key), e (parse key; 0 if no suffix starts in it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hash64 = xxhash.xxh3_64_intdigest
        for batch in batches:
            for piece in slices(batch, "body", 1_000_000):
                ids, out = [], []
                for row, body in zip(piece.column("row").to_pylist(), piece.column("body").to_pylist(), strict=True):
                    body = unit.symbols(body)
                    if len(body) < unit.length:
                        continue
                    p = Parse(body, unit)
                    view = memoryview(body)
                    e = np.array([hash64(view[a:b]) if b > a else 0 for a, b in zip(p.start.tolist(), p.end.tolist(), strict=True)], dtype=np.uint64)
                    whole = p.core + 8 <= np.where(p.live, p.end, len(body))
                    g = np.array([hash64(view[a:b]) if ok else x for a, b, x, ok in zip(p.start.tolist(), p.core.tolist(), e.tolist(), whole.tolist(), strict=True)], dtype=np.uint64)
                    full = np.where(p.live, np.maximum(e, np.uint64(1)), np.uint64(0))  # 0 stays for phrases without suffixes
                    need = np.concatenate([[-1], np.where(p.live, p.guards, -1)[:-1]])
                    keep = whole | p.live
                    ids.append(np.full(int(keep.sum()), row))
                    out.append([x[keep] for x in (np.arange(len(keep)), p.start, np.maximum(p.last - p.start, 0), need, g.view(np.int64), full.view(np.int64))])
                if ids:
                    *columns, g, e = (np.concatenate(x) for x in zip(*out, strict=True))
                    columns += [_known(g, e), g, e]
                    kinds = (*[pa.int32()] * 5, pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["row", "k", "at", "n", "need", "tag", "g", "e"])

    return rows.mapInArrow(run, "row long, k int, at int, n int, need int, tag int, g long, e long")


def _runs(rows: DataFrame, keys: int) -> DataFrame:
    """Rows whose g occurs twice (keys 2: g and e), with whole (g and e do) and first (of its equals).

    The last columns of rows are tag, g, e. Sorted runs are told apart as they stream by, so a hot
    key costs no memory.
    """
    dealt = rows.repartition(parts(rows.sparkSession), F.col("g"), F.shiftright("tag", 2)).sortWithinPartitions("g", "e", "tag")
    names = [c for c in dealt.columns if c not in ("tag", "e")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None  # the last row, whose run may go on, and the keys of the row before it

        def told(columns, last: bool) -> pa.RecordBatch:
            tag, g, e = columns[-3:]
            known, salt = tag & 3, tag >> 2
            up = np.concatenate([[before is not None and before[0] == g[0]], g[1:] == g[:-1]])
            same = np.concatenate([[before is not None and before == (g[0], e[0])], up[1:] & (e[1:] == e[:-1])])
            n = len(g) if last else len(g) - 1
            whole = ((same | np.append(same[1:], False)) & (e != 0) | (known > 1))[:n]
            pick = (up | np.append(up[1:], False) | (known > 0))[:n] if keys == 1 else whole
            first = (~same & (salt == 0))[:n]
            return pa.RecordBatch.from_arrays([pa.array(x[:n][pick]) for x in (*columns[:-3], g)] + [pa.array(whole[pick]), pa.array(first[pick])], names=[*names, "whole", "first"])

        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            if not len(now[0]):
                continue
            now = now if held is None else [np.concatenate([h, x]) for h, x in zip(held, now, strict=True)]
            yield told(now, last=False)
            if len(now[0]) > 1:
                before = (now[-2][-2], now[-1][-2])
            held = [x[-1:] for x in now]
        if held is not None:
            yield told(held, last=True)

    ddl = ", ".join(f"{c} {dealt.schema[c].dataType.simpleString()}" for c in names)
    return dealt.mapInArrow(run, f"{ddl}, whole boolean, first boolean")


def _repeated_phrases(phrases: DataFrame) -> DataFrame:
    """row, k, at, n, need, g, whole, first for phrases whose dictionary key occurs twice: one exchange by that key, which equal parse keys share."""
    return _runs(phrases, 1)


def _marks(flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, a, b): places a..b-1 whose suffixes the parse step decides; (row, compare): phrases whose suffixes must be compared.

    Open is a phrase that the parse step leaves undecided although all keys that guard it are repeated,
    if any do; one without guards is compared in any case. Its partner may be a decided phrase; so of each
    class of decided phrases the first is compared as well where the repeated key behind it follows an
    open phrase anywhere.
    """
    w = Window.partitionBy("row").orderBy("k")  # both windows are bounded by the document
    seen = flags.select("*", (F.col("k") - F.row_number().over(w)).alias("island"), (F.lag("k").over(w) == F.col("k") - 1).alias("near"), F.lag("whole").over(w).alias("w"), F.lag("first").over(w).alias("f"))
    reach = F.max("k").over(Window.partitionBy("row", "island"))
    decided = F.coalesce(F.col("near") & F.col("w"), F.lit(False))
    seen = seen.select("row", "k", "at", "n", "g", "whole", (decided & F.col("f")).alias("stands"), ((F.col("need") >= 0) & ~decided & (reach >= F.col("k") + F.col("need") - 1)).alias("open"))
    seen = materialize(seen.where("whole OR stands OR open"))
    keys = seen.where("open").select("g").distinct()
    compared = seen.where("open").select("row", "k").union(seen.where("stands").join(keys.hint("merge"), "g", "left_semi").select("row", "k"))
    compared = compared.groupBy("row").agg(F.collect_list(F.col("k") - 1).alias("compare"))  # bounded by the document
    return seen.where("whole").select("row", F.col("at").alias("a"), (F.col("at") + F.col("n")).alias("b")), compared


def _packed(rows: DataFrame) -> DataFrame:
    """row and the zstd-compressed body, for texts of any length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            for piece in slices(batch, "body"):
                yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array([z.compress(b) for b in piece.column("body").to_pylist()], pa.binary())], names=["row", "packed"])

    return rows.mapInArrow(run, "row long, packed binary")


def _unpack(batch: pa.RecordBatch) -> Iterator[bytes]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    for x in batch.column("packed"):
        yield z.decompress(x.as_py())


def _compared(texts: DataFrame, compare: DataFrame, unit: Unit) -> DataFrame:
    """row, a, tag, g, e: a 128-bit hash (g, e) of the unit's length from each place a that is compared."""
    joined = texts.join(compare, "row", "left").select("row", "packed", "compare")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hash128 = xxhash.xxh3_128_digest
        for batch in batches:
            rows, places, keys, size = [], [], [], 0

            def out() -> pa.RecordBatch:
                nonlocal rows, places, keys, size
                h = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)  # noqa: B023
                g, e = h[:, 0], h[:, 1] | 1  # 0 would say that there is no key
                made = pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows), pa.int64()), pa.array(np.concatenate(places), pa.int32()), *map(pa.array, (_known(g, e), g, e))], names=["row", "a", "tag", "g", "e"])  # noqa: B023
                rows, places, keys, size = [], [], [], 0
                return made

            for row, body, compare in zip(batch.column("row").to_pylist(), _unpack(batch), batch.column("compare"), strict=True):
                body = unit.symbols(body)
                if len(body) < unit.length:
                    continue
                p = Parse(body, unit)
                left = p.live & (p.guards == 0)  # no key guards these
                if compare.is_valid:
                    left[compare.values.to_numpy()] = True
                    left &= p.live
                if left.any():
                    view = memoryview(body)
                    at = np.concatenate([np.arange(a, b, unit.step) for a, b in zip(p.start[left].tolist(), p.last[left].tolist(), strict=True)])
                    rows.append(np.full(len(at), row))
                    places.append(at)
                    keys.append(b"".join([hash128(view[k : k + unit.length]) for k in at.tolist()]))
                    size += len(at)
                if size > 100_000:
                    yield out()
            if size:
                yield out()

    return joined.mapInArrow(run, "row long, a int, tag int, g long, e long")


def repeated_starts(rows: DataFrame, texts: DataFrame, unit: Unit) -> DataFrame:
    """row, spans: for each text with repeats the runs [a, b) of places where a repeated string starts."""
    decided, compare = _marks(_repeated_phrases(_phrases(rows, unit)))
    suffixes = _compared(texts, compare, unit)
    found = _runs(suffixes, 2)
    spans = decided.union(found.select("row", "a", (F.col("a") + unit.step).alias("b")))
    return spans.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # bounded by the document


def _removal(a: list[int], b: list[int], unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs from the runs of start places."""
    a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64) - unit.step + unit.length
    by = np.argsort(a, kind="stable")
    a, b = a[by], np.maximum.accumulate(b[by])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return a[new], b[np.append(new[1:], True)]


def _cut(docs: DataFrame, unit: Unit, keep: list[str], ddl: str, row, beside=None) -> tuple[DataFrame, DataFrame, str]:
    """Join each text with its repeats; row(bodies, spans) gives the output columns after keep, beside(bodies) more by row. The last is the name of the row's number."""
    rows, number = numbered(docs)
    text = fresh(rows, "body")
    rows = rows.select(number, *map(column, keep), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias(text))
    bodies = rows.select(F.col(number).alias("row"), F.col(text).alias("body"))
    more = materialize(beside(bodies)).withColumnRenamed("row", number) if beside else None  # written first, so its shuffles can go
    texts = _packed(bodies)
    spans = repeated_starts(bodies, texts, unit)
    joined = texts.join(spans, "row", "left").select("row", "packed", F.col("spans.a").alias("a"), F.col("spans.b").alias("b"))
    names = [x.split()[0] for x in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = 200
            for piece in (batch.slice(k, n) for k in range(0, batch.num_rows, n)):
                bodies = list(_unpack(piece))
                runs = [[] if not a.is_valid else unit.spans(x, *(c.tolist() for c in _removal(a.as_py(), b.as_py(), unit))) for x, a, b in zip(bodies, piece.column("a"), piece.column("b"), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("row"), *row(bodies, runs)], names=[number, *names])

    made = joined.mapInArrow(run, f"`{number}` long, {ddl}")
    made = made if more is None else made.join(more, number, "left")
    return made, rows.drop(text), number


def _kept(body: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in runs:
        out.append(body[at:a])
        at = b
    return b"".join([*out, body[at:]])


def report(docs: DataFrame, length: int = LENGTH, by_words: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs.

    With by_words, also n_passages and n_passage_words: maximal runs covered by that many words that start
    somewhere else, too, and their words. Nothing is removed for them.
    """
    from datelode.llm.passages import passages

    def row(bodies, runs):
        kept = [_kept(b, r) for b, r in zip(bodies, runs, strict=True)]
        return [pa.array(map(len, bodies), pa.int64()), pa.array([len(b) - len(k) for b, k in zip(bodies, kept, strict=True)], pa.int64()), pa.array(map(len, runs), pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]

    made, rows, number = _cut(docs, Unit(length), ["doc_id"], "n_bytes long, n_removed long, n_spans long, kept_sha256 string", row, (lambda bodies: passages(bodies, by_words)) if by_words else None)
    return rows.join(made, number).drop(number).fillna(0, ["n_passages", "n_passage_words"] if by_words else [])


def removed(docs: DataFrame, length: int = LENGTH, by_words: int = 0) -> DataFrame:
    """docs with repeated bytes cut out of the text, or with by_words the repeated runs of that many words; n_chars set anew.

    A character cut in two goes whole; null text becomes empty; all other columns stay, whatever their names.
    """

    def row(bodies, runs):
        return [pa.array([_kept(b, r).decode("utf-8", "ignore") for b, r in zip(bodies, runs, strict=True)], pa.string())]

    keep = [c for c in docs.columns if c not in ("text", "n_chars")]
    made, rows, number = _cut(docs, words_unit(by_words) if by_words else Unit(length), keep, "text string", row)
    out = rows.join(made, number)
    out = out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
    return out.select(*map(column, docs.columns))
