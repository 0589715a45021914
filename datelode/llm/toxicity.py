"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words (runs of letters, digits and non-ASCII) and their beginnings of PREFIXES
bytes, for languages that build words, hashed to BUCKETS by XXH64; a text is the set of its terms. The score is sigmoid(w0 + sum of w + sum over pairs of <v, v'>): the
pairs catch what no single word shows. The sum over pairs is half of (sum v)^2 - sum v^2, so a text
costs its number of terms. Training: at most SAMPLE labelled rows, those with the smallest hash of
their id, are turned into term sets in Spark and collected (bounded by SAMPLE), packed as gaps and read one by one; Adagrad on log loss
over all terms of MIN_TEXTS sample texts at least (others weigh nothing): a term that says nothing
alone stays, as a pair may need it. Weights are fitted first, each held back by one standard deviation
of its chance gradient (L1), then factors, with L2, join in for what weights leave over. The model (w0, w, v) is broadcast; its
size is fixed by BUCKETS and FACTORS. Rows whose crc32(doc_id as text) mod FOLDS is 0 never train.

Null text is empty and scores as w0 alone does; null ids score too and are never training rows (their
remainder is taken as not held out); repeated rows score alike; several labels of one id all train, and so do the rows of a repeated id, as far as SAMPLE goes;
other columns are dropped; without labelled rows every score is about 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datelode.llm.common import beside, column, doc_bytes, fresh, slices

BUCKETS = 1 << 18
FACTORS = 4
#: Labelled rows that a model is fitted on, at most.
SAMPLE = 10_000
MIN_TEXTS = 5
BATCH = 64
#: First sum of squared factor gradients: chance pairs of a term stay small, steady ones grow.
DAMPING = 100.0
PREFIXES = (4, 5, 6)
FOLDS = 5
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Terms(dict):
    """Word -> bucket, remembered while there is room."""

    ROOM = 200_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        got = xxhash.xxh64_intdigest(word, 7) % BUCKETS
        if len(self) < self.ROOM:
            self[word] = got
        return got

    def of(self, body: bytes) -> np.ndarray:
        """The distinct buckets of a text."""
        words = set(body.translate(_TABLE).split())
        words |= {w[:n] + b"-" for n in PREFIXES for w in words if len(w) > n}
        return np.unique(np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words)))


def pack(terms: np.ndarray) -> bytes:
    """Rising bucket numbers as compressed gaps, byte by byte: about a third of their size."""
    return zlib.compress(np.diff(terms, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    gaps = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(gaps).view("<i4").ravel(), dtype=np.int32)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """w0 + linear + pairs for texts whose terms lie one behind the other from starts on."""
        n = len(starts)
        if not len(terms):
            return np.full(n, self.bias)
        full = np.diff(np.append(starts, len(terms))) > 0
        out = np.full(n, self.bias)
        at = starts[full]
        v = self.factors[terms]
        total, squares = np.add.reduceat(v, at, axis=0), np.add.reduceat(v * v, at, axis=0)
        out[full] += np.add.reduceat(self.weights[terms], at) + 0.5 * (total * total - squares).sum(axis=1)
        return out

    def scores(self, terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(terms, starts), -40, 40)))


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = 8, rate: float = 0.1, l2: float = 0.1, seed: int = 3) -> Machine:
    """Adagrad over batches of texts, epochs without factors and as many with them; only the buckets of a batch are touched."""
    rows = list(rows)  # a list of its own: the one given stays as it is
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(BUCKETS, dtype=np.float32), np.zeros((BUCKETS, FACTORS), dtype=np.float32))
    factors = (rng.standard_normal((BUCKETS, FACTORS)) * 0.01).astype(np.float32)
    positive = sum(y for _, y in rows)
    if not rows or not positive:
        return Machine(-40.0, m.weights, m.factors)
    m.bias = float(np.log(positive / max(1, len(rows) - positive)))
    gw, gv, gb = np.full(BUCKETS, 1e-2, dtype=np.float32), np.full((BUCKETS, FACTORS), DAMPING, dtype=np.float32), 1.0
    texts = np.zeros(BUCKETS, dtype=np.int64)
    for k in range(0, len(rows), BATCH):
        texts += np.bincount(np.concatenate([t for t, _ in rows[k : k + BATCH]]), minlength=BUCKETS)
    known = texts >= MIN_TEXTS
    factors[~known] = 0
    for k, (t, y) in enumerate(rows):  # one by one, so that the sample is not held twice
        rows[k] = (t[known[t]], y)
    p, share = positive / len(rows), texts / len(rows)
    touched = max(1, len(rows) / BATCH) * (1 - (1 - np.minimum(share, 1)) ** BATCH)  # batches of an epoch that hold the term
    l1 = (np.sqrt(p * (1 - p) * texts) / np.maximum(touched, 1e-9)).astype(np.float32)
    order = np.arange(len(rows))
    for epoch in range(2 * epochs):
        rng.shuffle(order)
        if epoch == epochs:
            m.factors = factors
        for k in range(0, len(order), BATCH):
            some = [rows[i] for i in order[k : k + BATCH] if len(rows[i][0])]
            if not some:
                continue
            terms = np.concatenate([t for t, _ in some])
            sizes = np.array([len(t) for t, _ in some])
            starts, y = np.cumsum(sizes) - sizes, np.array([y for _, y in some])
            off = (m.scores(terms, starts) - y).astype(np.float32)
            per = np.repeat(off, sizes)
            used, at = np.unique(terms, return_inverse=True)
            dw = np.bincount(at, weights=per, minlength=len(used)).astype(np.float32)
            if epoch >= epochs:
                v = m.factors[terms]
                pull = per[:, None] * (np.repeat(np.add.reduceat(v, starts, axis=0), sizes, axis=0) - v)
                dv = np.stack([np.bincount(at, weights=pull[:, f], minlength=len(used)) for f in range(FACTORS)], axis=1).astype(np.float32) + l2 * m.factors[used]
                gv[used] += dv * dv
                m.factors[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
            gw[used] += dw * dw
            step = rate / np.sqrt(gw[used])
            w = m.weights[used] - step * dw
            m.weights[used] = np.sign(w) * np.maximum(np.abs(w) - step * l1[used], 0)
            gb += float(off.sum()) ** 2
            m.bias -= rate * float(off.sum()) / gb**0.5
    return m


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    rows = doc_bytes(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "body", F.col("toxic").cast("int").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            for piece in slices(batch, "body"):
                sets = [pack(terms.of(b)) for b in piece.column("body").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(sets, pa.binary()), piece.column("toxic")], names=["doc_id", "terms", "toxic"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    sets = rows.mapInArrow(run, f"doc_id {kind}, terms binary, toxic int")
    got = sets.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "terms").limit(sample).toArrow()  # an id may stand in many rows
    found = sorted(zip(got["doc_id"].to_pylist(), got["toxic"].to_pylist(), got["terms"].to_pylist(), strict=True))
    del got
    machine = fit([(unpack(t), int(y == 1)) for _, y, t in found])
    pa.default_memory_pool().release_unused()
    return machine


@cache
def _terms() -> Terms:
    """One a worker process."""
    return Terms()


def score(docs: DataFrame, machine: Machine, *keep: str, threshold: float = 0.5, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns of keep, then score (double) and predicted (int), under the given names, for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(bodies: list[bytes]) -> list[pa.Array]:
        sets = [_terms().of(b) for b in bodies]
        sizes = np.array([len(s) for s in sets])
        p = sent.value.scores(np.concatenate(sets), np.cumsum(sizes) - sizes).astype(np.float64)
        return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

    return beside(docs, list(keep), run, f"{names[0]} double, {names[1]} int")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    out = score(docs, train(docs, labels, sample), "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    names = fresh(docs, "score"), fresh(docs, "predicted")
    out = score(docs, train(docs, labels, sample), *docs.columns, names=names)
    return out.where(f"{names[1]} = 0").select(*map(column, docs.columns))
