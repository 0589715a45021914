"""A character tagger: fitted over partitions, kept as a table, applied through broadcast.

The network looks at a window of REACH characters to both sides: an embedding of each, one hidden layer, and two
heads, one for the label of the character in the middle (B-/I- of the date fields, O) and one for the whole
text (has it a date), which sees the largest activations of all its characters. Loss is cross entropy of both;
labels weigh as label_weights() says, so that rare fields count.

fit() is data-parallel: samples are encoded and written once; in each step every task adds up the gradient of its
rows for the broadcast weights, the sums meet in a tree (about the square root of the tasks in each group), and
Adam moves the weights on the driver, which only ever holds the weights and one sum a group. Rows of the
validation share add to its loss instead; fitting stops when that has not fallen for PATIENCE steps, and the best
weights are kept. A lost task repeats its rows' sum.

Texts of any length are taken whole, SLICE characters at a time. Empty and null texts have no labels and the class
that no activation gives; unknown characters share one number; without samples fit() raises ValueError.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datelode.operators import labels as L
from datelode.operators import tagger
from datelode.operators.components import saved
from datelode.sources.sampling import split

LABELS = ["O", *(f"{b}-{f}" for f in tagger.FIELDS for b in "BI")]
REACH, WIDTH, HIDDEN = 8, 12, 48
STEPS, PATIENCE, RATE, CLASS_SHARE = 60, 10, 0.03, 0.3
PAD, SPECIAL = 0, 2
#: Training rows of a step.
BATCH = 32_768
#: Characters that a task looks at in one go.
SLICE = 20_000


@dataclass
class Tagger:
    """Weights as one vector, the alphabet and the shape."""

    alphabet: dict[str, int]
    theta: np.ndarray
    labels: list[str] = field(default_factory=lambda: list(LABELS))
    reach: int = REACH
    width: int = WIDTH
    hidden: int = HIDDEN

    def shapes(self) -> list[tuple[int, ...]]:
        d, h, n = (2 * self.reach + 1) * self.width, self.hidden, len(self.labels)
        return [(max(self.alphabet.values(), default=SPECIAL - 1) + 1, self.width), (d, h), (h,), (h, n), (n,), (h, 2), (2,)]

    def parts(self, theta: np.ndarray | None = None) -> list[np.ndarray]:
        out, at, theta = [], 0, self.theta if theta is None else theta
        for s in self.shapes():
            n = int(np.prod(s))
            out.append(theta[at : at + n].reshape(s))
            at += n
        return out

    @classmethod
    def fresh(cls, alphabet: dict[str, int], seed: int = 42, **shape) -> Tagger:
        new, rng = cls(alphabet, np.zeros(0), **shape), np.random.default_rng(seed)
        new.theta = np.concatenate([(rng.standard_normal(s) / max(1, s[0]) ** 0.5 if len(s) > 1 else np.zeros(s)).ravel() for s in new.shapes()])
        new.parts()[0][:] = rng.standard_normal(new.shapes()[0]) * 0.3
        new.parts()[0][PAD] = 0
        return new

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter((self.alphabet.get(c, tagger.UNKNOWN) for c in text), dtype=np.int64, count=len(text))

    def forward(self, texts: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Activations of all characters of non-empty texts."""
        table, w1, b1, w2, b2, wc, bc = self.parts()
        sizes = np.array([len(t) for t in texts])
        first = np.cumsum(sizes + self.reach) - sizes  # texts with padding between them
        flat = np.zeros(int(sizes.sum()) + self.reach * (len(texts) + 1), dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(sizes.sum()) - starts[owner] + first[owner]
        flat[place] = np.concatenate(texts)
        near = flat[place[:, None] + np.arange(-self.reach, self.reach + 1)]
        x = table[near].reshape(len(place), -1)
        h = np.maximum(x @ w1 + b1, 0)
        top = np.maximum.reduceat(h, starts, axis=0)
        return {"near": near, "x": x, "h": h, "top": top, "owner": owner, "starts": starts, "label": _softmax(h @ w2 + b2), "class": _softmax(top @ wc + bc)}

    def loss(self, texts, tags, has, weights: np.ndarray, by_label: float, by_class: float, slope: bool = True):
        """(loss, gradient): weighted cross entropy of labels times by_label and of classes times by_class."""
        a = self.forward(texts)
        n, t, w = np.arange(len(tags)), np.arange(len(has)), weights[tags] * by_label
        total = -float(w @ np.log(a["label"][n, tags] + 1e-12)) - by_class * float(np.log(a["class"][t, has] + 1e-12).sum())
        if not slope:
            return total, None
        _, w1, _, w2, _, wc, _ = self.parts()
        grad = np.zeros_like(self.theta)
        table, g1, gb1, g2, gb2, gc, gbc = self.parts(grad)
        dz = a["label"] * w[:, None]
        dz[n, tags] -= w
        dc = a["class"] * by_class
        dc[t, has] -= by_class
        g2[:], gb2[:], gc[:], gbc[:] = a["h"].T @ dz, dz.sum(0), a["top"].T @ dc, dc.sum(0)
        best = a["h"] == a["top"][a["owner"]]
        shared = (dc @ wc.T) / np.add.reduceat(best, a["starts"], axis=0, dtype=np.int64)
        dh = (dz @ w2.T + best * shared[a["owner"]]) * (a["h"] > 0)
        g1[:], gb1[:] = a["x"].T @ dh, dh.sum(0)
        dx = (dh @ w1.T).reshape(-1, self.width)
        near = a["near"].ravel()
        for k in range(self.width):
            table[:, k] = np.bincount(near, weights=dx[:, k], minlength=len(table))
        table[PAD] = 0
        return total, grad


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _pieces(sizes: list[int], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    start = total = 0
    for k, n in enumerate(sizes):
        if k > start and total + n > limit:
            yield start, k
            start, total = k, 0
        total += n
    if sizes:
        yield start, len(sizes)


def _summed(rows: DataFrame, model: Tagger, weights: np.ndarray, by_label: float, by_class: float) -> tuple[np.ndarray, float, float]:
    """(gradient, training loss, validation loss) over all encoded rows(ids, tags, has, held)."""
    sent = rows.sparkSession.sparkContext.broadcast((model, weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights = sent.value
        grad, losses = np.zeros_like(model.theta), [0.0, 0.0]
        for batch in batches:
            for held in (0, 1):
                some = batch.filter(pa.array(np.asarray(batch.column("held").to_numpy(zero_copy_only=False), dtype=bool) == bool(held)))
                texts, tags = ([np.asarray(x, dtype=np.int64) for x in some.column(c).to_pylist()] for c in ("ids", "tags"))
                has = some.column("has").to_numpy()
                for a, b in _pieces([len(t) for t in texts]):
                    loss, g = model.loss(texts[a:b], np.concatenate(tags[a:b]), has[a:b], weights, by_label, by_class, slope=not held)
                    losses[held] += loss
                    grad = grad if held else grad + g
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([grad.tobytes()], pa.binary()), pa.array([losses[0]]), pa.array([losses[1]])], names=["slot", "grad", "loss", "held"])

    def add(table: pa.Table) -> pa.Table:
        grad = sum(np.frombuffer(g) for g in table.column("grad").to_pylist())
        return pa.table({"slot": [0], "grad": pa.array([grad.tobytes()], pa.binary()), "loss": [float(sum(table.column("loss").to_pylist()))], "held": [float(sum(table.column("held").to_pylist()))]})

    ddl = "slot long, grad binary, loss double, held double"
    groups = max(1, round(rows.rdd.getNumPartitions() ** 0.5))
    got = rows.mapInArrow(work, ddl).groupBy(F.expr(f"slot % {groups}")).applyInArrow(add, ddl).collect()  # one row a group
    sent.destroy()
    return sum((np.frombuffer(r.grad) for r in got), np.zeros_like(model.theta)), sum(r.loss for r in got), sum(r.held for r in got)


def fit(samples: DataFrame, steps: int = STEPS, patience: int = PATIENCE, rate: float = RATE, min_freq: int = 1, min_freq_han: int | None = 3, tasks: int | None = None, **shape) -> tuple[Tagger, list[tuple[float, float]]]:
    """The tagger fitted on samples(id, chars, labels), and (training loss, validation loss) of each step.

    The share of ids that sampling.split() calls val is held for validation; test rows are left out.
    """
    rows = saved(samples.withColumn("split", split(F.col("id"))).where("split <> 'test' AND size(chars) > 0"))  # read five times
    train = rows.where("split = 'train'")
    alphabet = {r.char: r.id for r in L.vocabulary(train.select(F.array_join("chars", "").alias("text")), "text", SPECIAL, min_freq, min_freq_han).collect()}  # the alphabet
    weight = {r.label: r.weight for r in L.label_weights(train).collect()}
    counts = train.agg(F.count("*").alias("n")).first().n
    batches = max(1, round(counts / BATCH))
    if not counts:
        raise ValueError("no samples to fit on")
    model = Tagger.fresh(alphabet, **shape)
    weights = np.array([weight.get(x, 1.0) for x in model.labels])
    total = sum(weights[model.labels.index(r.label)] * r.n for r in train.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n")).collect() if r.label in model.labels)
    tag = {x: k for k, x in enumerate(model.labels)}
    code = lambda table, low: F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.create_map(F.lit(""), F.lit(low))
    number = lambda c, table, low: F.transform(c, lambda x: F.coalesce(F.try_element_at(code(table, low), x), F.lit(low)))
    encoded = rows.select(number(F.col("chars"), alphabet, tagger.UNKNOWN).alias("ids"), number(F.col("labels"), tag, 0).alias("tags"), F.exists("labels", lambda x: x != "O").cast("int").alias("has"), (F.col("split") == "val").alias("held"), F.pmod(F.xxhash64(F.lit("batch"), "id"), F.lit(batches)).cast("int").alias("batch"))
    encoded = saved(encoded.repartition(tasks or samples.sparkSession.sparkContext.defaultParallelism), "batch")
    m, v, best, log, since = np.zeros_like(model.theta), np.zeros_like(model.theta), (np.inf, model.theta), [], 0
    for step in range(1, -(-steps // batches) * batches + 1):
        batch = encoded.where(F.col("batch") == (step - 1) % batches).drop("batch")
        grad, loss, held = _summed(batch, model, weights, batches * (1 - CLASS_SHARE) / total, batches * CLASS_SHARE / counts)
        log.append((loss, held))
        if step % batches == 0:
            loss, held = (sum(x) / batches for x in zip(*log[-batches:], strict=True))
            if held < best[0] or not held and loss < best[0]:
                best, since = (held or loss, model.theta.copy()), 0
            elif (since := since + batches) >= patience:
                break
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        model.theta = model.theta - rate * min(1.0, step / 5) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.theta = best[1]
    return model, log


def save(spark: SparkSession, model: Tagger, path: str) -> None:
    """One row of a table: the weights as bytes, the rest as JSON."""
    about = json.dumps({"alphabet": model.alphabet, "labels": model.labels, "reach": model.reach, "width": model.width, "hidden": model.hidden}, ensure_ascii=False)
    spark.createDataFrame([(about, bytearray(model.theta.astype("<f8").tobytes()))], "about string, theta binary").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Tagger:
    row = spark.read.parquet(path).first()
    return Tagger(theta=np.frombuffer(bytes(row.theta), dtype="<f8"), **json.loads(row.about))


class Models:
    """Models by name, each loaded when it is first asked for and sent to the executors once."""

    def __init__(self, spark: SparkSession, **paths: str) -> None:
        self.spark, self.paths, self.sent = spark, paths, {}

    def put(self, name: str, model: object) -> None:
        self.sent[name] = self.spark.sparkContext.broadcast(model)

    def __contains__(self, name: str) -> bool:
        return name in self.sent or name in self.paths

    def get(self, name: str):
        """The broadcast of a model."""
        if name not in self.sent:
            self.put(name, load(self.spark, self.paths[name]))
        return self.sent[name]


def tagged(texts: DataFrame, column: str, models: Models, name: str = "tagger") -> DataFrame:
    """texts with labels (one a character), shares (of each label) and clf (share of texts with a date)."""
    sent = models.get(name)
    rest = [c for c in texts.columns if c not in ("labels", "shares", "clf")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            every = [model.encode(t or "") for t in batch.column("__text").to_pylist()]
            labels, shares, clf = [[] for _ in every], [[] for _ in every], [0.0] * len(every)
            there = [k for k, t in enumerate(every) if len(t)]
            for a, b in _pieces([len(every[k]) for k in there]):
                got = model.forward([every[k] for k in there[a:b]])
                best = got["label"].argmax(axis=1)
                share = got["label"][np.arange(len(best)), best]
                ends = [*got["starts"][1:].tolist(), len(best)]
                for k, x, y, c in zip(there[a:b], got["starts"].tolist(), ends, got["class"][:, 1].tolist(), strict=True):
                    labels[k], shares[k], clf[k] = [model.labels[i] for i in best[x:y].tolist()], share[x:y].tolist(), c
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(labels, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64())), pa.array(clf, pa.float64())], names=[*rest, "labels", "shares", "clf"])

    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in rest)
    return texts.select(*rest, F.col(column).alias("__text")).mapInArrow(work, f"{kinds}, labels array<string>, shares array<double>, clf double")


def found(rows: DataFrame, column: str, least: float = 0.5) -> DataFrame:
    """id, field, begin, end, value, confidence, clf for tagged rows(id, text, labels, shares, clf) that are taken to have a date; confidence is the mean share of the span's labels."""
    s = rows.where(F.col("clf") >= least).select("id", column, "shares", "clf", F.explode(L.span_array(F.col("labels"))).alias("s"))
    width = F.col("s.end") - F.col("s.begin")
    mean = F.aggregate(F.slice("shares", F.col("s.begin") + 1, width), F.lit(0.0), lambda a, x: a + x) / width
    return s.select("id", "s.field", "s.begin", "s.end", F.substring(column, F.col("s.begin") + 1, width).alias("value"), mean.alias("confidence"), "clf")
