"""The character tagger: gradient by differences, fits over partitions, held-out spans, weights as a table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from datelode.operators import char_tagger as ct
from datelode.operators import labels, tagger


def names(n=500, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        digits = "".join(rng.choice("0123456789") for _ in range(4))
        date = f"{rng.randint(1990, 2030)}{rng.randint(1, 12):02}{rng.randint(1, 28):02}"
        form = rng.choice(["IMG_{}", "{} trip", "照片{}", "no{}date", "x{}"])
        if form in ("no{}date", "x{}"):
            text, tags = form.format(digits), None
        else:
            text = form.format(date)
            at = text.index(date)
            tags = ["O"] * at + ["B-YEAR", "I-YEAR", "I-YEAR", "I-YEAR", "B-MONTH", "I-MONTH", "B-DAY", "I-DAY"] + ["O"] * (len(text) - at - 8)
        out.append((f"n{k}", text, tags or ["O"] * len(text)))
    return out


@pytest.fixture(scope="module")
def samples(spark):
    rows = spark.createDataFrame(names(), "id string, text string, labels array<string>")
    return rows.withColumn("chars", F.filter(F.split("text", ""), lambda c: c != ""))


@pytest.fixture(scope="module")
def fitted(samples):
    return ct.fit(samples, steps=35, tasks=3)


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    m = ct.Tagger.fresh({c: i + 2 for i, c in enumerate("abc12_")}, reach=2, width=3, hidden=5)
    m.theta = m.theta + rng.standard_normal(len(m.theta)) * 0.1
    texts, tags, has, w = [rng.integers(1, 8, size=n) for n in (4, 1, 6)], rng.integers(0, 13, size=11), np.array([0, 1, 1]), rng.random(13) + 0.5
    loss, grad = m.loss(texts, tags, has, w, 0.3, 0.2)
    apart = [m.loss([t], tags[a:b], has[k : k + 1], w, 0.3, 0.2) for k, (t, a, b) in enumerate(zip(texts, (0, 4, 5), (4, 5, 11), strict=True))]
    assert np.isclose(loss, sum(x for x, _ in apart)) and np.allclose(grad, sum(g for _, g in apart))  # tasks may be cut anywhere
    for k in range(3, len(grad)):  # the first are the padding's, which stays zero
        kept = m.theta[k]
        ends = []
        for d in (1e-6, -1e-6):
            m.theta[k] = kept + d
            ends.append(m.loss(texts, tags, has, w, 0.3, 0.2, slope=False)[0])
        m.theta[k] = kept
        assert abs((ends[0] - ends[1]) / 2e-6 - grad[k]) < 1e-7


def test_fit_does_not_depend_on_the_tasks(samples):
    one, log = ct.fit(samples, steps=3, tasks=1)
    many, other = ct.fit(samples, steps=3, tasks=9)
    assert np.allclose(one.theta, many.theta) and np.allclose(log, other) and log[-1][0] < log[0][0]


def test_held_out_spans(spark, samples, fitted):
    model, log = fitted
    assert log[-1][1] < 0.2 * log[0][1]
    models = ct.Models(spark)
    models.put("tagger", model)
    rows = samples.withColumn("split", ct.split(F.col("id"))).where("split = 'test'")
    got = ct.found(ct.tagged(rows.select("id", "text"), "text", models), "text")
    gold = labels.spans(rows.select("id", "labels"))
    scores = labels.overall_scores(got, gold, rows).first()
    assert scores.f1 > 0.97 and scores.clf_fp + scores.clf_fn <= 1 and rows.count() > 20
    dates = {r.id: r.dt for r in tagger.dates(got).collect()}
    texts = {r.id: r.text for r in rows.collect()}
    assert sum(f"{d:%Y%m%d}" in texts[i] for i, d in dates.items() if d) >= 0.95 * len(dates)


def test_weights_are_a_table(spark, fitted, tmp_path):
    model, _ = fitted
    ct.save(spark, model, str(tmp_path / "w"))
    models = ct.Models(spark, tagger=str(tmp_path / "w"))
    assert "tagger" in models and "other" not in models and models.get("tagger") is models.get("tagger")
    back = models.get("tagger").value
    assert back.alphabet == model.alphabet and back.labels == model.labels and np.array_equal(back.theta, model.theta)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "IMG_20240105"), (4, "z" * 50_000), (5, "\U0001f600́"), (3, "IMG_20240105")], "id int, text string")
    got = ct.tagged(odd, "text", models).collect()
    assert [(r.id, len(r.labels), len(r.shares)) for r in got] == [(1, 0, 0), (2, 0, 0), (3, 12, 12), (4, 50_000, 50_000), (5, 2, 2), (3, 12, 12)]
    assert got[2].labels[4:] == ["B-YEAR", "I-YEAR", "I-YEAR", "I-YEAR", "B-MONTH", "I-MONTH", "B-DAY", "I-DAY"] and got[2] == got[5]
    with pytest.raises(ValueError):
        ct.fit(spark.createDataFrame([], "id string, chars array<string>, labels array<string>"))


def test_exact_dates(spark):
    kind = "id int, field string, begin int, end int"
    day = [("YEAR", 0, 4), ("MONTH", 4, 6), ("DAY", 6, 8)]
    gold = spark.createDataFrame([(i, *s) for i in (1, 2, 3, 4) for s in day] + [(5, "YEAR", 0, 4)], kind)
    said = spark.createDataFrame([(1, *s) for s in [*day, ("HOUR", 9, 11)]] + [(2, *s) for s in day[:2]] + [(3, "YEAR", 0, 4), (3, "MONTH", 4, 6), (3, "DAY", 6, 9)] + [(5, "YEAR", 0, 4)], kind)
    assert labels.exact_dates(said, gold).collect() == [(4, 1, 0.25)] and labels.exact_dates(said, gold.limit(0)).collect() == [(0, 0, 0.0)]
