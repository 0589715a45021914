"""The two fitted models against sums over everything: pairs of terms, labellings of a page; and pages that no rule made."""

import itertools
import random

import numpy as np
import pytest

from datelode.llm import html_crf, toxicity


def test_pairs_are_summed_as_a_double_loop_does():
    rng = np.random.default_rng(2)
    m = toxicity.Machine(0.3, rng.standard_normal(toxicity.BUCKETS).astype(np.float32), rng.standard_normal((toxicity.BUCKETS, toxicity.FACTORS)).astype(np.float32))
    texts = [np.sort(rng.choice(toxicity.BUCKETS, size=n, replace=False)) for n in (5, 0, 1, 30, 0)]
    want = [m.bias + sum(float(m.weights[t]) for t in x) + sum(float(np.dot(m.factors[a], m.factors[b])) for a, b in itertools.combinations(x.tolist(), 2)) for x in texts]
    sizes = np.array([len(x) for x in texts])
    assert np.allclose(m.raw(np.concatenate(texts), np.cumsum(sizes) - sizes), want, rtol=1e-3, atol=1e-3)


def chain(seed, n, features=6):
    rng = np.random.default_rng(seed)
    field = html_crf.Field({f"f{k}": k for k in range(features)}, rng.standard_normal((features, 2)), rng.standard_normal((2, 2)))
    found = [[int(x) for x in rng.integers(0, features, size=rng.integers(1, 5))] for _ in range(n)]  # features may repeat in a block
    return field, found


def score(field, found, y):
    return sum(field.weights[f, y[k]].sum() for k, f in enumerate(found)) + sum(field.change[a, b] for a, b in itertools.pairwise(y))


@pytest.mark.parametrize("seed", range(8))
def test_viterbi_and_likelihood_by_enumeration(seed):
    n = 1 + seed
    field, found = chain(seed, n)
    every = {y: score(field, found, y) for y in itertools.product((0, 1), repeat=n)}
    names = [[f"f{k}" for k in f] for f in found]
    assert tuple(field.viterbi(names)) == max(every, key=every.get)
    y = tuple(random.Random(seed).choices((0, 1), k=n))
    total = np.logaddexp.reduce(list(every.values()))
    likelihood, dw, dc = html_crf.slope(field, found, np.array(y))
    assert np.isclose(likelihood, every[y] - total)
    expected_w, expected_c = np.zeros_like(dw), np.zeros((2, 2))
    for labels, s in [(y, None), *every.items()]:
        weight = 1.0 if s is None else -np.exp(s - total)
        for k, f in enumerate(found):
            for x in f:
                expected_w[x, labels[k]] += weight
        for a, b in itertools.pairwise(labels):
            expected_c[a, b] += weight
    assert np.allclose(dw, expected_w) and np.allclose(dc, expected_c)


PAGES = [
    (
        """<!doctype html><html><head><title>Bread</title><style>p{color:red}</style><script>var x = "<p>no</p>";</script></head><body>
        <nav><ul><li><a href=/>Home</a></li><li><a href=/r>Recipes</a></li><li><a href=/a>About us</a></li></ul></nav>
        <div class="cookie-notice"><p>We use cookies to improve this site. <button>Accept</button></p></div>
        <article><h1>A loaf for a cold day</h1><p>Mix the flour &amp; water in the evening and leave the bowl covered until the morning comes.</p>
        <p>Fold the dough three times, wait for an hour, and bake it in a hot oven until the crust is dark.</p></article>
        <aside class="sidebar"><h3>Popular</h3><ul><li><a href=1>Ten soups</a></li><li><a href=2>Five cakes</a></li></ul></aside>
        <section class="comments"><h2>Comments</h2><div class="comment"><p>I tried this and it was great, thank you!</p></div></section>
        <footer><p>© 2024 The bakery. All rights reserved.</p></footer></body></html>""",
        ["A loaf for a cold day", "Mix the flour & water in the evening and leave the bowl covered until the morning comes.", "Fold the dough three times, wait for an hour, and bake it in a hot oven until the crust is dark."],
    ),
    (
        """<html><body><header class="site-header"><a href=/>The Daily</a><form action=/s><input name=q><button>Search</button></form></header>
        <main><div class="article-body"><h1>River level falls again</h1><p>The river has fallen by a third since the spring, the office for water said on Monday.</p>
        <div class="advert"><p>Buy one, get one free! Only this week.</p></div>
        <p>Farmers along the lower valley are worried about the harvest, and many have asked for help.</p></div></main>
        <div class="footer"><a href=/imprint>Imprint</a> <a href=/privacy>Privacy</a></div></body></html>""",
        ["River level falls again", "The river has fallen by a third since the spring, the office for water said on Monday.", "Farmers along the lower valley are worried about the harvest, and many have asked for help."],
    ),
]


#: The model takes a sentence of an advert that stands inside the article's own element for the article's.
KNOWN = pytest.mark.xfail(strict=True, reason="an advert inside the article is kept")


@pytest.mark.parametrize("page,main", [PAGES[0], pytest.param(*PAGES[1], marks=KNOWN)])
def test_pages_written_by_hand(page, main):
    got = html_crf.main_text(page, html_crf.trained()).split("\n")
    assert set(got) & set(main) == set(main), got
    assert not [x for x in got if x not in main], got
