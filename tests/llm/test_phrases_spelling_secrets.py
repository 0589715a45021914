"""Secret scans, phrase collocations and spelling variants against brute force, on small odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from datelode.llm import collocations, queries, secrets, spelling

DOC = "doc_id long, text string, lang string, source string, spans string, n long, rank long, phrase string, word string, root string"
SF = "/root/testdata/sf0.001"


def documents(spark, rows):
    """rows: (doc_id, text, lang); the other columns clash with names that the operators use."""
    return spark.createDataFrame([(i, t, lang, "s", "x", 1, 2, "p", "w", "r") for i, t, lang in rows], DOC).repartition(3)


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# ---- collocations


def brute_collocations(rows, max_n=3, min_count=10, top=2000, cover=50):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + m])) for m in range(1, max_n + 1) for i in range(len(words) - m + 1))
    held = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    out = defaultdict(list)
    for (lang, p), a in held.items():
        if any(k[0] == lang and len(k[1]) > len(p) and 100 * b >= cover * a and any(k[1][i : i + len(p)] == p for i in range(len(k[1]) - len(p) + 1)) for k, b in held.items()):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(p), left, right))
    return {(lang, rank, p, -a, left, right, n[lang], -score) for lang, found in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)}


def phrase_texts(seed=5):
    rng = random.Random(seed)
    words = ["red", "Fish", "blue", "ñandú", "a", "the", "x y", "\x1c", "ONE", "two", "É"]
    stock = ["the red fish", "one two  the red", "É\tñandú a", "a a a a"]
    rows = []
    for k in range(90):
        text = "".join(rng.choice([*stock, rng.choice(words)]) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", "\r\n", "\x0b", "; ", "! "]) for _ in range(rng.randint(0, 40)))
        rows.append((k % 80, text, rng.choice(["en", "en", "en", "de", None, "und", ""])))
    return [*rows, (None, None, "en"), (7, None, None), (7, "", "en"), (8, "the red fish " * 300, "en"), (8, "the red fish " * 300, "en")]


@pytest.mark.parametrize("max_n,min_count,top,cover", [(3, 10, 2000, 50), (4, 5, 7, 50), (2, 10, 3, 80), (3, 3, 20, 100)])
def test_collocations(spark, monkeypatch, max_n, min_count, top, cover):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 900)
    rows = phrase_texts()
    want = brute_collocations(rows, max_n, min_count, top, cover)
    for prune in (True, False):
        got = [tuple(r) for r in collocations.collocations(documents(spark, rows), max_n, min_count, top, cover, prune).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_collocations_filter_lets_nothing_frequent_go(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MAX_BITS", 64)  # rounded up to one row: a filter far too small still drops no frequent phrase
    rows = phrase_texts(6)
    assert {tuple(r) for r in collocations.collocations(documents(spark, rows)).collect()} == brute_collocations(rows)
    assert collocations.collocations(documents(spark, rows).limit(0)).count() == 0


def test_collocations_windows_overlap(monkeypatch):
    monkeypatch.setattr(collocations, "WINDOW", 3)
    text = b"a b c d. e f g a b c\td e"
    for n in (1, 2, 3, 4):
        got = Counter()
        for window in collocations.Slice(text).windows(n):
            phrase, c = collocations.phrases(*window, n, None)
            got.update(dict(zip(phrase.to_pylist(), c.tolist(), strict=True)) if len(set(phrase.to_pylist())) == len(phrase) else pytest.fail("a phrase twice"))
        pieces = [p.split() for p in text.replace(b"\t", b" ").split(b".")]
        assert {k: v for k, v in got.items() if v} == Counter(b" ".join(p[i : i + n]) for p in pieces for i in range(len(p) - n + 1))


def test_collocations_scores_pass_64_bits(spark):
    rows = [(10**12, 10**12, 10**12), (999_999_999_999, 10**12, 10**12), (3_000_000_007, 4_000_000_000_000, 3_000_000_007), (10, 10**13, 10**13)]
    words = spark.createDataFrame([("en", f"{side}{k}", n) for k, (_, x, y) in enumerate(rows) for side, n in (("l", x), ("r", y))], "lang string, phrase string, a long")
    pairs = spark.createDataFrame([("en", f"l{k} r{k}", a) for k, (a, _, _) in enumerate(rows)], "lang string, phrase string, a long")
    got = {r.phrase: r.score for r in collocations.scored([words, pairs], [pairs]).collect()}
    assert got == {f"l{k} r{k}": 10**6 * a * a // (x * y) for k, (a, x, y) in enumerate(rows)}


def test_bloom_filter_holds_its_items(spark):
    items = [f"w{i} v{i % 7}" for i in range(5000)]
    packed = np.frombuffer(collocations.bloom(spark.createDataFrame([(p,) for p in items], "phrase string"), 2, 5000), np.uint8)
    hashes = lambda texts: collocations.folded(collocations.word_hashes(" ".join(texts).encode().split(b" ")), 2)[::2]
    assert collocations.holds(packed, hashes(items)).all()
    assert collocations.holds(packed, hashes([f"v{i} w{i}" for i in range(5000)])).mean() < 0.03


# ---- spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(rows, min_length=7, min_count=2, factor=10):
    n = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}
    friends = {w: [v for v in n if near(v, w)] for w in n}
    best = {w: min(f, key=lambda v: (-n[v], v)) for w, f in friends.items() if f}
    form = {w: b for w, b in best.items() if n[b] >= factor * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(friends[w]), n[form[w]] if w in form else None) for w in n}


def spelling_texts(seed=3):
    rng = random.Random(seed)
    base = ["receive", "recieve", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "überall", "überalL", "überalll", "Straßen", "strasen", "strassen", "naïveté", "naïvete", "abcdefg", "abcdefh", "abcdeffg", "bcdefgh"]
    words = [*base, *{"".join(rng.choices("ab", k=rng.randint(6, 9))) for _ in range(60)}]
    weight = [3 ** rng.randint(0, 7) for _ in words]
    rows = [(k % 50, " ".join(rng.choices(words, weight, k=rng.randint(0, 120))) + rng.choice([".", "1", "×÷receive", "-"]), "en") for k in range(60)]
    return [*rows, (None, "receive " * 40, None), (None, None, "en"), (3, "", "en"), (9, "z" * 5000 + " " + "z" * 5000 + " " + "z" * 4999, "en")]


def test_spelling(spark):
    rows = spelling_texts()
    got = [tuple(r) for r in spelling.spelling_variants(documents(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spelling(rows)
    assert spelling.spelling_variants(documents(spark, rows).limit(0)).count() == 0


def test_spelling_long_chains(spark):
    words = [("abcdefg" + "h" * k, 10 ** (12 - k)) for k in range(12)]
    got = spelling.with_roots(spelling.forms(spark.createDataFrame(words, "word string, n long"))).collect()
    assert {r.root for r in got} == {"abcdefg"} and sum(r.form is None for r in got) == 1


# ---- secrets


def brute_base(text):
    kinds = ["assign", "access", "hex"]
    found = []
    for m in re.finditer("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        found += [(m.start(), 0, m.end())] * (len(m[2]) >= 6)
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found)]


def secret_texts():
    rng = random.Random(4)
    letters = ["password", "PASSWD", "ſecret", "secret", "Token", "toKen", "api_key", "apikey", '"', "'", "=", ":", " ", "  ", "\n", "AKIA", "A" * 16, "B" * 15, "0a" * 12, "0a" * 11, "abc", "hunter22", "é", "ж", "x.y/z+w_=", "Bearer ", "8fK2mQz7Lw1XnRb4"]
    rows = [(k, "".join(rng.choices(letters, k=rng.randint(0, 60))), "en") for k in range(300)]
    return [*rows, (None, None, None), (1, "", "en"), (2, "token = " + "Q" * 100_000, "en"), (2, "token " * 20_000 + "=", "en"), (2, "0123456789abcdef" * 20_000, "en")]


def test_secrets_base_spans(spark):
    rows = secret_texts()
    got = Counter()
    for r in secrets.report(documents(spark, rows)).collect():
        spans = [s for s in r.spans.split(",") if s]
        base = [s for s in spans if not s.startswith("novel")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex, r.n_novel] == [sum(s.startswith(k) for s in spans) for k in secrets.KINDS]
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
        got[r.doc_id, ",".join(base)] += 1
    assert got == Counter((i, ",".join(brute_base(t or ""))) for i, t, _ in rows)
    assert secrets.report(documents(spark, rows).limit(0)).count() == 0


def test_secrets_novelty(spark):
    rng = random.Random(9)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    code = ["def connect(settings): return client.session(settings.username, settings.connection_timeout)", "the signature of the administrative department is authorization-department/authorization_documents", "cookie consent and preference_preferences are described in documentation.configuration"]
    keys = ["".join(rng.choices(alphabet, k=rng.choice([16, 24, 40]))) for _ in range(200)]
    lines = ["Authorization: Bearer {}", "client_id {} belongs to the service", "private key {}\nend", "pwd={}", "aws credential {}"]
    rows = [(k, rng.choice(code) + "\n" + lines[k % 5].replace("{}", key) + "\n" + rng.choice(code), "en") for k, key in enumerate(keys)]
    clean = [(1000 + k, f"{rng.choice(code)}\n{rng.choice(code)}", "en") for k in range(200)]
    far = [(2000, "token\n" + keys[0], "en"), (2001, "token" + " " * 60 + keys[0], "en"), (2002, "no context " + keys[0], "en"), (2003, "session_id 123456789012345678", "en")]
    got = {r.doc_id: r.spans for r in secrets.report(documents(spark, [*rows, *clean, *far])).collect()}
    want = {}
    for i, text, _ in rows:
        want[i] = {f"novel:{m.start()}:{m.end()}" for m in re.finditer(keys[i], text)}
    hit = sum(set(got[i].split(",")) == want[i] for i in want)
    assert hit == 200
    assert not any(got[i] for i, *_ in [*clean, *far])


def test_secrets_repeated_secret_is_new_each_time():
    content = secrets.dictionary(["settings"])
    key = "q8Z1xV7kLm3Tn5Rb"
    text = f"bearer {key} and bearer {key}"
    assert [k for _, k, _ in secrets.spans(text, content)] == [3, 3]
    assert secrets.marginal_bytes(text, 7, 7 + len(key), content) >= len(key) * secrets.SHARE


def test_secrets_redacted(spark):
    rows = [(1, "é token = 04dbebab91ab85687d33eeaaf9ac699e1188f962 ok", "en"), (2, "nothing", "en"), (3, None, "en")]
    out = secrets.redacted(documents(spark, rows).drop("spans"))
    assert {r.doc_id: r.text for r in out.collect()} == {1: "é [assign] ok", 2: "nothing", 3: None}
    assert out.columns == [c for c in documents(spark, rows).columns if c != "spans"]


@pytest.mark.parametrize("name", ["op12_collocations", "op13_spelling"])
def test_phrases_and_spelling_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    order = sorted(want.columns)
    got = queries.queries()[name](spark, SF).select(order).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.select(", ".join(order)).fetchall())) and got
