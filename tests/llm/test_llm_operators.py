"""The training-data operators against brute force, libraries and round trips, on small odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from datelode.llm import simple8b

DOC = "doc_id long, text string, lang string, source string, n_chars long, host string"
ODD = [
    (1, None, "en", "a", 0, "x"), (2, "", "en", "a", 0, "x"), (3, "  \n\t ", None, None, 3, None), (4, "Hello, wörld's  12 <|endoftext|> ▁it's\u1c89 ok\x1c\u0301 x", "en", "a", 9, "y"),
    (5, "word " * 5000, "en", "b", 9, "y"), (6, "z" * 30000, "en", "b", 9, "y"), (4, "same id, other text", "en", "b", 9, "y"), (7, "twice", "en", "b", 9, "y"), (7, "twice", "en", "b", 9, "y"), (None, "no id", "en", "b", 9, "y"),
]


def path(name):
    return pytest.importorskip("public_tokenizers").path(name)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC).repartition(2)


def test_token_counts(spark, odd):
    import sentencepiece

    from datelode.llm.token_counts import _merge, token_counts

    model = path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(odd, model, capacity=3).collect())
    want = Counter((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t, *_ in ODD)
    assert got == want
    assert token_counts(odd.limit(0), model).count() == 0
    deep = token_counts(odd.repartition(9), model)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in deep.collect()) == want
    from datelode.llm.token_counts import frequent_pretokens

    assert frequent_pretokens(odd.repartition(9), fan_in=2) == frequent_pretokens(odd.coalesce(1)) and frequent_pretokens(odd.limit(0)) == {}
    assert _merge(Counter({"a": 5, "b": 3, "c": 1}), 2) == {"a": 4, "b": 2}


def test_bpe(spark, odd):
    from tokenizers import Tokenizer

    from datelode.llm.bpe import BacktrackingBpe, encode_decode

    file = path("word_bpe_49k.json")
    t = Tokenizer.from_file(file)
    want = []
    for i, text, *_ in ODD:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in encode_decode(odd, file, texts=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert encode_decode(odd.limit(0), file).count() == 0
    own, rng = BacktrackingBpe(file), random.Random(1)
    letters = [*"abcdefthineringandor'sredmvl ÄßéñΣİ1234.,!?&;\n\t", "<|endoftext|>", "'re", "ing", "tion"]
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 50)))
        assert np.frombuffer(own.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids


def test_bpe_pairs_and_long_pretokens():
    import time

    from tokenizers import Tokenizer

    from datelode.llm.bpe import BacktrackingBpe

    file = path("word_bpe_49k.json")
    t, own, rng = Tokenizer.from_file(file), BacktrackingBpe(file), random.Random(2)
    ids = sorted(own.vocab[s] for s in own.usable if own._check(-1 << 20 | own.vocab[s]))
    short = [i for i in ids if len(own.text[i]) < 4]
    for k in range(20000):
        a, b = rng.choice(short if k % 2 else ids), rng.choice(short if k % 3 else ids)
        if not own.text[a].endswith("\ue000") and len(own._units(own.text[a])) == len(own.text[a]):
            want = own._merged(own._units(own.text[a]) + own._units(own.text[b]))[0] == [own.text[a], own.text[b]]
            assert own.compatible(a, b) == want, (own.text[a], own.text[b])
    taken = {}
    for n in (100_000, 1_000_000):
        for kind in ("a" * n, "".join(rng.choices("etaoinshr", k=n))):
            began = time.perf_counter()
            got = np.frombuffer(own.encode(kind), "<u4")
            taken[n] = max(taken.get(n, 0), time.perf_counter() - began)
            assert n > 100_000 or got.tolist() == t.encode(kind, add_special_tokens=False).ids
    assert taken[1_000_000] < 25 * taken[100_000]  # linear: about 10


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 4095, 4096, 4097, 20000])
@pytest.mark.parametrize("high", [1, 100, 49408, 2**40, 2**64 - 1])
def test_simple8b(n, high):
    rng = np.random.default_rng(n)
    v = rng.integers(0, high, n, dtype=np.uint64, endpoint=True)
    v = np.where(rng.random(n) < 0.3, v, v % np.uint64(50000))
    words, offsets = simple8b.encode(v)
    assert (simple8b.decode(words, offsets, n) == v).all()


def test_token_ids(spark, odd):
    from tokenizers import Tokenizer

    from datelode.llm.token_ids import token_ids

    file = path("word_bpe_49k.json")
    t = Tokenizer.from_file(file)
    got = sorted(token_ids(odd, file).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 4, 5, 6, 7, 7]
    start, left = 0, Counter()
    for i, text, *_ in ODD:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        left[i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())] += 1
    for r in got:
        assert r.start == start
        start += r.n_tokens
        left[r.doc_id, r.n_tokens, r.ids_crc32] -= 1
    assert not any(left.values())
    assert token_ids(odd.limit(0), file).count() == 0
    named = odd.selectExpr("'d' || doc_id AS doc_id", "text", "1 AS start", "2 AS body")
    assert sorted((r.doc_id or "", r.start) for r in token_ids(named, file).collect()) == [("d%d" % r.doc_id if r.doc_id is not None else "", r.start) for r in got]


def removal(bodies, n):
    count = Counter(b[k : k + n] for b in bodies for k in range(len(b) - n + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - n + 1):
            if count[b[k : k + n]] > 1:
                gone[k : k + n] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_suffix_dedup(spark, seed):
    from datelode.llm import suffix_dedup

    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 9)))
    pool = [" ".join(word() for _ in range(rng.randint(60, 400))) for _ in range(8)]
    texts = [None, "", "a" * 900, "ab" * 700, "a" * 300, pool[0], pool[0], pool[1][:390]]
    for _ in range(50):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) - 1)
            parts.append(p[a : a + rng.randint(1, 900)] if rng.random() < 0.6 else " ".join(word() for _ in range(rng.randint(1, 150))))
        texts.append("".join(parts))
    ids = list(range(len(texts))) if seed % 2 else [k // 2 if k < 20 else k for k in range(len(texts))]  # repeated ids too
    df = spark.createDataFrame([(i, t, "en", "s", 0, "h") for i, t in zip(ids, texts, strict=True)], DOC).repartition(3)
    bodies = [(t or "").encode() for t in texts]
    want = Counter()
    for i, b, gone in zip(ids, bodies, removal(bodies, suffix_dedup.LENGTH), strict=True):
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want[i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(tuple(r) for r in suffix_dedup.report(df).collect()) == want
    if seed == 1:
        left = {r.doc_id: r.text for r in suffix_dedup.removed(df).collect()}
        assert left[ids[5]] == "" and suffix_dedup.report(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_suffix_dedup_by_words(spark, seed):
    from datelode.llm import suffix_dedup

    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "of", "thé", "x" * 30, "".join(rng.choices("abcde", k=rng.randint(1, 9)))])
    pool = [[word() for _ in range(rng.randint(20, 200))] for _ in range(8)]
    texts = [None, "", "a " * 130, "a b\n" * 60, " " + " ".join(pool[0]) + " \t", "\n".join(pool[0])]
    for _ in range(50):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) - 1)
            parts += p[a : a + rng.randint(1, 120)] if rng.random() < 0.6 else [word() for _ in range(rng.randint(1, 90))]
        texts.append("".join(w + rng.choice([" ", "\n", "  "]) for w in parts))
    df = spark.createDataFrame([(f"d{k // 2}", t, 0, f"r{k}", f"b{k}", k) for k, t in enumerate(texts)], "doc_id string, text string, n_chars long, row string, body string, `a.b` long").repartition(3)
    split = [re.split(r"[\x20\x09-\x0D]+", (t or "").strip(" \t\n")) if (t or "").strip(" \t\n") else [] for t in texts]
    count = Counter(tuple(w[k : k + 50]) for w in split for k in range(len(w) - 49))
    want = Counter()
    for k, w in enumerate(split):
        gone = {x for a in range(len(w) - 49) if count[tuple(w[a : a + 50])] > 1 for x in range(a, a + 50)}
        want[f"d{k // 2}", f"r{k}", f"b{k}", k, " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    got = suffix_dedup.removed(df, by_words=50)
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.row, r.body, r["a.b"], " ".join(r.text.split())) for r in got.collect()) == want
    assert any(len(x[4].split()) < len(w) for x, w in zip(sorted(want, key=lambda x: x[3]), split, strict=True))
    untouched = {r["a.b"]: r.text for r in got.collect()}
    assert untouched[1] == "" and untouched[0] == ""


def test_url_filter(spark):
    from datelode.llm.url_filter import Cascade, judge

    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("b.org", "/x", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://A.Example.NET/en/1?q", "z"), (2, "https://foo.net/a#b", "z"), (3, None, "z"), (4, "nothing", "z"), (5, "http://net", "z"), (6, "http://notnet/", "z"), (7, "http://c.b.org/xy?z", "z"), (7, "http://c.b.org/xy?z", "z"), (8, "x://net?/", "z")], "page_id long, url string, host string")
    got = sorted((tuple(r) for r in judge(pages, rules).collect()), key=str)
    assert got == sorted([(1, "a.example.net", "/en/1", "example.net/en/", "allow"), (2, "foo.net", "/a", "net/", "block"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "net", "", None, "allow"), (6, "notnet", "/", None, "allow"), (7, "c.b.org", "/xy", "b.org/x", "block"), (7, "c.b.org", "/xy", "b.org/x", "block"), (8, "net", "", None, "allow")], key=str)
    assert judge(pages, rules.limit(0)).where("verdict = 'block'").count() == 0 and judge(pages.limit(0), rules).count() == 0
    universe = spark.range(20000).selectExpr("cast(id as string) AS key")
    many = [(f"h{k}.net", "/" * (k % 2), "block" if k % 3 else "allow") for k in range(60)] + [("net", "", "allow"), ("h1.net", "/a", "allow")]
    urls = spark.createDataFrame([(k, f"http://h{k}.net/a") for k in range(70)], "page_id long, url string")
    one, blocks = (sorted(tuple(r) for r in judge(urls, spark.createDataFrame(many, rules.schema), max_rules=m).collect()) for m in (1000, 9))
    assert one == blocks and one[2][3:] == ("h2.net", "block") and one[65][3:] == ("net", "allow") and one[1][3:] == ("h1.net/a", "allow")
    cascade = Cascade(universe.where("cast(key as int) % 7 = 0"), universe)
    assert len(cascade.levels) > 1
    assert universe.where(cascade.holds(universe.key) != (universe.key.cast("int") % 7 == 0)).count() == 0


def test_decontamination(spark):
    from datelode.llm import decontaminate as d

    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)] + ["é1", "ß"]
    item = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, item(rng.choice([3, 9, 10, 14, 25]))) for k in range(12)] + [(50, None), (51, "..."), (None, item(12))]
    docs = [(1, None), (2, ""), (3, "!!!")] + [(k, ", ".join([item(rng.randint(0, 40)), rng.choice(items[:12])[1].upper(), item(20)])) for k in range(4, 60)] + [(5, items[0][1])]
    bench = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc_id string")
    df = spark.createDataFrame([(i, t, "en", "s", 0, "h") for i, t in docs], DOC)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = Counter()
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for p, of in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found |= of
        listed = ",".join(sorted(str(x) for x in found if x is not None))
        want[i, len(w), len(hit), listed, bool(hit)] += 1
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in d.contamination(df, bench).collect())
    assert got == Counter({(i, n, h, hashlib.sha256(s.encode()).hexdigest(), c): v for (i, n, h, s, c), v in want.items()})
    d_blocks = [*d.phrase_blocks(bench, limit=40)]
    assert len(d_blocks) > 2
    old, d.PHRASES = d.PHRASES, 40
    try:
        blocks = d.contamination.__globals__["phrase_blocks"]
        d.contamination.__globals__["phrase_blocks"] = lambda i, w: blocks(i, w, 40)
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in d.contamination(df, bench).collect()) == got
    finally:
        d.PHRASES, d.contamination.__globals__["phrase_blocks"] = old, blocks
    assert d.contamination(d.decontaminated(df, bench), bench).where("n_hit > 9").count() == 0
    assert d.contamination(df, bench.limit(0)).where("contaminated").count() == 0 and d.contamination(df.limit(0), bench).count() == 0


def test_fm_index():
    from datelode.llm.fm_index import FmIndex

    rng = np.random.default_rng(3)
    for it in range(20):
        docs = [rng.integers(1, rng.integers(2, 9), int(rng.integers(0, 30))) for _ in range(int(rng.integers(1, 20)))] * (1 + it % 3)
        seq = np.concatenate([np.append(d, 0) for d in docs]).astype(np.int64)
        index = FmIndex(seq)
        for n in (1, 3, 8):
            patterns = rng.integers(1, 9, (20, n))
            for p, lo, hi in zip(patterns, *index.search(patterns), strict=True):
                assert sorted(index.locate(np.arange(lo, hi)).tolist()) == [k for k in range(len(seq) - n + 1) if (seq[k : k + n] == p).all()]


def test_simhash(spark, odd):
    from datelode.llm import simhash as s

    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = [int(b) ^ sum(1 << int(x) for x in rng.choice(63, int(rng.integers(0, 5)), replace=False)) for b in np.repeat(base, 12)]
    df = spark.createDataFrame([(f,) for f in sorted(set(fps))], "fp long")
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(pairs):
        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)

    flat = sorted(root)
    join((a, b) for k, a in enumerate(flat) for b in flat[k + 1 :] if (a ^ b).bit_count() <= 3)
    want = {f: find(f) for f in flat}
    got = s.components(s.links(df))
    assert {r.node: r.root for r in got.collect()} == {f: r for f, r in want.items() if list(want.values()).count(r) > 1}
    split = s.bucket_links(np.array(flat, dtype=np.int64).view(np.uint64), (1 << 64) - 1, limit=8)  # large buckets, split by further masks
    root = {f: f for f in flat}
    join((int(np.uint64(a).view(np.int64)), int(np.uint64(b).view(np.int64))) for a, b in split)
    assert {f: find(f) for f in flat} == want
    rows = {(r.doc_id, r.fingerprint, r.component_id) for r in s.near_duplicates(odd).collect()}
    assert {(1, "0" * 16, 1), (2, "0" * 16, 1), (3, "0" * 16, 1)} <= rows and s.near_duplicates(odd).count() == len(ODD) and s.near_duplicates(odd.limit(0)).count() == 0


def test_quality_rules(spark, odd):
    from datelode.llm.quality_rules import base_counts, judge

    rng = random.Random(5)
    texts = [t for _, t, *_ in ODD] + ["\n".join(" ".join(rng.choices(["a", "b#", "c\u00e9"], k=rng.randint(0, 20))) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    df = spark.createDataFrame([(k, t, "en", "s", 0, "h") for k, t in enumerate(texts)], DOC)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in base_counts(df).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        w, seen, cover = re.findall(r"[^\x20\x09-\x0D]+", t), {}, set()
        for a in range(len(w) - 7):
            seen.setdefault(tuple(w[a : a + 8]), []).append(a)
        for at in seen.values():
            if len(at) > 1:
                cover |= {x + y for x in at for y in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert got[k] == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)), k
    assert judge(df).count() == len(texts) and judge(df).where("base_failed AND kept").count() == 0 and judge(df.limit(0)).count() == 0
    clean = spark.createDataFrame([(k, " ".join(rng.choices([f"word{j}" for j in range(500)], k=60)) if k % 9 else " ".join(f"w{j}#%$&" for j in range(60)), "en" if k % 2 else None, "s", 0, "h") for k in range(900)], DOC)
    kept = {r.doc_id: r.kept for r in judge(clean).collect()}
    assert all(v == (k % 9 != 0) for k, v in kept.items())


def test_quality_thresholds_by_hand(spark):
    """kept against quantiles of the sorted ratios: groups are small enough for their sketches to be exact."""
    import math

    from datelode.llm.quality_rules import FENCE, FLOORS, GAP, MIN_POSITIVE, RARE, RATES, base_counts, judge, thresholds, with_ratios

    rng = random.Random(11)
    rows = []
    for k in range(700):
        lang, source = rng.choice([("en", "a"), ("en", "b"), ("de", "a"), (None, "c"), ("", "c")]) if k else ("fr", "z")
        words = [rng.choice(["w%d" % rng.randrange(999), "long%dword" % rng.randrange(99), *(["#"] if source == "a" else [])]) for _ in range(rng.randint(15, 60))]
        if rng.random() < 0.2:
            words[10:18] = words[:8]
        if rng.random() < 0.15:
            words = [w + "#$" * rng.choice([0, 1, 3]) for w in words] if source == "b" else [w + "%&|" for w in words]
        if rng.random() < 0.1:
            words = [w[:1] + w[-1:] for w in words]
        lines = [" ".join(words[a : a + 5]) for a in range(0, len(words), 5)]
        rows.append((k, "\n".join(lines + [lines[0]] * rng.choice([0, 0, 0, 0, 3])), lang, source, 0, "h"))
    df = spark.createDataFrame(rows, DOC)
    ratios = {r.doc_id: r for r in with_ratios(base_counts(df)).collect()}
    kept = {r.doc_id: r.kept for r in judge(df, min_group=60).collect()}
    fences = {(r.lang, r.source): r for r in thresholds(with_ratios(base_counts(df)), 60).collect()}
    groups = {}
    for k, _, lang, source, *_ in rows:
        if not ratios[k].base_failed:
            for g in ((lang, source), (lang,), ()):
                groups.setdefault(g, []).append(k)
    quantile = lambda v, p: sorted(v)[max(0, math.ceil(p * len(v)) - 1)]

    def by_hand(c, lang, source):
        for tier, g in enumerate(((lang, source), (lang,), ())):
            every = [ratios[x][c] for x in groups.get(g, [])]
            some = [x for x in every if x > 0]
            q1, q3 = quantile(every, 0.25), quantile(every, 0.75)
            usual = c not in RATES or len(some) >= RARE * len(every)
            if tier < 2 and (len(every) < 60 or not usual and len(some) < MIN_POSITIVE):
                continue
            if usual or len(some) < MIN_POSITIVE:
                spread = FENCE * max(q3 - q1, FLOORS[c])
                return q1 - spread, q3 + spread, "usual" if usual else "floor", tier
            low, p1, p3 = (quantile(some, p) for p in (0.1, 0.25, 0.75))
            if low >= GAP * (p3 - p1) and low / 2 >= FLOORS[c]:
                return 0.0, low / 2, "apart", tier
            return p1 - FENCE * (p3 - p1), p3 + FENCE * (p3 - p1), "tail", tier

    beyond, seen = 0, set()
    for k, _, lang, source, *_ in rows:
        ok = not ratios[k].base_failed
        for c in FLOORS:
            low, high, how, tier = by_hand(c, lang, source)
            seen.add((how, tier))
            if ok:
                got = fences[lang, source][f"fence_{c}"]
                assert (got.how, got.tier) == (how, tier) and math.isclose(got.high, high) and math.isclose(got.low, low, abs_tol=1e-12), (c, lang, source, got)
            ok &= not (ratios[k][c] > high or c == "word_length" and ratios[k][c] < low)
        assert kept[k] == ok, k
        beyond += not ok and not ratios[k].base_failed
    assert beyond > 5 and {how for how, _ in seen} >= {"usual", "apart", "tail"} and {tier for _, tier in seen} == {0, 1, 2}


def test_quality_thresholds_follow_the_group(spark):
    """The same text is usual in a source full of symbols and junk in one without; null and empty source are two groups."""
    from datelode.llm.quality_rules import base_counts, judge, thresholds, with_ratios

    rng = random.Random(3)
    prose = lambda: " ".join(rng.choices([f"word{j}" for j in range(400)], k=60))
    code = lambda: " ".join(w + rng.choice(["$", "&&", "|<", ""]) for w in prose().split())
    rows = [(k, code() if source == "" else prose(), "en", source, 0, "h") for k, source in enumerate(["", None] * 300)]
    rows += [(k, code(), "en", None, 0, "h") for k in range(1000, 1030)]
    df = spark.createDataFrame(rows, DOC)
    fences = {r.source: r.fence_symbol_ratio for r in thresholds(with_ratios(base_counts(df))).collect()}
    assert set(fences) == {"", None} and (fences[""].how, fences[None].how) == ("usual", "apart") and fences[""].high > 3 * fences[None].high
    kept = {r.doc_id: r.kept for r in judge(df).collect()}
    assert all(kept[k] for k in range(600)) and not any(kept[k] for k in range(1000, 1030))


def test_toxicity(spark):
    from datelode.llm.toxicity import toxicity, without_toxic

    rng = random.Random(6)
    words = [f"t{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(900):
        w = rng.choices(words, k=40)
        if toxic := k % 5 == 0:
            w[7], w[20] = "badword", "Xlot" + rng.choice(words)
        docs.append((k, " ".join(w), "en", "s", 0, "h"))
        labels.append((k, 1, int(toxic)))
    docs += [(2000, None, "en", "s", 0, "h"), (None, "t1 badword", "en", "s", 0, "h")]
    df, lab = spark.createDataFrame(docs, DOC), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity(df, lab).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.97
    clash = df.selectExpr("*", "doc_id AS score", "'x' AS predicted", "text AS body", "1 AS `a.b`")
    left = without_toxic(clash, lab)
    assert left.columns == clash.columns and {r.doc_id for r in left.collect()} == {r.score for r in left.collect()} == {r.doc_id for r in got if not r.predicted}
    assert set(without_toxic(df, lab).columns) == set(df.columns) and toxicity(df, lab.limit(0)).where("predicted = 1").count() == 0 and toxicity(df.limit(0), lab).count() == 0


def test_html(spark):
    from datelode.llm.html_crf import blocks, extract, features, labelled_pages, labels_of, trained

    field, right, total = trained(), 0, 0
    for page, main in labelled_pages(60, seed=99):
        b = blocks(page)
        y = labels_of(b, main)
        assert sum(y) == len(main)
        right += sum(a == c for a, c in zip(y, field.viterbi(features(b)), strict=True))
        total += len(y)
    assert right / total > 0.97
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One  two\n three is <b>bold</b> text, long enough.<p>Second paragraph here, with some words.</article><div class=comments><p>Nice post, thanks!</p></div><footer>&copy; x</footer><script>var a='<p>no</p>'</script>"
    df = spark.createDataFrame([(1, "u", page, "t"), (2, None, None, "t"), (3, "u", "", "t"), (4, "u", "<<a <p", "t"), (1, "u", page, "t")], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in extract(df).collect()]
    want = "A & B\nOne two three is bold text, long enough.\nSecond paragraph here, with some words."
    assert got.count((1, want, len(want))) == 2 and (2, "", 0) in got and (3, "", 0) in got and len(got) == 5 and extract(df.limit(0)).count() == 0


def test_html_is_read_in_linear_time():
    import time

    from datelode.llm.html_crf import blocks, features, labelled_pages, main_text, trained

    field = trained()
    for page, _ in labelled_pages(40, seed=5):
        b = blocks(page)
        assert field.labels(b) == field.viterbi(features(b))
    n = 60_000
    pages = ["<a " * n, "<a '\">" * n, "<a \">" * n, "<a '>" * n, "<div>x" * n, "<li><ul>" + "<div>" * 10_000 + "<li>x</li>" * n, "</b>" * n, "<p>x<div>" * n, "<!-" * n, "<!--" * n, "<script>" * n, "&amp" * n, "<div>" * n + "</i></span></li>" * n, "<" * n, "<b>x" * n, "<span><b>" * n + "<p></u>" * n]
    for page in pages:
        began = time.perf_counter()
        main_text(page, field)
        assert time.perf_counter() - began < 15, page[:20]
    assert blocks("<p>1 < 2 and <b 3")[0][0] == "1 < 2 and <b 3" and [x[0] for x in blocks("<p title='a>b'>x<p title='>y")] == ["x", "y"]
    deep = blocks("<div class=a>" * 10_000 + "x")
    assert len(deep) == 1 and deep[0][1].own() == ["in:div", "name:a"]


def test_decontamination_keeps_other_columns(spark):
    from datelode.llm import decontaminate as d

    w = " ".join(f"w{k}" for k in range(12))
    df = spark.createDataFrame([("x", f"a {w} b", 1, "r", "b", 2), (None, None, 2, "r2", "b2", 3)], "doc_id string, text string, row long, body string, places string, `a.b` long")
    bench = spark.createDataFrame([(1, w)], "item_id long, text string")
    out = d.decontaminated(df, bench)
    assert out.columns == df.columns and [(r.doc_id, r.text, r.row, r.body, r.places, r["a.b"]) for r in out.orderBy("row").collect()] == [("x", "a  b", 1, "r", "b", 2), (None, "", 2, "r2", "b2", 3)]
    assert {(r.doc_id, r.n_hit) for r in d.contamination(df, bench).collect()} == {("x", 12), (None, 0)}


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark):
    import corpus_pipeline as p

    one, other = " ".join(f"one{k}" for k in range(60)), " ".join(f"other{k}" for k in range(60))
    rows = [(1, one), (7, one), (7, other), (9, "x y z"), (9, "x y z"), (None, one), (None, "null id of its own"), (11, None), (12, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "h") for i, t in rows], DOC)
    left = p.drop_near_duplicates(spark, docs, "")
    assert left.columns == docs.columns and Counter(r.text or "" for r in left.collect()) == {one: 1, other: 1, "x y z": 1, "null id of its own": 1, "": 1}
    unique = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    assert {r.doc_id for r in p.drop_near_duplicates(spark, unique, "").collect()} <= {1, 7, 9, 11}
    assert p.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_pipeline(spark, tmp_path):
    """run() against each stage's decision made by hand on a small corpus."""
    from tokenizers import Tokenizer

    import corpus_pipeline as p
    from datelode.llm import queries
    from datelode.llm.simhash import fingerprint
    from datelode.llm.toxicity import score, train

    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))
    passage, item = prose(60), prose(14)
    texts = [prose(120) for _ in range(60)]
    for k in range(0, 60, 3):
        texts[k] = " ".join([texts[k][:200], "badword Xlot", texts[k][200:]])
    texts += [f"{prose(70)} {passage} {prose(70)}" for _ in range(4)] + [f"{prose(80)} {item} {prose(40)}", texts[1], texts[1], None, ""]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), "h") for k, t in enumerate(texts)], DOC)
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(60)], "doc_id long, quality int, toxic int")
    docs.drop("host").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in p.run(spark, str(tmp_path)).collect()}
    bad = {r.doc_id for r in score(docs, train(docs, labels), "doc_id").collect() if r.predicted}
    assert len(bad & set(range(0, 60, 3))) > 15 and not bad - set(range(0, 60, 3))
    left, seen = {}, []
    for k, t in enumerate(texts):
        fp = fingerprint((t or "").encode())
        if k not in bad and all((fp ^ x).bit_count() > 3 for x in seen):
            left[k] = t or ""
            seen.append(fp)
    words = {k: t.split() for k, t in left.items()}
    count = Counter(tuple(w[a : a + 50]) for w in words.values() for a in range(len(w) - 49))
    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    assert set(got) == set(left)
    for k, w in words.items():
        gone = {x for a in range(len(w) - 49) if count[tuple(w[a : a + 50])] > 1 for x in range(a, a + 50)}
        kept = " ".join(x for a, x in enumerate(w) if a not in gone).replace(item, "")
        assert got[k].n_tokens == len(tokenizer.encode(kept, add_special_tokens=False).ids), k
    assert sum(got[k].n_tokens < 400 for k in range(60, 64)) == 4
    assert set(queries.oracle_sql()) <= set(queries.queries()) and [name for name, _ in p.STAGES] == ["toxicity", "near_duplicates", "repeats", "benchmark", "bpe"]
