"""One case for each finding of FINDINGS_r03.md."""

import random
import re
from collections import Counter

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, host string"


def by_hand(texts, n):
    """(maximal runs, words) covered by n words that start twice, for each text."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[k : k + n]) for w in split for k in range(len(w) - n + 1))
    out = []
    for w in split:
        gone = {x for a in range(len(w) - n + 1) if count[tuple(w[a : a + n])] > 1 for x in range(a, a + n)}
        out.append((sum(x - 1 not in gone for x in gone), len(gone)))
    return out


@pytest.mark.parametrize("words", [50, 9])
@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_reports_passages_of_words(spark, seed, words):
    from datelode.llm.suffix_dedup import report

    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "of", "thé", "x" * 30, "".join(rng.choices("abcde", k=rng.randint(1, 9)))])
    pool = [[word() for _ in range(rng.randint(20, 200))] for _ in range(8)]
    texts = [None, "", "a " * 130, "a b\n" * 60, "c d e " * 100, " " + " ".join(pool[0]) + " \t", "\n".join(pool[0]), " ".join(pool[1]), " ".join(pool[1])]
    texts += [" ".join(word() for _ in range(n)) for n in (words - 1, words, words + 1)] * 2
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) - 1)
            parts += p[a : a + rng.randint(1, 120)] if rng.random() < 0.6 else [word() for _ in range(rng.randint(1, 90))]
        texts.append("".join(w + rng.choice([" ", "\n", "  "]) for w in parts))
    ids = [k // 2 if seed == 2 else k for k in range(len(texts))]  # repeated ids too
    df = spark.createDataFrame([(i, t, "en", "s", 0, "h") for i, t in zip(ids, texts, strict=True)], DOC).repartition(3)
    want = Counter((i, *x) for i, x in zip(ids, by_hand(texts, words), strict=True))
    got = report(df, by_words=words)
    assert Counter((r.doc_id, r.n_passages, r.n_passage_words) for r in got.collect()) == want
    assert Counter(r[:5] for r in got.collect()) == Counter(tuple(r) for r in report(df).collect())  # the byte rule is untouched
    assert sum(x > 0 for _, x, _ in want) > 20


def test_op5_tells_planted_passages_below_400_bytes(spark, tmp_path):
    """Passages of 51 words and about 300 bytes: the rule of 400 bytes leaves them, n_passage_words finds them."""
    from datelode.llm.queries import op5_suffix_dedup

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5))
    text = lambda n: [word() for _ in range(n)]
    passages = [text(51) for _ in range(5)]
    texts = [text(100) + passages[k % 5] + text(60) for k in range(20)] + [text(200) for _ in range(20)]
    spark.createDataFrame([(k, " ".join(t), "en", "s", 0, "h") for k, t in enumerate(texts)], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(op5_suffix_dedup(spark, str(tmp_path)).collect())
    assert [r.n_removed for r in got] == [0] * 40
    assert [(r.n_passages, r.n_passage_words) for r in got] == [(1, 51)] * 20 + [(0, 0)] * 20


def test_op5_compares_edges_with_copies(spark):
    """Texts that share only part of the windows of a core with whole copies, at each place."""
    from datelode.llm.suffix_dedup import report

    rng = random.Random(5)
    text = lambda n: ["".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]
    base = text(160)
    texts = [" ".join(base)] * 3 + [" ".join(text(3) + base[a : a + n] + text(3)) for a in range(0, 100, 3) for n in (49, 50, 57)]
    df = spark.createDataFrame([(k, t, "en", "s", 0, "h") for k, t in enumerate(texts)], DOC).repartition(4)
    assert [(r.n_passages, r.n_passage_words) for r in sorted(report(df, by_words=50).collect())] == by_hand(texts, 50)


def test_cores_of_windows_across_blocks():
    """Each window's core is that of its runs of words with the least hash, wherever blocks, texts and long words end."""
    import numpy as np

    from datelode.llm.passages import Texts, ranges

    rng = random.Random(7)
    bodies = [" ".join(rng.choice(["a", "bc", "d" * 40, str(rng.random())]) for _ in range(n)).encode() for n in (70_000, 0, 49, 50, 33_000)]
    texts = Texts(bodies)
    assert np.diff(texts.start).tolist() == [70_000, 0, 49, 50, 33_000]
    want = []
    for text, first, end in zip(range(5), texts.start[:-1].tolist(), texts.start[1:].tolist(), strict=True):
        a = np.arange(first, end - 19)
        g = (texts.hashes(0, a, a + 20) >> np.uint64(24)).tolist()
        want += [(text, w, min(range(w, w + 31), key=g.__getitem__)) for w in range(end - first - 49)]
    got = [(t, w, at) for t, a, n, at in zip(*(x.tolist() for x in ranges(texts, 50, 20)), strict=True) for w in range(a, a + n)]
    assert got == want
    one, other = Texts([b"x y " + b"w" * 40 + b"\tz"]), Texts([b"q", b"y\n" + b"w" * 40 + b" z u"])
    assert all(one.hashes(k, np.array([1]), np.array([4])) == other.hashes(k, np.array([1]), np.array([4])) for k in (0, 1))


def test_toxicity_sends_packed_terms_and_fits_in_little_memory(spark, monkeypatch):
    """The sample reaches the driver as compressed gaps; fitting holds it once and leaves the rows it was given."""
    import tracemalloc

    import numpy as np

    from datelode.llm import toxicity

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, toxicity.BUCKETS, 2000).astype(np.int32)) for _ in range(4000)] + [np.zeros(0, dtype=np.int32)]
    packed = [toxicity.pack(t) for t in sets]
    assert all((toxicity.unpack(p) == t).all() and toxicity.unpack(p).dtype == np.int32 for p, t in zip(packed, sets, strict=True))
    raw = sum(t.nbytes for t in sets)
    assert 2 * sum(map(len, packed)) < raw
    rows = [(t, k % 2) for k, t in enumerate(sets)]
    tracemalloc.start()
    toxicity.fit(rows, epochs=0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < raw + 40_000_000  # 58 MB, with 32 of filtered rows; 112 when all terms were put into one array
    assert all(t is s for (t, _), s in zip(rows, sets, strict=True))

    seen, word = [], toxicity.Terms()
    monkeypatch.setattr(toxicity, "fit", lambda rows, *a, **k: seen.extend(rows))
    docs = spark.createDataFrame([(k, " ".join(f"w{k * j}" for j in range(30)), "en", "s", 0, "h") for k in range(40)], DOC)
    toxicity.train(docs, spark.createDataFrame([(k, 1, k % 2) for k in range(40)], "doc_id long, quality int, toxic int"))
    want = {k: word.of(" ".join(f"w{k * j}" for j in range(30)).encode()).tolist() for k in range(40)}
    assert seen and all(t.tolist() in want.values() and y in (0, 1) for t, y in seen)


def test_token_ids_gather_from_one_array(monkeypatch):
    """Each pre-token's ids stand once in one array, whatever was forgotten or broke off in between; ids are the library's."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from datelode.llm import token_ids

    file = public_tokenizers.path("word_bpe_49k.json")
    library, encoder, rng = Tokenizer.from_file(file), token_ids.ChunkEncoder(file), random.Random(2)
    words = ["".join(rng.choices("abcdeéñßſ'7,.;", k=rng.randint(1, 12))) for _ in range(9000)] + ["don't", "I'll", "ſ", "ƀ", "名", "<|endoftext|>", "<|", "�", "É"]
    texts = ["", " ", *words[-9:], *(" ".join(rng.choices(words[:9000] if k % 3 else words, k=rng.randint(0, 300))) for k in range(200))]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want and encoder.encode([]) == [] and encoder.encode(["", "名"])[0] == b""
    assert len(encoder.offsets) == len(encoder.words) + 1 and encoder.offsets[-1] == len(encoder.ids)
    size = len(encoder.ids)
    assert encoder.encode(texts[::-1]) == want[::-1] and len(encoder.ids) == size  # nothing is encoded twice

    whole = encoder._whole
    monkeypatch.setattr(encoder, "_whole", lambda text: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        encoder.encode(["quite new wordsx"])
    monkeypatch.setattr(encoder, "_whole", whole)
    assert encoder.encode([*texts, "quite new wordsx"])[:-1] == want
    monkeypatch.setattr(token_ids, "CACHE_ENTRIES", 50)
    assert [encoder.encode([t])[0] for t in texts] == want
    assert [t for t in texts if encoder.odd(t)] == [t for t in texts if re.search("<\\||[^\0-ſ]", t)]
