
import hashlib
import random

import numpy as np

DOC = "doc_id long, text string, lang string, source string, n_chars long, host string"


def documents(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", 0, "h") for k, t in enumerate(texts)], DOC)


def test_suffix_dedup_tells_phrases_of_a_common_line_apart(spark):
    from datelode.llm.suffix_dedup import report

    line = hashlib.shake_256(b"line0").hexdigest(60)
    one, other = (line + hashlib.shake_256(b"%d" % k).hexdigest(300) for k in (61615, 41435))  # their first phrases' hashes agree in 31 bits
    assert [r.n_removed for r in report(documents(spark, [one, other])).collect()] == [0, 0]


def test_suffix_dedup_compares_decided_phrases_with_unguarded_ones(spark):
    from datelode.llm.suffix_dedup import Parse, report, triggers

    rng = random.Random(8)

    def quiet(n):
        """n letters without a trigger."""
        out = ""
        while len(out) < n:
            letter = rng.choice("abcdefghij")
            if not len(triggers(np.frombuffer((out + letter)[-8:].encode(), np.uint8))):
                out += letter
        return out

    while True:
        passage = quiet(300) + "".join(rng.choices("klmnopqrst", k=400))
        p = Parse(passage.encode())
        if p.start[1] in range(280, 310) and p.guards[0] == 1:
            break
    part = quiet(200) + passage[:600]
    assert Parse(part.encode()).guards[0] == 0
    assert [r.n_removed for r in sorted(report(documents(spark, [passage, passage, part])).collect())] == [700, 700, 600]


def test_toxicity_learns_a_pair_of_neutral_words(spark):
    from datelode.llm.toxicity import toxicity

    rng = random.Random(9)
    words, docs, toxic = [f"t{k}" for k in range(300)], [], []
    for _ in range(1600):
        a, b = rng.randrange(2), rng.randrange(2)
        docs.append(" ".join([*rng.choices(words, k=20), ("idiots", "morons")[a], ("dutch", "danes")[b]]))
        toxic.append(int(a == b))
    labels = spark.createDataFrame([(k, 1, y) for k, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    held = [r for r in toxicity(documents(spark, docs), labels).collect() if r.held_out]
    assert sum(r.predicted == toxic[r.doc_id] for r in held) / len(held) > 0.95


def test_decontamination_by_blocks_is_that_of_one_block(spark, monkeypatch):
    from datelode.llm import decontaminate as d

    w = [f"w{k}" for k in range(40)]
    first, second, split = " ".join(w[:12]), " ".join(w[6:20]), " ".join([*w[25:30], *w[30:35]])
    bench = spark.createDataFrame([(1, first), (2, second), (3, split), (None, first)], "item_id long, text string").coalesce(1)
    texts = [" ".join(w[:20]) + " end", " ".join([*w[25:30], *w[:12], *w[30:35]]), None, "nothing here"]  # overlap; words that a cut brings together
    df = documents(spark, texts)
    report = lambda: sorted(map(tuple, d.contamination(df, bench).collect()))
    cut = lambda: [r.text for r in d.decontaminated(df, bench).orderBy("doc_id").collect()]
    want = report(), cut()
    assert want[1] == [" end", " ".join(w[25:30]) + "  " + " ".join(w[30:35]), "", "nothing here"] and want[0][0][3] == 3
    blocks = d.phrase_blocks
    monkeypatch.setattr(d, "phrase_blocks", lambda items, window: blocks(items, window, 14))
    assert len([*d.phrase_blocks(bench, 10)]) > 2
    assert (report(), cut()) == want  # several blocks in one pass
    monkeypatch.setattr(d, "BLOCKS", 1)
    assert (report(), cut()) == want  # a pass for each


def test_quality_rules_each_find_an_outlier(spark):
    from datelode.llm.quality_rules import judge

    rng = random.Random(7)
    line = lambda n: " ".join(f"word{rng.randrange(10**6)}" for _ in range(n))
    texts = ["\n".join(line(6) for _ in range(10)) for _ in range(400)]
    window = line(8)
    texts.append(" ".join([window, line(24), window, line(24)]))  # 16 of 64 words repeat
    copy = "Share this"
    texts.append("\n".join([x for _ in range(7) for x in (line(10), copy, copy)][:-1]))  # 12 of 20 lines are copies, few words repeat
    texts.append(texts[0].replace("word", "#w##"))  # symbols
    texts.append("\n".join(" ".join("x%d" % rng.randrange(10) for _ in range(40)) for _ in range(2)))  # short words
    got = {r.doc_id: r for r in judge(documents(spark, texts)).collect()}
    assert all(got[k].kept for k in range(400)) and not any(r.base_failed for r in got.values())
    assert 100 * got[400].n_repeat_words == 25 * got[400].n_words and 10 * got[401].n_dup_lines == 6 * 20
    assert [k for k in range(400, 404) if got[k].kept] == []


def test_toxicity_collects_no_more_than_the_sample(spark, monkeypatch):
    from datelode.llm import toxicity

    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, *a, **k: seen.append(len(rows)))
    docs = spark.createDataFrame([(7 if k % 2 else k, f"word{k} text", "en", "s", 0, "h") for k in range(600)], DOC)
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(600)], "doc_id long, quality int, toxic int")
    toxicity.train(docs, labels, sample=50)
    toxicity.train(docs, labels.where("doc_id = 7"), sample=50)
    assert 0 < seen[0] <= 50 and seen[1] == 50


def test_url_filter_is_linear_in_the_host(spark):
    import time

    from datelode.llm.url_filter import judge

    rules = spark.createDataFrame([("net", "/", "block"), ("a.b.net", "/", "allow")], "host string, path string, verdict string")
    urls = ["http://" + ".".join(["x"] * 4000) + ".a.b.net/q", "http://" + ".".join(["x"] * 4000) + ".net/q", "http://a.b.net/", "http://b.net/", "http://net", "http://" + "y" * 8000 + ".org/"]
    run = lambda some: {r.page_id: (r.rule, r.verdict) for r in judge(spark.createDataFrame(list(enumerate(some)), "page_id int, url string"), rules).collect()}
    run(["http://net/"])
    began = time.perf_counter()
    run(["http://a.net/", "http://b.net/"] * 3)
    short = time.perf_counter() - began
    began = time.perf_counter()
    assert run(urls) == {0: ("a.b.net/", "allow"), 1: ("net/", "block"), 2: ("a.b.net/", "allow"), 3: ("net/", "block"), 4: (None, "allow"), 5: (None, "allow")}
    assert time.perf_counter() - began < 2 * short + 3


def test_decontamination_drops_the_blocks_of_a_pass(spark, monkeypatch):
    from datelode.llm import decontaminate as d

    rng = random.Random(12)
    words = [f"w{k}" for k in range(80)]
    items = [(f"i{k}", " ".join(rng.choices(words, k=14))) for k in range(40)]
    docs = documents(spark, [" ".join([*rng.choices(words, k=30), *(items[rng.randrange(40)][1].split() if k % 2 else [])]) for k in range(30)])
    test = spark.createDataFrame(items, "item_id string, text string")
    want = {tuple(r) for r in d.contamination(docs, test).collect()}
    cut = {tuple(r) for r in d.decontaminated(docs, test).collect()}
    alive, most, made = [0], [0], [0]
    start = d.Phrases.__init__

    def born(self, *a):
        start(self, *a)
        made[0] += 1
        alive[0] += 1
        most[0] = max(most[0], alive[0])

    def gone(self):
        alive[0] -= 1

    monkeypatch.setattr(d.Phrases, "__init__", born)
    monkeypatch.setattr(d.Phrases, "__del__", gone, raising=False)
    blocks = d.phrase_blocks
    monkeypatch.setattr(d, "BLOCKS", 2)
    monkeypatch.setattr(d, "phrase_blocks", lambda items, window: blocks(items, window, 50))
    assert {tuple(r) for r in d.contamination(docs, test).collect()} == want and made[0] >= 10 and most[0] <= 8, (made, most)
    assert {tuple(r) for r in d.decontaminated(docs, test).collect()} == cut
