"""Quality rules with adaptive thresholds, in DataFrame functions only.

Four ratios of each text (symbols a letter, repeated words a word, repeated lines a line, and the mean word
length) are summed up by mergeable KLL quantile sketches for each language and source, of all values and,
for the first three, of those above zero; a group's sketches join its language's and the whole corpus's by
merging. A group's thresholds come from its own sketches, if it holds MIN_GROUP texts and, where fewer
than RARE of them are above zero, MIN_POSITIVE of these; else from its language's, else from all texts'.

* Where RARE of the texts or more are above zero (word length: always), the value is usual in the group, and the
  far fence of its quartiles is the threshold: q3 + FENCE * (q3 - q1), for word length also q1 less as much.
* Where it is rare but comes in all sizes, its own far fence is the threshold: the same of the values above zero.
* Where it is rare and detached, that is its lowest tenth still stands GAP of its interquartile range above zero,
  these texts are a kind of their own, and the threshold is half way to them.
* Where even the corpus has fewer than MIN_POSITIVE, nothing can be learnt, and the spread of FLOORS stands for the
  quartiles'; FLOORS also guard against a width of zero: a constant is no spread.

The sketches draw at random: ranks are right to about 0.3 % (K = 1,000), and exact in groups of up to K
texts, so thresholds of large groups differ by as much between two runs. They are written once a run and joined back,
broadcast if they are few, otherwise by a join in which groups are salted. Texts that fail the base rules
do not enter the sketches.

Null text has no words and fails the base rules; null language or source is a group of its own, the empty one another;
repeated rows are judged alike; other columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
FENCE = 5.0
MIN_GROUP, MIN_POSITIVE = 200, 20
RARE, GAP = 0.25, 0.25
#: Size of a sketch.
K = 1000
#: Groups whose thresholds are broadcast; more are joined with salted keys.
BROADCAST_GROUPS = 50_000
SALTS = 16
_BLANK = "\\x20\\x09-\\x0D"
#: Ratio -> the spread of its quartiles where there is none to learn from.
FLOORS = {"symbol_ratio": 0.02, "repeat_ratio": 0.03, "dup_line_ratio": 0.05, "word_length": 0.1}
RATES = ["symbol_ratio", "repeat_ratio", "dup_line_ratio"]
GROUP = ["lang", "source"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row; inside lambdas it is a variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows of that many words that occur twice or more in the text."""

    def covered(at: Column) -> Column:  # at: sorted starts of repeated windows
        gaps = F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda k: F.least(F.lit(window), F.get(at, k) - F.get(at, k - 1)))
        return F.when(F.size(at) == 0, F.lit(0)).when(F.size(at) == 1, F.lit(window)).otherwise(F.aggregate(gaps, F.lit(window), lambda a, b: a + b))

    def starts(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
        same = lambda o, a, b: F.get(o, a)["h"] == F.get(o, b)["h"]
        return _let(ordered, lambda o: F.array_sort(F.transform(F.filter(F.transform(o, lambda x, k: F.struct(x["k"].alias("k"), (F.coalesce(same(o, k, k - 1), F.lit(False)) | F.coalesce(same(o, k, k + 1), F.lit(False))).alias("twice"))), lambda x: x["twice"]), lambda x: x["k"])))

    def of(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(1), F.size(w) - window + 1), lambda k: F.xxhash64(F.slice(w, k, window)))
        return F.when(F.size(w) <= window, F.lit(0)).otherwise(_let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(starts(h), covered))))

    return _let(words, of).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each row, with base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, f"[{_BLANK}]+"), lambda w: w != "")
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{_BLANK}]"))
    counts = docs.select(
        "doc_id",
        "lang",
        "source",
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("w"),
        _let(bare, lambda b: F.struct(F.length(b).cast("long").alias("word_chars"), (F.length(b) - F.length(F.translate(b, "#*$%&|<>", ""))).cast("long").alias("n_symbols"))).alias("c"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    )
    out = counts.select("doc_id", "lang", "source", "w.n_words", "c.word_chars", "c.n_symbols", "l.n_dup_lines", "l.n_lines", "w.n_repeat_words")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def with_ratios(counts: DataFrame) -> DataFrame:
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return counts.withColumns({"symbol_ratio": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)), "repeat_ratio": per_word("n_repeat_words"), "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "word_length": per_word("word_chars")})


def _fence(c: str, tier: int, min_group: int, fence: float) -> tuple[Column, Column]:
    """(low, high, how) of a ratio in one tier, and whether the tier may be trusted with it."""
    q = lambda sketch, *ranks: F.kll_sketch_get_quantile_double(F.col(f"{sketch}_{c}{tier}"), F.array(*map(F.lit, ranks)))
    wide = lambda x, least: F.struct((x[0] - fence * F.greatest(x[1] - x[0], F.lit(least))).alias("low"), (x[1] + fence * F.greatest(x[1] - x[0], F.lit(least))).alias("high"))
    put = lambda s, how: F.struct(s["low"].alias("low"), s["high"].alias("high"), F.lit(how).alias("how"))
    usual = _let(q("all", 0.25, 0.75), lambda x: put(wide(x, FLOORS[c]), "usual"))
    enough = F.col(f"n{tier}") >= min_group
    if c not in RATES:
        return usual, enough
    n, above = F.col(f"n{tier}"), F.col(f"above_{c}{tier}")
    apart = lambda x: (x[0] >= GAP * (x[2] - x[1])) & (x[0] / 2 >= FLOORS[c])
    tail = lambda x: put(wide(F.array(x[1], x[2]), 0.0), "tail")
    rare = _let(q("some", 0.1, 0.25, 0.75), lambda x: F.when(apart(x), F.struct(F.lit(0.0).alias("low"), (x[0] / 2).alias("high"), F.lit("apart").alias("how"))).otherwise(tail(x)))
    learnt = F.when(above >= RARE * n, usual).when(above >= MIN_POSITIVE, rare).otherwise(_let(q("all", 0.25, 0.75), lambda x: put(wide(x, FLOORS[c]), "floor")))
    return learnt, enough & ((above >= RARE * n) | (above >= MIN_POSITIVE))


def thresholds(ratios: DataFrame, min_group: int = MIN_GROUP, fence: float = FENCE) -> DataFrame:
    """lang, source, and fence_<ratio> (low, high, how, tier 0: own, 1: language, 2: all): one row a group."""
    sums = [F.count("*").alias("n"), *[F.kll_sketch_agg_double(c, K).alias(f"all_{c}") for c in FLOORS]]
    sums += [x for c in RATES for x in (F.count_if(F.col(c) > 0).alias(f"above_{c}"), F.kll_sketch_agg_double(F.when(F.col(c) > 0, F.col(c)), K).alias(f"some_{c}"))]
    sketches = ratios.where(~F.col("base_failed")).groupBy(*GROUP).agg(*sums)
    again = [F.kll_merge_agg_double(c, K).alias(c) if c.startswith(("all_", "some_")) else F.sum(c).alias(c) for c in sketches.columns if c not in GROUP]
    named = lambda df, tier: df.select(*[c for c in df.columns if c in GROUP], *[F.col(c).alias(f"{c}{tier}") for c in df.columns if c not in GROUP])
    own, lang, every = named(sketches, 0), named(sketches.groupBy("lang").agg(*again), 1), named(sketches.groupBy().agg(*again), 2)
    found = _matched(own, lang, ["lang"]).crossJoin(F.broadcast(every))  # the last has one row
    out = []
    for c in FLOORS:
        tiers = [_fence(c, k, min_group, fence) for k in range(3)]
        at = lambda k: tiers[k][0].withField("tier", F.lit(k))  # noqa: B023, E731
        out.append(F.when(tiers[0][1], at(0)).when(tiers[1][1], at(1)).otherwise(at(2)).alias(f"fence_{c}"))
    return found.select(*GROUP, *out)


def _matched(rows: DataFrame, other: DataFrame, names: list[str], broadcast: bool = False) -> DataFrame:
    """Left join by names, null to null; other's columns of these names are dropped."""
    other = other.withColumnsRenamed({c: f"__{c}" for c in names})
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(F.broadcast(other) if broadcast else other, on, "left").drop(*[f"__{c}" for c in names])


def judge(docs: DataFrame, min_group: int = MIN_GROUP, fence: float = FENCE) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for each row of docs(doc_id, text, lang, source)."""
    from datelode.llm.common import materialize

    ratios = with_ratios(materialize(base_counts(docs)))
    limits = materialize(thresholds(ratios, min_group, fence))
    if limits.count() <= BROADCAST_GROUPS:
        joined = _matched(ratios, limits, GROUP, broadcast=True)
    else:
        salted = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = _matched(ratios.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), salted, [*GROUP, "salt"])
    beyond = F.lit(False)
    for c in FLOORS:
        beyond = beyond | (F.col(c) > F.col(f"fence_{c}.high"))
    beyond = beyond | (F.col("word_length") < F.col("fence_word_length.low"))
    kept = ~F.col("base_failed") & ~F.coalesce(beyond, F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
