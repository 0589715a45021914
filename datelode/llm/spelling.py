"""Spelling variants: words that differ by one code point, without pairs.

Words are the runs of letters of all texts, lower-cased (A-Z), seen at least min_count times in all (n).
Two words are near if one inserted, deleted or replaced code point makes one of the other. Each word's
form is its near word of largest n (ties: the smallest in code-point order) if that n is at least
`factor` times its own; its root is where forms lead.

* Replacements: each word enters a group for each position, keyed by what stands before and behind it
  (prefix*suffix). A group holds the words that differ there and nowhere else, so two words share one
  group at most. Its size less one is what each member has as near words there, its two best words give
  every member its best partner: the second for the best, the best for all others. No pair is formed.
  A group has a row for each letter of the alphabet at most (116).
* Insertions and deletions: each word's different shortenings by one code point are summed up by the
  result (how many words, and the best) and joined with the vocabulary there; the vocabulary joined the
  other way gives each long word its short ones. A word of m code points has m of them at most.
* Both are summed by word: number of near words and the best of them.
* Roots: n grows by `factor` from word to form, so chains are short; unfinished words jump to the form
  of their form until none is left.

Before that a stated share of runs is misspelt: a run whose crc32 of `<doc_id>:<run>` is divisible by
31 loses the code point at crc32 modulo its length. Null doc_id counts as an empty string there; null
text has no runs. Repeated rows count each time; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datelode.llm.common import materialize

MIN_LENGTH, MIN_COUNT, FACTOR = 7, 2, 10
_LETTERS = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every so many runs, by their hash, one loses a code point.
MISSPELT = 31


def without(word: Column, at: Column) -> Column:
    """word without the code point at (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word) of every run of at least min_length letters after misspelling."""
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"[{_LETTERS}]{{{min_length},}}"), F.lit(0))).alias("run"))
    low = found.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run")).alias("run"))
    hashed = low.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    cut = without(F.col("run"), (F.col("h") % F.length("run")).cast("int"))
    return hashed.select(F.when(F.col("h") % MISSPELT == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_length)


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    return runs(docs, min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _places(word: Column) -> Column:
    return F.sequence(F.lit(0), F.length(word) - 1)


def _rank(n: Column, word: Column) -> Column:
    """Sorts the largest n first, then the smallest word."""
    return F.struct((-n).alias("less"), word.alias("word"))


def replaced(words: DataFrame) -> DataFrame:
    """(word, near, best): near words by one replaced code point, none left out."""
    rows = words.select("n", F.col("word").alias("w"), F.explode(_places(F.col("word"))).alias("at"))
    keyed = rows.select(F.concat(F.substring("w", F.lit(1), F.col("at")), F.lit("*"), F.substring("w", F.col("at") + 2, F.length("w"))).alias("key"), F.substring("w", F.col("at") + 1, F.lit(1)).alias("letter"), "n")
    group = Window.partitionBy("key")
    order = group.orderBy(F.desc("n"), "letter")
    ranked = keyed.withColumns({"k": F.row_number().over(order), "size": F.count("*").over(group)}).where("size > 1")
    two = [F.max(F.when(F.col("k") == i, F.struct("n", "letter"))).over(group) for i in (1, 2)]
    best = ranked.withColumns({"first": two[0], "second": two[1]}).withColumn("best", F.when(F.col("k") == 1, F.col("second")).otherwise(F.col("first")))
    whole = lambda letter: F.concat(F.substring_index("key", "*", 1), letter, F.substring_index("key", "*", -1))
    return best.select(whole(F.col("letter")).alias("word"), (F.col("size") - 1).alias("near"), _rank(F.col("best.n"), whole(F.col("best.letter"))).alias("best"))


def shortened(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, near, best): near words by one inserted or deleted code point."""
    cuts = F.array_distinct(F.transform(_places(F.col("word")), lambda k: without(F.col("word"), k)))
    rows = words.where(F.length("word") > min_length).select(F.col("word").alias("long"), "n", F.explode(cuts).alias("word"))
    known = words.select("word", F.col("n").alias("short_n"))
    met = materialize(rows.join(known, "word"))
    longer = met.groupBy("word").agg(F.count("*").alias("near"), F.min(_rank(F.col("n"), F.col("long"))).alias("best"))
    shorter = met.groupBy("long").agg(F.count("*").alias("near"), F.min(_rank(F.col("short_n"), F.col("word"))).alias("best"))
    return longer.union(shorter.select(F.col("long").alias("word"), "near", "best"))


def forms(words: DataFrame, factor: int = FACTOR, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n, n_near, form, form_n) of each row of words(word, n)."""
    near = replaced(words).union(shortened(words, min_length)).groupBy("word").agg(F.sum("near").alias("near"), F.min("best").alias("best"))
    out = words.join(near, "word", "left")
    enough = -F.col("best.less") >= factor * F.col("n")
    return out.select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))


def with_roots(words: DataFrame) -> DataFrame:
    """Adds root: the end of the chain of forms, the word itself if it has none."""
    links = materialize(words.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(links.select("word", "root").join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = step.select("word", "root")
        if step.where("moved").isEmpty():
            return words.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of docs(doc_id, text)."""
    words = materialize(vocabulary(docs, min_length, min_count))
    return with_roots(materialize(forms(words, factor, min_length))).select("word", "form", "root", "n", "n_near", "form_n")
