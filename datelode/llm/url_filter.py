"""URL filters by a Bloom filter cascade, in DataFrame functions only.

A url's keys are the suffixes of its host (host, parent domains) of as many labels as the longest rule has, each
with its path cut to each length that a rule's path has. A cascade stands for a set of listed keys within a universe, here all keys
that the urls of the corpus have: level 0 is a Bloom filter of the listed keys, level 1 one of the
keys of the universe that level 0 wrongly lets through, level 2 one of the listed keys that level 1
lets through, and so on until nothing is left. A key is listed if the first level that does not hold
it is odd. That is exact for every key of the universe, without a join. Filters are literals of the
plan: 64-bit words in an array. Level 0 has as many bits a key as it takes to let through about as many
keys of the universe (counted by a sketch) as it holds, so no level is larger than the listed keys by
more than a few bits a key; a level that lets through more is built anew with more bits. A cascade
holds RULES keys at most: more rules are dealt into blocks by a hash of their keys, and the urls go
through the blocks one after the other, each with the best rule so far.

Null urls and urls without '://' have empty host and path, fit no rule and are allowed; repeated rows
stay; other columns are dropped; without rules every verdict is the default.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datelode.llm.common import materialize

#: Listed keys that one cascade (a literal of the plan) is made for.
RULES = 200_000
#: Share of foreign keys that a level lets through, at most.
FALSE_POSITIVES = 1 / 256


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first '://', and the path up to '?' or '#'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.substring_index(F.substring_index(F.regexp_replace(rest, r"(?s)^[^/?#]*", ""), "?", 1), "#", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def keys_of(host: Column, path: Column, lengths: list[int], labels: int) -> Column:
    """Keys of a url, longest first: each host suffix of up to so many labels with the path cut to each length that rules have.

    Suffixes are read from the right, so a host of any length costs its bytes times labels.
    """
    hosts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(labels)), lambda k: F.call_function("substring_index", host, F.lit("."), -k)))
    prefixes = F.array_distinct(F.array(*[F.substring(path, 1, n) for n in lengths]))
    both = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    by_length = F.array_sort(F.transform(both, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.reverse(F.transform(by_length, lambda s: s["k"])))


class Bloom:
    """One level: bits set for the n keys of df(key), as words."""

    def __init__(self, df: DataFrame, level: int, n: int, share: float) -> None:
        self.level, self.hashes = level, math.ceil(math.log2(1 / share))
        self.bits = max(64, (math.ceil(1.4427 * self.hashes * n) + 63) // 64 * 64)
        spots = df.select(F.explode(F.array(*self._probes(F.col("key")))).alias("bit"))
        words = spots.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("set"))
        self.words = [0] * (self.bits // 64)
        for r in words.collect():  # at most bits / 64 rows
            self.words[r.word] = r.set

    def _probes(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.level), F.lit(k), key), F.lit(self.bits)) for k in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        words = F.lit(self.words).cast("array<bigint>")
        tests = [F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1 for p in self._probes(key)]
        return reduce(Column.__and__, tests)


class Cascade:
    """Exact membership of listed keys within a universe of keys."""

    def __init__(self, listed: DataFrame, universe: DataFrame, max_levels: int = 40) -> None:
        """listed(key), universe(key): the universe may repeat keys."""
        self.levels: list[Bloom] = []
        held = listed.select("key").distinct()
        n = held.count()
        size = max(1, universe.agg(F.approx_count_distinct("key")).first()[0]) if n else 1
        other = universe.select("key")
        while n:
            if len(self.levels) == max_levels:
                raise RuntimeError("the cascade does not end")
            share = min(FALSE_POSITIVES, n / size)
            while True:
                bloom = Bloom(held, len(self.levels), n, share)
                slipped = other.where(bloom.holds(F.col("key")))
                if not self.levels:  # the universe has the listed keys too, and repeats keys
                    slipped = slipped.select("key", F.lit(0).alias("own")).union(held.select("key", F.lit(1))).groupBy("key").agg(F.max("own").alias("own")).where("own = 0").select("key")
                slipped = materialize(slipped)
                m = slipped.count()
                if m <= 4 * n + 1000:
                    break
                share /= 64  # the sketch was far off
            self.levels.append(bloom)
            other, held, size, n = held, slipped, n, m

    def holds(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for k, bloom in reversed(list(enumerate(self.levels))):
            out = F.when(~bloom.holds(key), F.lit(k % 2 == 1)).otherwise(out)
        return out


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", max_rules: int = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages(page_id, url).

    rules(host, path, verdict): verdict 'block' or 'allow'. The longest rule wins, block before allow
    where both list the same key. Without a fitting rule the verdict is default.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    lengths = sorted(r.n for r in rules.select(F.length("path").alias("n")).distinct().collect()) or [0]
    labels = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    rows = rows.withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths, labels))
    universe = rows.select(F.explode("keys").alias("key"))
    listed = rules.select(F.concat("host", "path").alias("key"), "verdict")
    blocks = max(1, -(-listed.count() // max_rules))
    for b in range(blocks):
        some = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b)
        block = Cascade(some.where("verdict = 'block'"), universe)
        allow = Cascade(some.where("verdict = 'allow'"), universe)
        rule = F.get(F.filter("keys", lambda k: block.holds(k) | allow.holds(k)), F.lit(0))  # noqa: B023
        out = rows.withColumn("found", rule)
        verdict = F.when(F.col("found").isNull(), F.lit(None)).when(block.holds(F.col("found")), F.lit("block")).otherwise(F.lit("allow"))
        out = out.withColumn("said", verdict)
        if b:  # keys of different blocks differ, so those of one url differ in length
            better = F.coalesce(F.length("found"), F.lit(-1)) > F.coalesce(F.length("rule"), F.lit(-1))
            out = out.withColumn("said", F.when(better, F.col("said")).otherwise(F.col("verdict"))).withColumn("found", F.when(better, F.col("found")).otherwise(F.col("rule")))
        out = out.select("page_id", "host", "path", "keys", F.col("found").alias("rule"), F.col("said").alias("verdict"))
        rows = out if b == blocks - 1 else materialize(out)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
