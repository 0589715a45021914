"""Pattern mining: frequent digit structures of names become new date patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datelode.functions import paths
from datelode.functions.patterns import Pattern, match_all
from datelode.functions.timeparts import precision_rank

SAMPLES = 50
MAX_PATTERNS = 20
ACCEPT = 0.75
# Base confidence by precision, cap, and fields by the number of digits.
BASE = {"second": 0.85, "minute": 0.80, "hour": 0.75, "day": 0.70, "month": 0.45, "year": 0.25}
CAP = 0.89
FIELDS = {14: [4, 2, 2, 2, 2, 2], 12: [4, 2, 2, 2, 2], 8: [4, 2, 2], 6: [4, 2], 4: [4]}
PRECISION = {14: "second", 12: "minute", 8: "day", 6: "month", 4: "year"}
_RANGE = ["(?:19|20)[0-9]{2}", "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])", "(?:[01][0-9]|2[0-3])", "[0-5][0-9]", "[0-5][0-9]"]


def digit_lengths(text: Column) -> Column:
    return F.transform(digit_values(text), F.length)


def digit_values(text: Column) -> Column:
    """The runs of digits of a text."""
    return F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))


def parse_digits(text: Column) -> Column:
    """(precision, dt) that all digits of a text, one behind the other, stand for; null if they are no date.

    Each number of digits has one reading (see FIELDS): schemes that put fields together differently give
    the same fields.
    """
    s = F.array_join(digit_values(text), "")
    n = F.length(s)
    at = lambda a, k, low: F.when(n >= a + k - 1, F.substring(s, a, k).try_cast("int")).otherwise(F.lit(low))
    year = F.substring(s, 1, 4).try_cast("int")
    dt = F.try_make_timestamp_ntz(year, at(5, 2, 1), at(7, 2, 1), at(9, 2, 0), at(11, 2, 0), at(13, 2, 0).cast("decimal(16,6)"))
    precision = F.lit(None).cast("string")
    for total, name in PRECISION.items():
        precision = F.when(n == total, F.lit(name)).otherwise(precision)
    seconds = F.substring(s, 13, 2).try_cast("int")  # a 60th second is none here
    return F.when(precision.isNotNull() & year.between(1900, 2100) & dt.isNotNull() & (F.coalesce(seconds, F.lit(0)) < 60), F.struct(precision.alias("precision"), dt.alias("dt")))


def separators(text: Column) -> Column:
    """Between digit runs: W if a letter is there, else the first of _ - . / : and blank, else ?."""
    inner = F.regexp_extract_all(text, F.lit("(?<=[0-9])([^0-9]+)(?=[0-9])"), F.lit(1))
    first = lambda x: F.regexp_extract(x, r"[_\-./: ]", 0)
    return F.transform(inner, lambda x: F.when(x.rlike(r"\p{L}"), F.lit("W")).when(first(x) != "", first(x)).otherwise(F.lit("?")))


def name_parts(items: DataFrame) -> DataFrame:
    """item_id, text: the stem of each item and each of its parent folders."""
    names = F.filter(F.split("path", "/"), lambda x: x != "")
    folders = F.slice(names, F.lit(1), F.size(names) - 1)
    return items.select("item_id", F.explode(F.concat(F.array("stem"), folders)).alias("text"))


def open_texts(parts: DataFrame) -> DataFrame:
    """text, rows of parts(item_id, text) that no built-in pattern dates to the day; equal texts are counted first, so each is matched once."""
    best = F.get(match_all(F.col("text")), F.lit(0))
    return parts.groupBy("text").agg(F.count("*").alias("rows")).where(~F.coalesce(precision_rank(best["precision"]) >= 3, F.lit(False)))


def signatures(parts: DataFrame) -> DataFrame:
    """sig, lengths, seps, total, n, group_total of the digit structures of parts(item_id, text) that no built-in pattern dates to the day."""
    keyed = open_texts(parts).select("text", "rows", digit_lengths(F.col("text")).alias("lengths"), separators(F.col("text")).alias("seps"))
    total = F.aggregate("lengths", F.lit(0), lambda a, x: a + x)
    keyed = keyed.where((total >= 4) & F.exists("lengths", lambda x: x >= 4)).withColumn("total", total)
    sig = F.concat(F.array_join(F.transform("lengths", lambda x: x.cast("string")), ","), F.lit("|"), F.array_join("seps", " "))
    counted = keyed.groupBy(sig.alias("sig"), "lengths", "seps", "total").agg(F.sum("rows").alias("n"))
    groups = counted.groupBy("total").agg(F.sum("n").alias("group_total"))
    return counted.join(groups, "total").select("sig", "lengths", "seps", "total", "n", "group_total")


def frequent(sigs: DataFrame) -> DataFrame:
    least = F.when(F.col("total") >= 12, 2).when(F.col("total") >= 8, 3).when(F.col("total") >= 6, 4).otherwise(5)
    return sigs.where((F.col("n") >= F.least(least, F.lit(5))) | ((F.col("group_total") >= 5) & (F.col("n") >= 2)))


def _pattern(lengths: list[int], seps: list[str]) -> Pattern | None:
    """The date pattern of a digit structure: fields are laid over the runs one behind the other."""
    total = sum(lengths)
    if total not in FIELDS or len(seps) != len(lengths) - 1:
        return None
    out, field, left = "", 0, FIELDS[total][0]
    for k, run in enumerate(lengths):
        while run:
            if run < left:
                return None  # a field would be cut in two
            out += f"({_RANGE[field]})"
            run -= left
            field += 1
            left = FIELDS[total][field] if field < len(FIELDS[total]) else 0
        if k < len(seps):
            out += {"W": "[^0-9]+", "?": "[^0-9]?"}.get(seps[k], f"[{re.escape(seps[k])}]")
    bonus = 0.05 if len(lengths) >= 3 and len(FIELDS[total]) >= 3 else 0.0
    name = "MINED_" + "_".join(map(str, lengths)) + "_" + PRECISION[total]
    return Pattern(name, out, PRECISION[total], min(BASE[PRECISION[total]] + bonus, CAP), len(FIELDS[total]), no_digit=True)


def _datable() -> Column:
    """Whether _pattern has a pattern for lengths and seps: no field is cut in two by the end of a run."""
    fits = F.lit(False)
    for total, fields in FIELDS.items():
        ends = F.array(*[F.lit(sum(fields[: k + 1])) for k in range(len(fields))])
        run_ends = F.transform("lengths", lambda x, k: F.aggregate(F.slice("lengths", F.lit(1), k + 1), F.lit(0), lambda a, b: a + b))
        fits = fits | ((F.col("total") == total) & (F.size(F.array_except(run_ends, ends)) == 0))
    return fits & (F.size("seps") == F.size("lengths") - 1)


def mined_patterns(items: DataFrame, limit: int = MAX_PATTERNS) -> list[Pattern]:
    """New patterns, most frequent structure first; each dates ACCEPT of its samples at least.

    Structures that can be dates are sampled in blocks of 10 * limit until limit patterns are found or none
    is left; the driver sees one row a structure of a block, with the share of its samples that are dated.
    """
    parts = name_parts(items)
    dated = frequent(signatures(parts)).where(_datable())
    out, last = [], None
    while len(out) < limit:
        rest = dated if last is None else dated.where((F.col("n") < last.n) | ((F.col("n") == last.n) & (F.col("sig") > last.sig)))
        rows = rest.orderBy(F.desc("n"), "sig").limit(10 * limit).collect()
        if not rows:
            break
        out += _accepted(parts, [(r, _pattern(list(r.lengths), list(r.seps))) for r in rows], limit - len(out))
        last = rows[-1]
    return out


def _accepted(parts: DataFrame, found: list, limit: int) -> list[Pattern]:
    """The first patterns of found, at most limit, that date ACCEPT of their samples."""
    sig = F.concat(F.array_join(F.transform(digit_lengths(F.col("text")), lambda x: x.cast("string")), ","), F.lit("|"), F.array_join(separators(F.col("text")), " "))
    samples = open_texts(parts).withColumn("sig", sig).where(F.col("sig").isin([r.sig for r, _ in found])).select("sig", "text")
    w = Window.partitionBy("sig").orderBy(F.sha1(F.col("text").cast("binary")))
    samples = samples.withColumn("k", F.row_number().over(w)).where(F.col("k") <= SAMPLES)
    rate = F.lit(None).cast("double")
    for r, p in found:
        rate = F.when(F.col("sig") == r.sig, F.when(F.size(match_all(F.col("text"), [p])) > 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(rate)
    rates = {x.sig: x.rate for x in samples.groupBy("sig").agg(F.avg(rate).alias("rate")).collect()}
    out = []
    for r, p in found:
        if rates.get(r.sig, 0) >= ACCEPT and len(out) < limit:
            out.append(Pattern(p.name, p.core, p.precision, round(min(p.confidence + 0.05 * (rates[r.sig] - ACCEPT), CAP), 4), p.parts, p.no_digit))
    return out
