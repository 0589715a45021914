"""Date patterns of file and folder names as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from datelode.functions.timeparts import precision_rank

_Y, _M, _D = "((?:19|20)[0-9]{2})", "(0[1-9]|1[0-2])", "(0[1-9]|[12][0-9]|3[01])"
_H, _MI, _S = "([01][0-9]|2[0-3])", "([0-5][0-9])", "([0-5][0-9])"
_M_CN, _D_CN = "(0?[1-9]|1[0-2])", "(0?[1-9]|[12][0-9]|3[01])"


@dataclass(frozen=True)
class Pattern:
    """core holds one group for each of parts; no_digit: digits may touch neither side; then: what may not follow."""

    name: str
    core: str
    precision: str
    confidence: float
    parts: int
    no_digit: bool = False
    then: str = ""

    @property
    def regex(self) -> str:
        before, after = ("(?<![0-9])", "(?![0-9])") if self.no_digit else ("", f"(?!{self.then})" if self.then else "")
        return before + self.core + after


# Names, precisions, confidences and the grammar of the twelve built-in patterns.
BUILT_IN = [
    Pattern("DATETIME14", _Y + _M + _D + _H + _MI + _S, "second", 0.9, 6, no_digit=True),
    Pattern("DATETIME_SEP", f"{_Y}[-_. ]{_M}[-_. ]{_D}[-_. T]{_H}[-_.:h]{_MI}[-_.:m]{_S}", "second", 0.9, 6),
    Pattern("DATETIME12", f"{_Y}{_M}{_D}_{_H}{_MI}", "minute", 0.85, 5, no_digit=True),
    Pattern("DATETIME8_6", f"{_Y}{_M}{_D}[_\\-]{_H}{_MI}{_S}", "second", 0.9, 6, no_digit=True),
    Pattern("DATE8", _Y + _M + _D, "day", 0.75, 3, no_digit=True),
    Pattern("DATE_SEP", f"{_Y}[-_.]{_M}[-_.]{_D}", "day", 0.8, 3),
    Pattern("YEARMONTH6", _Y + _M, "month", 0.5, 2, no_digit=True),
    Pattern("YEARMONTH_SEP", f"{_Y}[-_.]{_M}", "month", 0.55, 2, then="[-_.0-9]"),
    Pattern("YEAR4", _Y, "year", 0.3, 1, no_digit=True),
    Pattern("DATE_CN", f"{_Y}年{_M_CN}月{_D_CN}日", "day", 0.85, 3),
    Pattern("YEARMONTH_CN", f"{_Y}年{_M_CN}月", "month", 0.6, 2),
    Pattern("YEAR_CN", f"{_Y}年", "year", 0.35, 1),
]


MATCHES = "array<struct<pattern_name:string,dt:timestamp_ntz,precision:string,confidence:double,matched_text:string,seq:int>>"


def _match(text: Column, k: int, p: Pattern) -> Column:
    def one(m: Column, n: Column) -> Column:
        part = lambda i, default: F.regexp_extract(m, p.core, i).cast("int") if i <= p.parts else F.lit(default)
        return F.struct(
            F.lit(p.name).alias("pattern_name"),
            F.try_make_timestamp_ntz(part(1, 1), part(2, 1), part(3, 1), part(4, 0), part(5, 0), part(6, 0).cast("decimal(16,6)")).alias("dt"),
            F.lit(p.precision).alias("precision"),
            F.lit(p.confidence).alias("confidence"),
            m.alias("matched_text"),
            (F.lit(1000 * k) + n).alias("seq"),
        )

    found = F.transform(F.regexp_extract_all(text, F.lit(p.regex), F.lit(0)), one)
    return F.filter(found, lambda x: x["dt"].isNotNull())


def match_all(text: Column, patterns: list[Pattern] | None = None) -> Column:
    """All matches, best first: by confidence, then precision, then pattern and place.

    An array of structs (pattern_name, dt, precision, confidence, matched_text, seq); invalid dates are left out.
    """
    patterns = BUILT_IN if patterns is None else patterns
    every = F.concat(*[_match(text, k, p) for k, p in enumerate(patterns)])
    if all(p.core.startswith(_Y) for p in patterns):  # most names hold no year at all
        every = F.when(text.rlike(_Y), every)
        every = F.coalesce(every, F.array().cast(MATCHES))
    keyed = F.array_sort(F.transform(every, lambda x: F.struct((-x["confidence"]).alias("c"), (-precision_rank(x["precision"])).alias("p"), x["seq"].alias("s"), x.alias("m"))))
    return F.transform(keyed, lambda x: x["m"])
