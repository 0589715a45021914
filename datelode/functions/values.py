"""Small values: epochs, ISO texts, days of a month, bytes as text, defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_epoch(seconds: Column) -> Column:
    """A time without zone (UTC) from seconds since 1970, fractions included.

    Whole seconds are counted in integers: as a double, the microseconds of far times would not be exact.
    """
    whole = F.floor(seconds).cast("bigint")
    micros = whole * 1_000_000 + F.round((seconds - whole) * 1_000_000).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def iso(dt: Column) -> Column:
    """ISO text as a reader of any language gives it: microseconds only where there are some."""
    whole = F.date_format(dt, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(dt, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def from_iso(text: Column) -> Column:
    """A time without zone from ISO text; null if it is none."""
    return text.try_cast("timestamp_ntz")


def month_days(dt: Column) -> Column:
    return F.dayofmonth(F.last_day(dt))


def bytes_text(raw: Column) -> Column:
    """Bytes for JSON: printable UTF-8 as text (NULs at the end and blanks around it cut), all else as '0x' and hex digits."""
    text = F.trim(F.regexp_replace(F.try_validate_utf8(raw.cast("string")), "\\x00+$", ""))
    return F.when(text.isNotNull() & ~text.rlike("[\\p{C}]"), text).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(raw))))


def get(table: Column, key: str, default=None) -> Column:
    """table[key], or default where the map has no such key."""
    return F.coalesce(F.try_element_at(table, F.lit(key)), F.lit(default))
