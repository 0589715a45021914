"""Raw metadata fields: times, positions, device names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Time formats, in the order in which they are tried.
TIME_FORMATS = ["yyyy:MM:dd HH:mm:ss", "yyyy:MM:dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy:MM:dd"]


def parse_time(raw: Column) -> Column:
    """A time without zone; null for empty, zeroed and unreadable fields. NULs and blanks around it are cut."""
    text = F.trim(F.translate(raw, "\0", ""))
    tried = [F.call_function("try_to_timestamp", text, F.lit(f)).cast("timestamp_ntz") for f in TIME_FORMATS]
    return F.when(text.startswith("0000") | (text == ""), F.lit(None).cast("timestamp_ntz")).otherwise(F.coalesce(*tried))


def rational(num: Column, den: Column) -> Column:
    """num / den; null where den is 0."""
    return F.when(den != 0, num.cast("double") / den)


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds to a signed decimal with 7 places; S and W are negative."""
    value = F.round(degrees + minutes / 60 + F.coalesce(seconds, F.lit(0.0)) / 3600, 7)
    return F.when(F.upper(F.trim(ref)).isin("S", "W"), -value).otherwise(value)


def altitude(value: Column, ref: Column) -> Column:
    """Metres; negative where ref is 1 (below the sea)."""
    return F.when(F.coalesce(ref, F.lit(0)) == 1, -value).otherwise(value)


def gps_time(day: Column, hours: Column, minutes: Column, seconds: Column) -> Column:
    """UTC time of a position: 'yyyy:MM:dd' and three numbers; fractions of a second are cut; null if they are no time."""
    part = lambda a, n: F.substring(day, a, n).try_cast("int")
    return F.when(day.rlike("^[0-9]{4}:[0-9]{2}:[0-9]{2}"), F.try_make_timestamp_ntz(part(1, 4), part(6, 2), part(9, 2), hours.cast("int"), minutes.cast("int"), F.floor(seconds).cast("decimal(16,6)")))


def device(raw: Column) -> Column:
    """A make or model field as text: UTF-8, without NULs and blanks around it; null if nothing is left."""
    return F.nullif(F.trim(F.translate(F.try_validate_utf8(raw.cast("string")), "\0", "")), F.lit(""))


def low_confidence(final_datetime: Column, confidence: Column, threshold: float = 0.6) -> Column:
    return final_datetime.isNull() | F.coalesce(confidence < threshold, F.lit(True))
