"""Parts of '/'-separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """The name without its last suffix; a leading dot begins a name, not a suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def suffix(name: Column) -> Column:
    """The last suffix in lower case, without its dot."""
    return F.lower(F.regexp_extract(name, r".\.([^.]*)$", 1))


def folder(path: Column) -> Column:
    """The parent folder; '.' at the top."""
    up = F.regexp_replace(path, "/?[^/]*$", "")
    return F.when(up == "", F.lit(".")).otherwise(up)


def nearest_folders(path: Column, n: int = 3) -> Column:
    """Names of up to n parent folders, the nearest first."""
    names = F.filter(F.split(path, "/"), lambda x: x != "")
    above = F.slice(names, F.lit(1), F.size(names) - 1)
    return F.slice(F.reverse(above), 1, n)


def tail_number(stem: Column) -> Column:
    """The last run of digits that only other characters follow; 0 without one or beyond a long."""
    return F.coalesce(F.regexp_extract(stem, r"([0-9]+)[^0-9]*$", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def common_prefix(a: Column, b: Column) -> Column:
    """Shared leading elements of two arrays."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get(a, k) == F.get(b, k))
    upto = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, n.cast("bigint"))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.slice(a, F.lit(1), upto.cast("int")))


def overlap(a: Column, b: Column) -> Column:
    """How much two folders share from the top: the lengths of equal leading parts, one more for each."""
    shared = common_prefix(F.split(a, "/"), F.split(b, "/"))
    return F.aggregate(shared, F.lit(0), lambda n, p: n + F.length(p) + 1)
