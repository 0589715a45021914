"""Samples and splits that are the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by the hash of a key: a top-n, no shuffle of the table."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def split(key: Column, validation: float = 0.1, test: float = 0.1) -> Column:
    """train, val or test by the hash of a key, so all rows of a key fall together."""
    u = F.pmod(F.xxhash64(key), F.lit(10_000)) / 10_000
    return F.when(u < validation, "val").when(u < validation + test, "test").otherwise("train")
