"""Vector and hash functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double, summed in element order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sign_hash(v: Column, bits: int = 64) -> Column:
    """A long whose bit k is set where element k is positive."""
    return F.aggregate(F.transform(F.slice(v, 1, bits), lambda x, k: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), k)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_from_hex(h: Column) -> Column:
    """A 64-bit hash in hex as a signed long; null where it is none."""
    return F.conv(F.when(F.length(h) == 16, h), 16, -10).try_cast("bigint")


# Least cosine of each step and the confidence that it lends.
LENT = [(0.98, 0.75), (0.95, 0.65), (0.90, 0.55), (0.85, 0.45)]
LENT_LEAST = 0.40


def lent_confidence(cosine: Column) -> Column:
    out = F.when(cosine >= LENT[0][0], F.lit(LENT[0][1]))
    for least, confidence in LENT[1:]:
        out = out.when(cosine >= least, F.lit(confidence))
    return out.otherwise(F.lit(LENT_LEAST))
