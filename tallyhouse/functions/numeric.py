"""Small arithmetic of the vote domain as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quorum(seen: Column, percent: int) -> Column:
    """Workers that must be done: the percentage rounded up, 1 at least, in integers."""
    return F.greatest(F.floor((seen * percent + 99) / F.lit(100)).cast("bigint"), F.lit(1).cast("bigint"))


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a of the bytes of a text."""
    codes = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("bigint"))
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, b: F.pmod(h.bitwiseXOR(b) * F.lit(16777619), F.lit(1 << 32)))


def shard(text: Column, n: int) -> Column:
    return F.pmod(fnv1a32(text), F.lit(n))


def load_share(x: Column) -> Column:
    """Share of a load that has begun at the share ``x`` of its time: 3x^2 - 2x^3 within 0..1."""
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(3 * x * x - 2 * x * x * x)


def floor_rank(n: Column, p: float) -> Column:
    """0-based rank of a percentile: floor(p * (n - 1))."""
    return F.floor(F.lit(p) * (n - 1)).cast("bigint")


def backoff_seconds(attempt: Column, first: float, most: float) -> Column:
    """Wait before a retry: doubled each time up to a bound."""
    return F.least(F.lit(first) * F.pow(F.lit(2.0), attempt), F.lit(most))
