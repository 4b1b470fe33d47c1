"""Random order from a hash of the business key: the same on every run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKET_DIGITS = 3


def hash_order(key: Column, seed: int | Column = 0) -> Column:
    """A hexadecimal string whose order is a seeded shuffle of the keys."""
    suffix = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("#", key.cast("string"), suffix))


def hash_bucket(order: Column) -> Column:
    """The leading digits: equal-sized, ordered ranges of the hash."""
    return F.left(order, F.lit(BUCKET_DIGITS))


def hash_mod(key: Column, seed: int | Column, k: int | Column) -> Column:
    """A seeded pseudo-random integer in [0, k)."""
    number = F.conv(F.left(hash_order(key, seed), F.lit(8)), 16, 10).cast("bigint")
    return F.pmod(number, F.lit(k) if isinstance(k, int) else k).cast("int")
