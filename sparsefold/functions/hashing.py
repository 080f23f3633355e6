"""Hash-ordered "randomness": the same rows come out on every run, engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seeded_hash(row_id: Column, seed: Column | int) -> Column:
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat(row_id.cast("string"), F.lit("|"), seed.cast("string")))


def hash_prefix(hashed: Column, digits: int = 3) -> Column:
    """16**digits buckets in hash order."""
    return F.substring(hashed, 1, digits)


def hash_int(hashed: Column) -> Column:
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("bigint")


def hash_unit(hashed: Column) -> Column:
    """A number in [0, 1)."""
    return hash_int(hashed) / F.lit(float(2**32))
