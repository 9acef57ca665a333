"""Reproducible pseudo-random numbers that depend on the key, never on the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_hash(seed: int | str, key: Column) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of ``md5(seed|key)``."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hash_bucket(key: Column, buckets: Column) -> Column:
    """Bucket of ``key`` among ``buckets``, from the first 32 bits of its md5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % buckets
