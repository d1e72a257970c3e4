"""Repeatable pseudo-random numbers from keys, equal on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One more than the largest bucket.
BUCKETS = 1 << 32


def bucket(key: str | Column, seed: int = 0) -> Column:
    """A number below BUCKETS from a seed and a key."""
    c = F.col(key) if isinstance(key, str) else key
    text = F.concat(F.lit(f"{seed}:"), c.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
