"""Deterministic pseudo-random order: a seeded hash of the row key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 32


def seeded_hash(key: Column, seed: int) -> Column:
    """32 hex digits that depend on the key and the seed only, never on partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def bucket_of(hashed: Column, digits: int = 4, start: int = 0) -> Column:
    """``digits`` hex digits of the hash, at most 16**digits distinct values."""
    return F.substring(hashed, start + 1, digits)
