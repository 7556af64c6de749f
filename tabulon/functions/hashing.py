"""Random numbers drawn from row keys, the same for any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPAN = 4294967296.0  # eight hex digits


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def key_hash(*parts) -> Column:
    """Hex digest of the parts joined by ``:``; pass literals with ``F.lit``."""
    return F.md5(F.concat_ws(":", *[_c(p).cast("string") for p in parts]))


def uniform_of(digest: Column, word: int = 0) -> Column:
    """Uniform in (0, 1) from one of the four 32-bit words of a digest."""
    digits = F.substring(digest, 8 * word + 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / _SPAN


def normal_of(digest: Column) -> Column:
    """Standard normal by Box and Muller from two words of a digest."""
    radius = F.sqrt(-2 * F.ln(uniform_of(digest, 0)))
    return radius * F.cos(2 * math.pi * uniform_of(digest, 1))


def add_noise(df: DataFrame, key, seed: int = 42, column: str = "random_noise") -> DataFrame:
    """Noise probe: any feature that ranks below it carries no signal."""
    keys = key if isinstance(key, (list, tuple)) else [key]
    return df.withColumn(column, normal_of(key_hash(*keys, F.lit(seed))))
