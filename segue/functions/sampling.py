"""Sampling that depends on keys alone: the same on every engine, partitioning and run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_order(seed: int | str, *cols: str) -> Column:
    """A hex string to order by, in place of a random number."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def md5_unit(seed: int | str, *cols: str) -> Column:
    """A number in (0, 1), the same in any database with md5: from its first 12 hex digits."""
    return (F.conv(F.substring(md5_order(seed, *cols), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(2**48 + 1))


def weighted_key(seed: int | str, weight: Column, *cols: str) -> Column:
    """Ascending order of this key is a weighted sample without replacement."""
    return -F.ln(md5_unit(seed, *cols)) / weight
