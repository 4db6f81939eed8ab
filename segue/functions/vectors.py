"""Vectors as array columns, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2(a: Column) -> Column:
    """Unit length; unchanged if (nearly) zero."""
    return F.when(norm(a) > 1e-9, F.transform(a, lambda x: x / norm(a))).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def minmax(c: str, *partition: str) -> Column:
    """Scaled to 0..1 within a partition; 0 where it is flat."""
    w = W.partitionBy(*partition)
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0)


def argmax(names: list[str], values: Column) -> Column:
    """The name at the first maximum of an array."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(values, F.array_max(values)).cast("int"))


def mean_vector(df, key: str | list[str], vector: str, size: int, name: str = "mean"):
    """Mean of array columns by key; one partial sum per place, so no arrays are gathered."""
    keys = [key] if isinstance(key, str) else key
    sums = [F.avg(F.get(F.col(vector), F.lit(i)).cast("double")).alias(f"__{i}") for i in range(size)]
    return df.groupBy(*keys).agg(*sums).select(*keys, F.array(*[f"__{i}" for i in range(size)]).alias(name))
