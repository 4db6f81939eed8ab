"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum, made of partial minima, and a join in which the edges of a hub are
dealt over several tasks; the edge table is cut to the shared checkpoint folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, spread_join


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (u, v) of type long; root is the smallest node reachable."""
    hi, lo = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    e = cut(edges.filter(F.col("u") != F.col("v")).select(hi, lo).distinct())
    mark, n = None, e.count()
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        large = spread_join(both, least.select("u", F.least("u", "m").alias("m")), "u", least.select("u", "c"), 2 * n, "v")
        large = large.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = spread_join(large, lowest.select("u", "m"), "u", lowest.select("u", "c"), 2 * n, "v").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == mark:
            break
        mark, n = now, now[0]
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
