"""Ten hold-out scenarios: greedy assignment in closed form, and the seed / hold-out cut."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sampling import md5_order
from ..functions.tables import cut
from .corpus import Corpus

#: Name, seeds, title shown, seeds from random places.
SCENARIOS = [
    ("title_only", 0, True, False), ("title_1", 1, True, False), ("title_5", 5, True, False), ("no_title_5", 5, False, False), ("title_10", 10, True, False),
    ("no_title_10", 10, False, False), ("title_25", 25, True, False), ("title_random_25", 25, True, True), ("title_100", 100, True, False), ("title_random_100", 100, True, True),
]


def min_length(n_seed: int) -> int:
    return n_seed + max(3, n_seed // 5 + 1)


def scenario_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*s, min_length(s[1])) for s in SCENARIOS], "scenario string, n_seed long, use_title boolean, random boolean, min_length long")


def assign(lengths: DataFrame, per_scenario: int) -> DataFrame:
    """pid, scenario of lists (pid, n): groups by falling n_seed; the r-th eligible list gets scenario r mod S.

    A group takes its first S * per_scenario lists by pid of those that no group before it took. All groups together take
    at most so many lists as there are scenarios times per_scenario, so of each class of lengths only that many first
    lists can matter; they are gathered and dealt out in one task.
    """
    steps = sorted({s[1] for s in SCENARIOS}, reverse=True)
    most = len(SCENARIOS) * per_scenario
    kind = F.lit(None).cast("int")
    for k, n_seed in reversed(list(enumerate(steps))):
        kind = F.when(F.col("n") >= min_length(n_seed), F.lit(k)).otherwise(kind)
    at = F.row_number().over(W.partitionBy("kind").orderBy("pid"))
    first = lengths.select("pid", kind.alias("kind")).filter(F.col("kind").isNotNull()).withColumn("r", at).filter(F.col("r") <= most).select("pid", "kind")

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(frames)
        if not got:
            return
        rows = pd.concat(got).sort_values("pid", kind="stable")
        left = list(zip(rows["pid"], rows["kind"]))
        out: list[tuple] = []
        for k, n_seed in enumerate(steps):
            names = [s[0] for s in SCENARIOS if s[1] == n_seed]
            fits = [i for i, (_, own) in enumerate(left) if own <= k][: len(names) * per_scenario]
            out += [(left[i][0], names[r % len(names)]) for r, i in enumerate(fits)]
            taken = set(fits)
            left = [x for i, x in enumerate(left) if i not in taken]
        yield pd.DataFrame(out, columns=["pid", "scenario"])

    pid = lengths.schema["pid"].dataType.simpleString()
    return first.repartition(1).mapInPandas(deal, f"pid {pid}, scenario string")


def build(test: Corpus, per_scenario: int = 1000, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases(case_id, scenario, title), seeds(case_id, ord, track), holdout(case_id, ord, track))."""
    lengths = test.interactions.groupBy("pid").agg(F.count("*").alias("n"))
    chosen = cut(assign(lengths, per_scenario)).join(F.broadcast(scenario_table(test.interactions.sparkSession)), "scenario")
    cases = chosen.join(test.playlists, "pid", "left").select(F.col("pid").alias("case_id"), "scenario", F.when(F.col("use_title"), F.coalesce("title", F.lit(""))).alias("title"))
    items = test.interactions.join(chosen.select("pid", "n_seed", "random"), "pid")
    luck = F.row_number().over(W.partitionBy("pid").orderBy(md5_order(seed, "pid", "pos"), "pos"))
    items = items.withColumn("is_seed", F.when(F.col("random"), luck <= F.col("n_seed")).otherwise(F.col("pos") < F.col("n_seed")))
    at = (F.row_number().over(W.partitionBy("pid", "is_seed").orderBy("pos")) - 1).cast("long")
    items = items.select(F.col("pid").alias("case_id"), at.alias("ord"), "track", "is_seed")
    return cases, items.filter("is_seed").drop("is_seed"), items.filter(~F.col("is_seed")).drop("is_seed")
