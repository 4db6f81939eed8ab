"""Item-to-item collaborative filtering as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import with_backfill, without

NORMALIZATIONS = ("cosine", "pmi", "raw")


#: Lists longer than this are unfolded by several tasks, so many places in each.
PLACES = 1024


def half_pairs(counts: DataFrame, *carried: str) -> DataFrame:
    """i, j, v for i < j: how often two tracks share a list, with the carried columns of each as <name>_i and <name>_j.

    The lists are gathered once and unfolded to pairs, which adds them up in the same stage before any shuffle:
    one exchange of lists and one of partial sums, where a self-join would exchange lists twice. What is carried
    (a track's popularity) belongs to the track, so it travels with the pairs and needs no join with them.
    """
    own = ["track", *carried]
    lists = counts.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct(*own, "cnt"))).alias("x"))
    # A row for each place of a list, with what follows it: pairs (i < j) without a join.
    short = lists.filter(F.size("x") <= PLACES).select(F.posexplode("x").alias("p", "a"), "x")
    parts = lists.filter(F.size("x") > PLACES).select("pid", "x", F.explode(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / PLACES).cast("int"))).alias("part"))
    parts = parts.repartition("pid", "part").select("part", "x", F.posexplode(F.slice("x", F.col("part") * PLACES + 1, F.lit(PLACES))).alias("p", "a"))
    places = short.unionByName(parts.select((F.col("p") + F.col("part") * PLACES).alias("p"), "a", "x"))
    name = lambda c, side: "ij"["ab".index(side)] if c == "track" else f"{c}_{'ij'['ab'.index(side)]}"
    pairs = places.select("a", F.explode(F.slice("x", F.col("p") + 2, F.size("x"))).alias("b"))
    keys = [F.col(f"{side}.{c}").alias(name(c, side)) for side in "ab" for c in own]
    return pairs.groupBy(*keys).agg(F.sum(F.col("a.cnt") * F.col("b.cnt")).alias("v"))


def mirrored(half: DataFrame, *values: str) -> DataFrame:
    """Both directions of pairs."""
    return half.select(F.explode(F.array(F.struct("i", "j", *values), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), *values))).alias("r")).select("r.*")


def cooccurrence(counts: DataFrame) -> DataFrame:
    """i, j, v for i <> j: how often two tracks share a list. Unordered pairs are summed, then mirrored."""
    return mirrored(half_pairs(counts), "v")


def _similarity(v: Column, p: Column, q: Column, n_lists: int | None, normalization: str, shrink: float) -> Column:
    assert normalization in NORMALIZATIONS, normalization
    if normalization == "raw":
        return v.cast("double")
    prod = p.cast("double") * q
    if normalization == "cosine":
        return v / (F.sqrt(prod) + shrink)
    return F.greatest(F.ln(v * float(n_lists) / (prod + 1e-9) + 1e-9), F.lit(0.0))


def similarities(counts: DataFrame, pop: DataFrame, n_lists: int | None = None, normalization: str = "cosine", shrink: float = 10.0) -> DataFrame:
    """i, j, sim in both directions, of (pid, track, cnt): popularity meets the counts, not the far more numerous pairs."""
    half = half_pairs(counts.join(pop.select("track", "pop"), "track"), "pop")
    sim = _similarity(F.col("v"), F.col("pop_i"), F.col("pop_j"), n_lists, normalization, shrink)
    return mirrored(half.select("i", "j", sim.alias("sim")), "sim")


def similarity(co: DataFrame, pop: DataFrame, n_lists: int | None = None, normalization: str = "cosine", shrink: float = 10.0) -> DataFrame:
    """i, j, v, sim of pairs that are counted already. Shrinkage acts on the cosine only; pmi needs the number of lists."""
    assert normalization in NORMALIZATIONS, normalization
    p = pop.select(F.col("track").alias("i"), F.col("pop").alias("pi"))
    q = pop.select(F.col("track").alias("j"), F.col("pop").alias("pj"))
    return co.join(p, "i").join(q, "j").select("i", "j", "v", _similarity(F.col("v"), F.col("pi"), F.col("pj"), n_lists, normalization, shrink).alias("sim"))


def neighbours(sim: DataFrame, topk: int = 200) -> DataFrame:
    """i, j, sim, rank: the rows of the similarity, cut to their best; asymmetric by that."""
    w = W.partitionBy("i").orderBy(F.desc("sim"), "j")
    return sim.select("i", "j", "sim", F.row_number().over(w).cast("long").alias("rank")).filter(F.col("rank") <= topk)


def scores(seeds: DataFrame, near: DataFrame) -> DataFrame:
    """case_id, track, score: sums of the seeds' rows; repeated seeds count again."""
    s = seeds.groupBy("case_id", "track").agg(F.count("*").alias("times"))
    hit = s.join(near, s.track == near.i)
    return hit.groupBy("case_id", F.col("j").alias("track")).agg(F.round(F.sum(F.col("times") * F.col("sim")), 6).alias("score"))


def fit(interactions: DataFrame, pop: DataFrame, normalization: str = "cosine", topk: int = 200, shrink: float = 10.0, binary: bool = False) -> DataFrame:
    from ..plans.corpus import counts

    c = counts(interactions, binary)
    n = interactions.select("pid").distinct().count() if normalization == "pmi" else None
    return neighbours(similarities(c, pop, n, normalization, shrink), topk)


def recommend(near: DataFrame, cases: DataFrame, seeds: DataFrame, pop: DataFrame, k: int) -> DataFrame:
    """Scored tracks first, then popularity; cases without known seeds get popularity alone."""
    scored = without(scores(seeds, near).filter(F.col("score") > 0), seeds)
    return with_backfill(scored, cases, seeds, pop, k)
