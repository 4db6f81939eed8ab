"""Implicit matrix factorisation and item embeddings with MLlib."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import cut
from ..functions.vectors import mean_vector
from .dense import dense_top
from .ranking import with_backfill, without

__all__ = ["als_factors", "dense_ids", "dense_top", "fold_in", "recommend", "track_vectors"]

#: Buckets in which keys are numbered.
BUCKETS = 64


def dense_ids(df: DataFrame, key: str) -> DataFrame:
    """key, id: the distinct keys, of any type, numbered from 0 without gaps; written once.

    Keys are numbered within buckets of their hash, after the sizes of the buckets before, so no task sees all keys.
    """
    own = cut(df.select(key).distinct().withColumn("__b", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")))
    sizes = {r["__b"]: r["n"] for r in own.groupBy("__b").agg(F.count("*").alias("n")).collect()}  # BUCKETS rows
    before = [sum(sizes.get(x, 0) for x in range(b)) for b in range(BUCKETS)]
    at = F.row_number().over(W.partitionBy("__b").orderBy(key)) - 1
    return cut(own.select(key, (F.get(F.array(*[F.lit(n).cast("long") for n in before]), F.col("__b")) + at).alias("id")))


def als_factors(counts: DataFrame, rank: int = 64, iterations: int = 15, reg: float = 0.05, alpha: float = 40.0, seed: int = 0) -> DataFrame:
    """track, vector of (pid, track, cnt), by implicit feedback. Keys are of any type; MLlib takes up to 2^31 of either."""
    lists, tracks = dense_ids(counts, "pid"), dense_ids(counts, "track")
    data = counts.join(lists.withColumnRenamed("id", "u"), "pid").join(tracks.withColumnRenamed("id", "i"), "track")
    data = cut(data.select(F.col("u").cast("int"), F.col("i").cast("int"), F.col("cnt").cast("float")))
    als = ALS(rank=rank, maxIter=iterations, regParam=reg, implicitPrefs=True, alpha=alpha, userCol="u", itemCol="i", ratingCol="cnt", seed=seed, coldStartStrategy="drop")
    made = als.fit(data).itemFactors.select(F.col("id").cast("long").alias("id"), F.col("features").alias("vector"))
    return cut(tracks.join(made, "id").select("track", "vector"))


def track_vectors(interactions: DataFrame, dim: int = 64, window: int = 8, epochs: int = 5, min_count: int = 1, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """track, vector by skip-gram over lists as sentences; partitions are trained apart and averaged in each epoch."""
    partitions = partitions or interactions.sparkSession.sparkContext.defaultParallelism
    kind = interactions.schema["track"].dataType
    lists = cut(interactions.groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "track"))), lambda x: x["track"].cast("string")).alias("words")))
    longest = lists.agg(F.coalesce(F.max(F.size("words")), F.lit(1))).first()[0]
    w2v = Word2Vec(vectorSize=dim, windowSize=window, maxIter=epochs, minCount=min_count, seed=seed, inputCol="words", outputCol="v", maxSentenceLength=max(1000, longest), numPartitions=partitions)
    got = w2v.fit(lists).getVectors()
    return cut(got.select(F.col("word").cast(kind).alias("track"), vector_to_array("vector").alias("vector")))


def fold_in(seeds: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """case_id, q: mean vector of the seeds that have one."""
    return mean_vector(seeds.join(vectors, "track"), "case_id", "vector", size, "q")


def recommend(vectors: DataFrame, size: int, cases: DataFrame, seeds: DataFrame, pop: DataFrame, k: int, cosine: bool = False) -> DataFrame:
    """The tracks nearest to the mean of a case's seeds, then popularity; cases without known seeds get popularity alone."""
    most = int(seeds.groupBy("case_id").agg(F.countDistinct("track").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0])
    scored = without(dense_top(cut(fold_in(seeds, vectors, size)), vectors, k + most, cosine), seeds)
    return with_backfill(scored, cases, seeds, pop, k)
