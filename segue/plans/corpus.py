"""The corpus: ordered lists of tracks, their titles, the catalogue and features.

`interactions(pid, pos, track)`, `playlists(pid, title)`, `tracks(track, artist, ..)` and
`features(track, axes)`. Track keys may be of any orderable type; their order is that of the uri.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sampling import md5_order, weighted_key
from ..schema import GENRES


@dataclass(frozen=True)
class Corpus:
    interactions: DataFrame
    playlists: DataFrame
    tracks: DataFrame
    features: DataFrame | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- adapter onto order data: customers are lists, ordered parts are tracks


def order_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey)
    return joined.select(F.col("o_custkey").alias("pid"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.col("l_partkey").alias("track"))


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15 axes per part: size, price and mean discount, quantity and tax scaled to 0..1, and its type as genre."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("track")).agg(
        *[F.round(F.avg(c), 9).alias(n) for c, n in (("l_discount", "valence"), ("l_quantity", "acousticness"), ("l_tax", "lyrical_depth"))]
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("track"), F.col("p_size").cast("double").alias("tempo"), F.col("p_retailprice").alias("energy"), "p_type")
    raw = part.join(items, "track", "left")
    scalars = ["tempo", "energy", "valence", "acousticness", "lyrical_depth"]
    # Ten numbers bound the axes and a few names are the types: small, fixed aggregates.
    bounds = raw.agg(*[f(c).alias(f"{n}_{c}") for c in scalars for n, f in (("lo", F.min), ("hi", F.max))]).first()
    types = sorted(r[0] for r in part.select("p_type").distinct().collect())
    scaled = [F.round(F.coalesce((F.col(c) - bounds[f"lo_{c}"]) / (bounds[f"hi_{c}"] - bounds[f"lo_{c}"]), F.lit(0.5)), 6) for c in scalars]
    genres = [(F.col("p_type") == types[i]).cast("double") if i < len(types) else F.lit(0.0) for i in range(len(GENRES))]
    return raw.select("track", F.array(*scaled, *genres).alias("axes"))


def from_orders(spark: SparkSession, sf_dir: str, features: bool = False) -> Corpus:
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    titles = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(F.col("c_custkey").alias("pid"), F.lower(F.concat_ws(" ", "c_mktsegment", "n_name")).alias("title"))
    tracks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("track"), F.col("p_brand").alias("artist"), F.col("p_name").alias("name"))
    return Corpus(order_interactions(spark, sf_dir), titles, tracks, order_features(spark, sf_dir) if features else None)


# ---- statistics, pruning, split


def track_stats(interactions: DataFrame) -> DataFrame:
    """track, count (occurrences), n_playlists."""
    return interactions.groupBy("track").agg(F.count("*").alias("count"), F.countDistinct("pid").alias("n_playlists"))


def corpus_stats(interactions: DataFrame) -> DataFrame:
    """One row of counts; lists are pre-aggregated, so no task sees all rows."""
    per_list = interactions.groupBy("pid").agg(F.count("*").alias("n"))
    lists = per_list.agg(F.count("*").alias("n_playlists"), F.sum("n").cast("long").alias("n_interactions"), F.round(F.avg("n"), 6).alias("mean_length"))
    tracks = interactions.select("track").distinct().agg(F.count("*").alias("n_tracks"))
    return lists.withColumn("n_tracks", F.lit(tracks.first()[0]).cast("long"))


def tail_histogram(interactions: DataFrame, at_least: tuple[int, ...] = (1, 2, 3, 5, 10, 20, 50)) -> DataFrame:
    """at_least, n_tracks: how many tracks occur so often."""
    counts = interactions.groupBy("track").agg(F.count("*").alias("c"))
    sums = counts.agg(*[F.coalesce(F.sum((F.col("c") >= n).cast("long")), F.lit(0)).cast("long").alias(f"n{n}") for n in at_least])
    rows = F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("at_least"), F.col(f"n{n}").alias("n_tracks")) for n in at_least]))
    return sums.select(rows.alias("r")).select("r.*")


def prune(corpus: Corpus, min_track_count: int = 1, keep: DataFrame | None = None) -> Corpus:
    """Keeps tracks that occur often enough, and those in `keep` (track); lists that become empty go, places close up."""
    counts = corpus.interactions.groupBy("track").agg(F.count("*").alias("c"))
    allowed = counts.filter(F.col("c") >= min_track_count).select("track")
    if keep is not None:
        allowed = allowed.union(keep.select("track")).distinct()
    w = W.partitionBy("pid").orderBy("pos")
    kept = corpus.interactions.join(allowed, "track", "left_semi").select("pid", (F.row_number().over(w) - 1).cast("long").alias("pos"), "track")
    return replace(corpus, interactions=kept, playlists=corpus.playlists.join(kept.select("pid").distinct(), "pid", "left_semi"), tracks=corpus.tracks.join(allowed, "track", "left_semi"))


def restrict_to_features(corpus: Corpus) -> Corpus:
    """Only tracks that have features; empty lists go."""
    return prune(replace(corpus, tracks=corpus.tracks.join(corpus.features, "track", "left_semi"), interactions=corpus.interactions.join(corpus.features.select("track"), "track", "left_semi")))


def with_length(interactions: DataFrame, least: int, most: int) -> DataFrame:
    """pid, n of lists of least to most tracks."""
    return interactions.groupBy("pid").agg(F.count("*").alias("n")).filter(F.col("n").between(least, most))


def with_theme(playlists: DataFrame, words: list[str]) -> DataFrame:
    """pid, title of lists whose title has one of the words inside."""
    return playlists.filter(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains("title", w))).select("pid", "title")


def feature_matrix(tracks: DataFrame, features: DataFrame | None, size: int) -> DataFrame:
    """track, axes in the catalogue's terms: zeros for tracks without features; an error without any table of them."""
    if features is None:
        raise ValueError("the corpus has no features")
    return tracks.select("track").join(features, "track", "left").select("track", F.coalesce("axes", F.array_repeat(F.lit(0.0), size)).alias("axes"))


def sample_lists(interactions: DataFrame, kinds: DataFrame, kind: str, least: int = 12, most: int = 45, n: int = 6, seed: int = 5) -> DataFrame:
    """kind, pid: of lists of a fair length the first in hash order of each kind (pid, kind); the first n kinds."""
    fits = kinds.join(with_length(interactions, least, most).select("pid"), "pid", "left_semi")
    r = F.row_number().over(W.partitionBy(kind).orderBy(md5_order(seed, "pid"), "pid"))
    return fits.withColumn("__r", r).filter("__r = 1").orderBy(kind).limit(n).select(kind, "pid")


def sample_tracks(pop: DataFrame, n: int = 600, seed: int = 7) -> DataFrame:
    """track, pop: a sample of n tracks without replacement, weighted by popularity."""
    return pop.withColumn("__k", F.round(weighted_key(seed, F.col("pop") + 0.001, "track"), 12)).orderBy("__k", "track").limit(n).select("track", "pop")


def test_pids(corpus: Corpus, n_test: int, seed: int = 0) -> DataFrame:
    """pid of the first n_test lists in hash order (a top-n, not a global sort)."""
    lists = corpus.interactions.select("pid").distinct()
    return lists.orderBy(md5_order(seed, "pid"), "pid").limit(n_test)


def split(corpus: Corpus, test: DataFrame | int, seed: int = 0) -> tuple[Corpus, Corpus]:
    """(train, test) by the pids held out, or by how many of them; both keep the whole catalogue.

    The first so many pids in hash order are those up to the last one of them, so a number needs no join with the interactions.
    """
    if isinstance(test, int):
        at = F.struct(md5_order(seed, "pid").alias("h"), "pid")
        last = test_pids(corpus, test, seed).agg(F.max(at).alias("m")).first()["m"] if test > 0 else None
        held = at <= F.struct(F.lit(last["h"]).alias("h"), F.lit(last["pid"]).alias("pid")) if last else F.lit(False)
        own = corpus.interactions.filter(held)
        lists = lambda how: corpus.playlists.join(own.select("pid").distinct(), "pid", how)
        return replace(corpus, interactions=corpus.interactions.filter(~held), playlists=lists("left_anti")), replace(corpus, interactions=own, playlists=lists("left_semi"))
    pick = lambda how: replace(corpus, interactions=corpus.interactions.join(test, "pid", how), playlists=corpus.playlists.join(test, "pid", how))
    return pick("left_anti"), pick("left_semi")


def counts(interactions: DataFrame, binary: bool = False) -> DataFrame:
    """The list x track matrix as (pid, track, cnt); repeats are summed unless binary."""
    return interactions.groupBy("pid", "track").agg((F.lit(1) if binary else F.count("*")).cast("long").alias("cnt"))


def first_meta(rows: DataFrame, order: list[str], meta: list[str]) -> DataFrame:
    """The first row's metadata of each track, by `order`."""
    return rows.groupBy("track").agg(F.min_by(F.struct(*meta), F.struct(*order)).alias("m")).select("track", *[f"m.{c}" for c in meta])
