"""Ranking metrics per case and their roll-up; coverage, diversity and popularity buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ARTIST_CREDIT = 0.25
#: Clicks are pages of ten; a miss counts as so many.
PAGE, MISSED = 10, 51


def evaluate(recs: DataFrame, holdout: DataFrame, cases: DataFrame, tracks: DataFrame | None = None, models: list[str] | None = None) -> DataFrame:
    """case_id, scenario, r_precision, ndcg, clicks of recs (case_id, rank from 1, track) against holdout (case_id, track).

    With `models`, recs have a column model too, and all of them are judged in one pass.

    R-precision looks at the first R predictions, R the length of the hold-out with repeats; a prediction that is no hit
    earns a quarter if its artist (tracks: track, artist) has hold-out entries that were not hit, each used once.
    The artist credit is .25 * sum over artists of least(supply, demand), so order does not matter.
    """
    key = ["case_id", "model"] if models else ["case_id"]
    gt = holdout.groupBy("case_id", "track").agg(F.count("*").alias("times"))
    size = gt.groupBy("case_id").agg(F.sum("times").alias("R"), F.count("*").alias("distinct"))
    r = recs.select(*key, "rank", "track").join(size, "case_id").join(gt, ["case_id", "track"], "left")
    first = F.row_number().over(W.partitionBy(*key, "track").orderBy("rank"))
    r = r.withColumn("hit", F.col("times").isNotNull() & (first == 1)).withColumn("is_gt", F.col("times").isNotNull())
    per = r.groupBy(*key).agg(
        F.sum(F.when(F.col("hit") & (F.col("rank") <= F.col("R")), 1).otherwise(0)).cast("double").alias("hits"),
        F.sum(F.when(F.col("hit"), 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"),
        F.min(F.when(F.col("is_gt"), F.col("rank") - 1)).alias("first"),
    )
    asked = cases.select("case_id", "scenario")
    if models:
        asked = asked.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    out = asked.join(size, "case_id", "left").join(per, key, "left")
    credit = F.lit(0.0)
    if tracks is not None:
        art = tracks.select("track", "artist")
        # Demand is what the hold-out has of an artist less what the first R predictions hit of it.
        all_of = gt.join(art, "track").groupBy("case_id", "artist").agg(F.sum("times").alias("all"))
        top = r.filter(F.col("rank") <= F.col("R")).join(art, "track").groupBy(*key, "artist").agg(
            F.sum(F.when(F.col("hit"), F.col("times"))).alias("got"), F.sum(F.when(~F.col("is_gt"), 1)).alias("supply")
        )
        demand = F.col("all") - F.coalesce("got", F.lit(0))
        soft = top.filter(F.col("supply") > 0).join(all_of, ["case_id", "artist"]).groupBy(*key).agg((ARTIST_CREDIT * F.sum(F.least(F.col("supply"), demand))).alias("soft"))
        out = out.join(soft, key, "left")
        credit = F.coalesce("soft", F.lit(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("distinct").cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    # A case with nothing held out scores nothing.
    none = lambda c: F.when(F.col("R").isNull(), 0.0).otherwise(c)
    return out.select(
        *key, "scenario",
        F.round(none(F.least(F.lit(1.0), (F.coalesce("hits", F.lit(0.0)) + credit) / F.col("R"))), 12).alias("r_precision"),
        F.round(none(F.coalesce("dcg", F.lit(0.0)) / ideal), 12).alias("ndcg"),
        F.coalesce(F.floor(F.col("first") / PAGE), F.lit(MISSED)).cast("double").alias("clicks"),
    )


def relevant(lists: DataFrame, holdout: DataFrame) -> DataFrame:
    """case_id, rank, track of lists (case_id, tracks) that a metric can count: held out, or among the first R, R the length of the hold-out."""
    gt = holdout.groupBy("case_id").agg(F.collect_set("track").alias("gt"), F.count("*").cast("int").alias("R"))
    placed = F.transform("tracks", lambda x, i: F.struct((i + 1).cast("long").alias("rank"), x.alias("track")))
    few = F.filter(placed, lambda x: (x["rank"] <= F.col("R")) | F.array_contains("gt", x["track"]))
    return lists.select("case_id", "tracks").join(gt, "case_id").select("case_id", F.explode(few).alias("x")).select("case_id", "x.*")


def summarise(per_case: DataFrame) -> DataFrame:
    """model, scenario (and OVERALL, the mean over cases), n and mean metrics, in one pass of grouping sets."""
    grouped = per_case.rollup("model", "scenario").agg(F.count("*").alias("n"), F.grouping("scenario").alias("g"), F.grouping("model").alias("gm"), *[F.round(F.avg(c), 9).alias(c) for c in ("r_precision", "ndcg", "clicks")])
    return grouped.filter(F.col("gm") == 0).select("model", F.when(F.col("g") == 1, "OVERALL").otherwise(F.col("scenario")).alias("scenario"), "n", "r_precision", "ndcg", "clicks")


def overall(per_case: DataFrame) -> DataFrame:
    """One row: n and mean metrics of all cases; without cases 0, 0 and a miss."""
    mean = lambda c, none: F.round(F.coalesce(F.avg(c), F.lit(float(none))), 9).alias(c)
    return per_case.agg(F.count("*").alias("n"), mean("r_precision", 0), mean("ndcg", 0), mean("clicks", MISSED))


def pivot(summary: DataFrame, metric: str, scenarios: list[str]) -> DataFrame:
    return summary.groupBy("model").pivot("scenario", scenarios).agg(F.round(F.avg(metric), 4))


def across_seeds(summary: DataFrame, metric: str = "r_precision") -> DataFrame:
    """model, mean, std (of a sample) over runs."""
    return summary.groupBy("model").agg(F.round(F.avg(metric), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(metric), F.lit(0.0)), 6).alias("std"))


def deltas(summary: DataFrame, baseline: str, metric: str = "r_precision") -> DataFrame:
    """model, metric and its difference from the baseline's, by scenario."""
    base = summary.filter(F.col("model") == baseline).select("scenario", F.col(metric).alias("base"))
    return summary.join(base, "scenario").select("model", "scenario", metric, F.round(F.col(metric) - F.col("base"), 6).alias("delta"))


def winners(summary: DataFrame, metric: str = "r_precision") -> DataFrame:
    """scenario, winner, runner_up."""
    w = W.partitionBy("scenario").orderBy(F.desc(metric), "model")
    r = summary.filter(F.col("scenario") != "OVERALL").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 2)
    return r.groupBy("scenario").agg(F.max(F.when(F.col("r") == 1, F.col("model"))).alias("winner"), F.max(F.when(F.col("r") == 2, F.col("model"))).alias("runner_up"))


# ---- beyond accuracy


def coverage(recs: DataFrame, n_catalogue: int, k: int) -> DataFrame:
    return recs.filter(F.col("rank") <= k).select("track").distinct().agg(F.count("*").alias("n_tracks"), F.round(F.count("*") / float(max(1, n_catalogue)), 6).alias("coverage"))


def intra_list_similarity(recs: DataFrame, vectors: DataFrame, size: int, top: int = 100) -> DataFrame:
    """case_id, ils: mean cosine of all pairs of the first `top` tracks with vectors (track, axes).

    With unit vectors u the mean is (|sum u|^2 - sum |u|^2) / (n (n - 1)): no pairs are made.
    """
    parts = [F.get(F.col("axes"), F.lit(i)).cast("double") for i in range(size)]
    length = F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    w = W.partitionBy("case_id").orderBy("rank")
    r = recs.join(vectors, "track").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).withColumn("len", length)
    unit = [F.coalesce(F.try_divide(p, F.col("len")), F.lit(0.0)) for p in parts]
    g = r.groupBy("case_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("len") > 0, 1.0).otherwise(0.0)).alias("own"), *[F.sum(u).alias(f"s{i}") for i, u in enumerate(unit)])
    square = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(1, size)), F.col("s0") * F.col("s0"))
    return g.select("case_id", F.round(F.when(F.col("n") < 2, 0.0).otherwise((square - F.col("own")) / (F.col("n") * (F.col("n") - 1))), 6).alias("ils"))


def half_even(c: Column) -> Column:
    return F.bround(c, 0).cast("long")


def buckets(pop: DataFrame, head: float = 0.02, tail: float = 0.80) -> DataFrame:
    """track, bucket: head, torso or tail by popularity rank; shares are rounded half to even, one at least."""
    n = pop.count()
    n_head, n_tail = max(1, round(head * n)), max(1, round(tail * n))
    ranked = global_rank(pop)
    return ranked.select("track", F.when(F.col("rank") <= n_head, "head").when(F.col("rank") > n - n_tail, "tail").otherwise("torso").alias("bucket"))


def global_rank(pop: DataFrame) -> DataFrame:
    """track, pop, rank (from 1) by popularity: ranks within a popularity, after counts of the more popular ones.

    Popularities are few and the tracks of one may be many, so ranks come from a running sum over distinct
    popularities and the row numbers within each one; no task sorts the catalogue.
    """
    sizes = pop.groupBy("pop").agg(F.count("*").alias("c"))
    before = sizes.withColumn("before", F.coalesce(F.sum("c").over(W.orderBy(F.desc("pop")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("pop", "before")
    own = F.row_number().over(W.partitionBy("pop").orderBy("track"))
    return pop.withColumn("own", own).join(before, "pop").select("track", "pop", (F.col("before") + F.col("own")).cast("long").alias("rank"))


def bucket_recall(recs: DataFrame, holdout: DataFrame, bucket: DataFrame, k: int) -> DataFrame:
    """bucket, demand (hold-out entries), hits within the first k, recall (0 without demand)."""
    top = recs.filter(F.col("rank") <= k).select("case_id", "track").distinct().withColumn("h", F.lit(1))
    g = holdout.select("case_id", "track").distinct().join(bucket, "track").join(top, ["case_id", "track"], "left")
    out = g.groupBy("bucket").agg(F.count("*").alias("demand"), F.count("h").alias("hits"))
    return out.select("bucket", "demand", "hits", F.round(F.coalesce(F.try_divide(F.col("hits"), F.col("demand")), F.lit(0.0)), 6).alias("recall"))


def purity_and_ari(labelled: DataFrame, label: str, cluster: str) -> DataFrame:
    """n, purity, ari of one labelling against another, from their contingency counts."""
    pairs = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    cells = labelled.groupBy(label, cluster).agg(F.count("*").alias("c"))
    by = lambda key: cells.groupBy(key).agg(F.sum("c").alias("c")).agg(F.sum(pairs("c"))).first()[0] or 0.0
    n, cell = cells.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(pairs("c")), F.lit(0.0))).first()
    most = cells.groupBy(cluster).agg(F.max("c").alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"))
    a, b, total = by(label), by(cluster), n * (n - 1) / 2
    expected = a * b / total if total else 0.0
    top = (a + b) / 2 - expected
    ari = 1.0 if not total or top == 0 else (cell - expected) / top
    return most.select(F.lit(n).cast("long").alias("n"), F.round(F.coalesce(F.col("m") / float(n) if n else F.lit(0.0), F.lit(0.0)), 6).alias("purity"), F.round(F.lit(float(ari)), 6).alias("ari"))


def first_hits(recs: DataFrame, holdout: DataFrame) -> DataFrame:
    """case_id, first: the place (from 0) of the first recommendation that was held out; no row without one."""
    hit = recs.join(holdout.select("case_id", "track").distinct(), ["case_id", "track"], "left_semi")
    return hit.groupBy("case_id").agg((F.min("rank") - 1).alias("first"))


def modes(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value: the most frequent value of each key; of equally frequent ones the first in order."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("__c"))
    r = F.row_number().over(W.partitionBy(key).orderBy(F.desc("__c"), value))
    return n.withColumn("__r", r).filter("__r = 1").select(key, value)


def shares(rows: DataFrame, key: str) -> DataFrame:
    """key, share of all rows."""
    n = rows.groupBy(key).agg(F.count("*").alias("c"))
    total = float(n.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0] or 1)
    return n.select(key, F.round(F.col("c") / total, 6).alias("share"))


def seed_coverage(seeds: DataFrame, known: DataFrame) -> DataFrame:
    """case_id, rate: the share of a case's seeds that are in known (track)."""
    k = known.select("track").distinct().withColumn("__k", F.lit(1.0))
    return seeds.join(k, "track", "left").groupBy("case_id").agg(F.round(F.avg(F.coalesce("__k", F.lit(0.0))), 6).alias("rate"))


def on_target(recs: DataFrame, tracks: DataFrame, target: DataFrame, column: str = "artist", top: int = 20) -> DataFrame:
    """case_id, fit: the share of the first `top` recommendations whose `column` is the case's target (case_id, target)."""
    r = recs.filter(F.col("rank") <= top).join(tracks.select("track", column), "track").join(target, "case_id")
    return r.groupBy("case_id").agg(F.round(F.avg(F.when(F.col(column) == F.col("target"), 1.0).otherwise(0.0)), 6).alias("fit"))


def bias(recs: DataFrame, holdout: DataFrame, bucket: DataFrame, vectors: DataFrame, n_catalogue: int, k: int, size: int) -> DataFrame:
    """model, coverage, intra_list_sim and recall of head, torso and tail, of recs (model, case_id, rank, track)."""
    top = recs.filter(F.col("rank") <= k)
    covered = top.select("model", "track").distinct().groupBy("model").agg(F.round(F.count("*") / float(max(1, n_catalogue)), 6).alias("coverage"))
    # A case of a model is a case of its own for the lists' similarity.
    named = recs.select(F.struct("model", "case_id").alias("case_id"), "rank", "track")
    alike = intra_list_similarity(named, vectors, size).groupBy(F.col("case_id.model").alias("model")).agg(F.round(F.avg("ils"), 4).alias("intra_list_sim"))
    demand = holdout.select("case_id", "track").distinct().join(bucket, "track")
    hits = top.select("model", "case_id", "track").distinct().join(demand, ["case_id", "track"]).groupBy("model", "bucket").agg(F.count("*").alias("hits"))
    wanted = demand.groupBy("bucket").agg(F.count("*").alias("demand"))
    rate = hits.join(wanted, "bucket").groupBy("model").agg(*[F.round(F.coalesce(F.max(F.when(F.col("bucket") == b, F.col("hits") / F.col("demand"))), F.lit(0.0)), 6).alias(f"{b}_recall") for b in ("head", "torso", "tail")])
    return covered.join(alike, "model", "left").join(rate, "model", "left").fillna(0.0)
