"""Two stages: candidates of several models, then a blend of their features."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sampling import md5_order, md5_unit
from ..functions.tables import cut
from ..functions.text import normalise
from .blocks import flat, rounded, starts, unfolded
from .ranking import popular_top, with_backfill, without

FEATURES = ["cf", "als", "w2v", "title", "pop", "artist_overlap"]
#: Seeds shown in a blender example, and least length of its list.
SHOWN, LEAST = (5, 10, 25), 12


def candidates(sources: dict[str, DataFrame], seeds: DataFrame, per_source: int = 400) -> DataFrame:
    """case_id, track: union of the first rows of each source (case_id, rank, track), seeds left out."""
    parts = [s.filter(F.col("rank") <= per_source).select("case_id", "track") for s in sources.values()]
    return without(reduce(DataFrame.union, parts).distinct(), seeds)


def features(cand: DataFrame, sources: dict[str, DataFrame], cases: DataFrame, seeds: DataFrame, pop: DataFrame, tracks: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """case_id, track and the six features.

    cf, als and w2v are scores over the candidates' maximum (0 where that is not above 0); title is 1 - rank / length of
    the title ranking, 0 for a null or blank title; pop is global; artist_overlap tells whether a seed has the same artist.
    """
    out = cand
    for name in ("cf", "als", "w2v"):
        if name in sources:
            out = out.join(sources[name].select("case_id", "track", F.col("score").alias(name)), ["case_id", "track"], "left")
            most = F.max(F.coalesce(name, F.lit(0.0))).over(W.partitionBy("case_id"))
            out = out.withColumn(name, F.when(most > 0, F.coalesce(name, F.lit(0.0)) / (most + 1e-9)).otherwise(0.0))
        else:
            out = out.withColumn(name, F.lit(0.0))
    if "title" in sources:
        t = sources["title"].join(cases.filter(normalise(F.col("title")) != ""), "case_id", "left_semi")
        n = t.groupBy("case_id").agg(F.count("*").alias("n"))
        ranked = t.join(n, "case_id").select("case_id", "track", (1 - (F.col("rank") - 1) / F.col("n")).alias("title"))
        out = out.join(ranked, ["case_id", "track"], "left").withColumn("title", F.coalesce("title", F.lit(0.0)))
    else:
        out = out.withColumn("title", F.lit(0.0))
    most_pop = float(pop.agg(F.coalesce(F.max("pop"), F.lit(0))).first()[0]) + 1e-9
    out = out.join(pop.select("track", (F.col("pop") / most_pop).alias("pop")), "track").join(tracks.select("track", "artist"), "track", "left")
    own = seeds.join(tracks.select("track", "artist"), "track").select("case_id", "artist").distinct().withColumn("artist_overlap", F.lit(1.0))
    out = out.join(own, ["case_id", "artist"], "left").withColumn("artist_overlap", F.coalesce("artist_overlap", F.lit(0.0)))
    return out.select("case_id", "track", *[(F.lit(0.0) if f in drop else F.round(F.col(f), 6)).alias(f) for f in FEATURES])


def artist_labels(tracks: DataFrame) -> DataFrame:
    """track, label: a whole number from 1 for each artist; tracks without an artist are left out."""
    names = cut(cut(tracks.select("artist").distinct().filter(F.col("artist").isNotNull())).withColumn("at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = names.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for each file
    before = starts(np.array([r["n"] for r in sizes], np.int64))
    label = reduce(lambda out, x: F.when(part == x[0]["part"], inside + int(x[1])).otherwise(out), zip(sizes, before), F.lit(0))
    return tracks.select("track", "artist").join(names.select("artist", (label + 1).alias("label")), "artist").select("track", "label")


#: Cases whose features are made at a time, and bytes of titles' tracks that are sent to all executors.
CASES, SENT = 256, 32 << 20


def features_of_lists(lists: DataFrame, best: DataFrame, cases: DataFrame, seeds: DataFrame, pop: DataFrame, labels: DataFrame, k: int, per_source: int = 400) -> DataFrame:
    """`features` of `candidates` of item-to-item lists, the title model and popularity, made case by case from lists.

    lists (case_id, tracks, scores, pops, labels) are blocks.recommend's with artist_labels; best (t, rank, track) are the k + most seeds best tracks of each
    normalised title (title.best_of). No candidate is a row of its own before its features are there.
    """
    own = seeds.join(pop.select("track"), "track").join(labels, "track", "left").groupBy("case_id").agg(F.collect_list(F.struct("track", F.coalesce("label", F.lit(0)).cast("long").alias("label"))).alias("own"))
    most = int(seeds.groupBy("case_id").agg(F.countDistinct("track").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0])
    marked = pop.join(labels, "track", "left").select("track", "pop", F.coalesce("label", F.lit(0)).cast("long").alias("label"))
    best = best.select("t", "rank", "track").join(marked, "track").groupBy("t").agg(F.array_sort(F.collect_list(F.struct("rank", "track", "pop", "label"))).alias("best"))
    best = cut(best)
    few = best.count() * (k + most) * 32 <= SENT
    head = popular_top(pop, 2 * k + most).join(marked.select("track", "label"), "track").orderBy("pop_rank").select("track", "pop", "label").toArrow().combine_chunks()  # bounded: 2k + seeds of a case
    most_pop = float(pop.agg(F.coalesce(F.max("pop"), F.lit(0))).first()[0]) + 1e-9
    t = normalise(F.col("title"))
    per = cases.select("case_id", F.when(t != "", t).alias("t")).join(own, "case_id", "left").join(lists.select("case_id", "tracks", "scores", "pops", "labels"), "case_id")
    per = per.join(F.broadcast(best) if few else best, "t", "left")
    kind = pop.schema["track"].dataType.simpleString()
    none = lambda t: F.array().cast(f"array<{t}>")
    per = per.select(
        "case_id", F.col("t").isNotNull().alias("titled"), "tracks", "scores", "pops", "labels", F.coalesce("own.track", none(kind)).alias("ot"), F.coalesce("own.label", none("long")).alias("ol"),
        *[F.coalesce(f"best.{c}", none(n)).alias(f"b{c}") for c, n in (("track", kind), ("pop", "long"), ("label", "long"))],
    )
    out = f"case_id {cases.schema['case_id'].dataType.simpleString()}, track {kind}, " + ", ".join(f"{f} double" for f in FEATURES)
    return per.mapInArrow(_featured(head, most_pop, k, per_source), out)


def _featured(head: pa.Table, most_pop: float, k: int, per_source: int):
    def placed(x: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        length = np.diff(x.offsets.to_numpy())
        return np.repeat(np.arange(len(x)), length), unfolded(np.ones(len(x), np.int64), length)

    def within(keys: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Where each key is in the sorted keys `own`, or -1."""
        if not len(own):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        return np.where(own[at] == keys, at, -1)

    def made(b: pa.RecordBatch) -> pa.RecordBatch:
        n, titled = b.num_rows, b.column("titled").to_numpy(zero_copy_only=False).astype(bool)
        values = [(x := b.column(c)).values.slice(x.offsets[0].as_py(), x.offsets[-1].as_py() - x.offsets[0].as_py()) for c in ("tracks", "ot", "btrack")]
        every = pa.concat_arrays([*values, *head.column("track").chunks])
        u, code = np.unique(every.to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)[1:]
        cf, own, best, top = np.split(code, np.cumsum([len(x) for x in values]))
        key = lambda row, code: row * len(u) + code
        # Popularity and label of each track that is here; a seed need not have any.
        pops, labels = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
        for c, p, l in ((cf, "pops", "labels"), (best, "bpop", "blabel")):
            pops[c], labels[c] = flat(b.column(p))[0], flat(b.column(l))[0]
        pops[top], labels[top] = head.column("pop").to_numpy(), head.column("label").to_numpy()
        row_c, rank_c = placed(b.column("tracks"))
        row_o = placed(b.column("ot"))[0]
        row_b = placed(b.column("btrack"))[0]
        seeds = np.unique(key(row_o, own))

        def ranked(row: np.ndarray, code: np.ndarray, most: np.ndarray | int) -> tuple[np.ndarray, ...]:
            """Rows, tracks and ranks (from 1) of what is left, up to `most` of a row."""
            rank = unfolded(np.ones(n, np.int64), np.bincount(row, minlength=n))
            use = rank <= (most if np.isscalar(most) else most[row])
            return row[use], code[use], rank[use]

        free = within(key(row_b, best), seeds) < 0
        row_t, code_t, rank_t = ranked(row_b[free], best[free], k)
        have = np.bincount(row_t, minlength=n)
        row_h, code_h = np.repeat(np.arange(n), len(top)), np.tile(top, n)
        free = within(key(row_h, code_h), seeds) < 0
        row_h, code_h = row_h[free], code_h[free]
        row_p, code_p, _ = ranked(row_h, code_h, per_source)
        free = (within(key(row_h, code_h), np.sort(key(row_t, code_t))) < 0) & titled[row_h]
        row_f, code_f, rank_f = ranked(row_h[free], code_h[free], k - have)
        row_t, code_t, rank_t = np.concatenate([row_t, row_f]), np.concatenate([code_t, code_f]), np.concatenate([rank_t, rank_f + have[row_f]])
        length = np.bincount(row_t, minlength=n)

        few_c, few_t = rank_c <= per_source, rank_t <= per_source
        cand = np.unique(np.concatenate([key(row_c[few_c], cf[few_c]), key(row_t[few_t], code_t[few_t]), key(row_p, code_p)]))
        cand = cand[within(cand, seeds) < 0]
        row, track = np.divmod(cand, len(u))
        order = np.argsort(k_c := key(row_c, cf))
        at = within(cand, k_c[order])
        scores = flat(b.column("scores"))[0][order]
        score = np.where(at >= 0, scores[at], 0.0) if len(scores) else np.zeros(len(cand))
        most = np.zeros(n)
        np.maximum.at(most, row, score)
        score = np.where(most[row] > 0, score / (most[row] + 1e-9), 0.0)
        order = np.argsort(k_t := key(row_t, code_t))
        at = within(cand, k_t[order])
        named = np.where(at >= 0, 1 - (rank_t[order][at] - 1) / np.maximum(length[row], 1), 0.0) if len(k_t) else np.zeros(len(cand))
        kinds = labels.max(initial=0) + 1 + flat(b.column("ol"))[0].max(initial=0)
        mine = flat(b.column("ol"))[0]
        same = (within(row * kinds + labels[track], np.unique((row_o * kinds + mine)[mine > 0])) >= 0) & (labels[track] > 0)
        zero = np.zeros(len(cand))
        cols = [rounded(score), zero, zero, rounded(named), rounded(pops[track] / most_pop), same.astype(float)]
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), every.take(pa.array(u[track])), *map(pa.array, cols)], ["case_id", "track", *FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, CASES):
                yield made(b.slice(a, CASES))

    return run


def equal_score(feats: DataFrame) -> DataFrame:
    return feats.select("case_id", "track", F.round(reduce(lambda a, b: a + b, [F.col(f) for f in FEATURES]), 6).alias("score"))


def training_cases(interactions: DataFrame, playlists: DataFrame, n: int = 800, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, seeds, held) of the blender: the first n lists of LEAST tracks or more in hash order, each cut at one of SHOWN
    lengths, also by its hash, if more than three tracks are left then.

    n is a documented bound on training lists. Cases are named by their lists' keys.
    """
    sizes = interactions.groupBy("pid").agg(F.count("*").alias("len")).filter(F.col("len") >= LEAST)
    chosen = sizes.orderBy(md5_order(seed, "pid"), "pid").limit(n)
    draw = F.floor(md5_unit(f"{seed}shown", "pid") * len(SHOWN)).cast("int")
    shown = chosen.select(F.col("pid").alias("case_id"), "pid", "len", F.get(F.array(*[F.lit(s) for s in SHOWN]), draw).alias("shown")).filter(F.col("len") > F.col("shown") + 3)
    items = interactions.join(F.broadcast(shown.select("pid", "shown", "case_id")), "pid")  # at most n rows
    cases = shown.join(playlists, "pid", "left").select("case_id", F.col("title"))
    cut = lambda c: items.filter(c).select("case_id", F.col("pos").alias("ord"), "track")
    return cases, cut(F.col("pos") < F.col("shown")), cut(F.col("pos") >= F.col("shown"))


def training_rows(feats: DataFrame, held: DataFrame, seed: int = 0) -> DataFrame:
    """Features with a label; of each case all positives and at most 10 * positives + 20 negatives in hash order."""
    lab = feats.join(held.select("case_id", "track").distinct().withColumn("label", F.lit(1)), ["case_id", "track"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    w = W.partitionBy("case_id")
    lab = lab.withColumn("pos", F.sum("label").over(w)).filter(F.col("pos") > 0)
    r = F.row_number().over(W.partitionBy("case_id", "label").orderBy(md5_order(seed, "case_id", "track"), "track"))
    return lab.withColumn("r", r).filter((F.col("label") == 1) | (F.col("r") <= 10 * F.col("pos") + 20)).drop("pos", "r")


class Blender:
    """kind: logreg (balanced classes), gbt (120 trees of depth 4), or equal."""

    def __init__(self, kind: str = "gbt", seed: int = 0, trees: int = 120):
        assert kind in ("gbt", "logreg", "equal"), kind
        self.kind, self.seed, self.trees, self.model = kind, seed, trees, None
        self.assemble = VectorAssembler(inputCols=FEATURES, outputCol="x")

    def fit(self, rows: DataFrame) -> "Blender":
        by = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
        n = sum(by.values())
        if self.kind == "equal" or n <= 20 or len(by) < 2:
            return self
        weight = F.when(F.col("label") == 1, n / (2.0 * by[1])).otherwise(n / (2.0 * by[0]))
        data = self.assemble.transform(rows.withColumn("weight", weight))
        if self.kind == "logreg":
            self.model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=1.0 / n, standardization=False, maxIter=200).fit(data)
        else:
            self.model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=self.trees, maxDepth=4, stepSize=0.1, minInstancesPerNode=10, seed=self.seed).fit(data)
        return self

    def score(self, feats: DataFrame) -> DataFrame:
        if self.model is None:
            return equal_score(feats)
        got = self.model.transform(self.assemble.transform(feats))
        return got.select("case_id", "track", F.round(F.get(vector_to_array("probability"), F.lit(1)), 6).alias("score"))


def recommend(feats: DataFrame, blender: Blender, cases: DataFrame, seeds: DataFrame, pop: DataFrame, k: int) -> DataFrame:
    return with_backfill(blender.score(feats), cases, seeds, pop, k)
