"""One query for each operator, over the order tables as a corpus, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..functions.sampling import md5_order, weighted_key
from ..functions.tables import cut, shared_folder
from ..operators import blocks, factors, hybrid, itemcf, ranking, routed, taste, title
from ..schema import AXES, GENRES, SCALAR_AXES
from ..sources import features as feature_sources
from ..sources import generate, results, slices, submission
from . import corpus as C
from . import metrics as M
from . import scenarios as S
from . import challenge, studies
from .oracles import K, LONG_QUOTA, NEIGHBOURS, QUOTA_SHARE, SEED, SWEEP, TEST_SHARE, TOPK_SIM, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(oracle)
        return f

    return add


class Run:
    """Shared steps of the queries on one data set, each written once; lazy, so that a query makes only what it uses."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name):
        made = getattr(type(self), "make_" + name)(self)
        setattr(self, name, made)
        return made

    def make_all(self):
        c = C.from_orders(self.spark, self.dir)
        return replace(c, interactions=cut(c.interactions))

    def make_tracks(self):
        return self.all.tracks

    def make_n_lists(self):
        return self.all.interactions.select("pid").distinct().count()

    def make_parts(self):
        return tuple(replace(c, interactions=cut(c.interactions)) for c in C.split(self.all, self.n_lists // TEST_SHARE, SEED))

    def make_train(self):
        return self.parts[0]

    def make_test(self):
        return self.parts[1]

    def make_pop(self):
        return cut(ranking.popularity(self.train.interactions, self.tracks))

    def make_near(self):
        return cut(itemcf.fit(self.train.interactions, self.pop, topk=TOPK_SIM))

    def make_built(self):
        return tuple(cut(d) for d in S.build(self.test, max(1, self.n_lists // QUOTA_SHARE), SEED))

    def make_cases(self):
        return self.built[0]

    def make_seeds(self):
        return self.built[1]

    def make_holdout(self):
        return self.built[2]

    def make_features(self):
        return cut(C.order_features(self.spark, self.dir))

    def make_z(self):
        return cut(taste.standardise(self.features))

    def make_learned(self):
        return cut(taste.learned(self.seeds, self.z))

    def make_flavours(self):
        return cut(taste.flavours(self.seeds, self.features))

    def make_none(self):
        return self.seeds.select("case_id", "track", F.lit(0.0).alias("score")).limit(0)

    def make_pop_lists(self):
        none = self.none.groupBy("case_id").agg(F.collect_list(F.struct("track", "score")).alias("best"))
        return cut(ranking.filled(none, self.cases, self.seeds, self.pop, K))

    def make_pop_recs(self):
        return ranking.rows(self.pop_lists)

    def make_cf_lists(self):
        return blocks.recommend(self.train.interactions, self.pop, self.cases, self.seeds, K, TOPK_SIM)

    def make_cf_recs(self):
        return ranking.rows(self.cf_lists)

    def make_title_model(self):
        lists = self.train.playlists.join(self.train.interactions.select("pid").distinct(), "pid", "left_semi")
        return tuple(cut(d) for d in title.fit(lists))

    def title_lists(self, cases, seeds):
        return cut(title.recommend(self.title_model, self.train.interactions, cases, seeds, self.pop, K, NEIGHBOURS))

    def title_lists_of(self, cases):
        cases = cut(cases)
        own = self.seeds.join(cases, "case_id", "left_semi")
        return title.lists_of(self.title_model, self.train.interactions, cases, own, self.pop, K, NEIGHBOURS)

    def make_own_title_lists(self):
        return cut(self.title_lists_of(self.cases))

    def make_title_recs(self):
        return ranking.rows(self.own_title_lists)

    def make_als(self):
        return factors.als_factors(C.counts(self.train.interactions))

    def make_w2v(self):
        return factors.track_vectors(self.train.interactions)

    def sources(self, cases, seeds, cf=None, titles=None, pop_recs=None) -> dict[str, DataFrame]:
        """The hybrid's five sources for some cases."""
        return {
            "cf": cf if cf is not None else cut(itemcf.recommend(self.near, cases, seeds, self.pop, K)),
            "als": cut(factors.recommend(self.als, 64, cases, seeds, self.pop, K)),
            "w2v": cut(factors.recommend(self.w2v, 64, cases, seeds, self.pop, K, cosine=True)),
            "title": titles if titles is not None else self.title_lists(cases, seeds),
            "pop": pop_recs if pop_recs is not None else cut(ranking.with_backfill(self.none, cases, seeds, self.pop, K)),
        }

    def make_case_sources(self):
        return self.sources(self.cases, self.seeds, self.cf_recs, self.title_recs, self.pop_recs)

    def hybrid_features(self, sources, cases, seeds):
        cand = hybrid.candidates(sources, seeds, PER_SOURCE)
        scored = {k: v for k, v in sources.items() if k != "pop"}
        return cut(hybrid.features(cand, scored, cases, seeds, self.pop, self.tracks))

    def make_feats(self):
        return self.hybrid_features(self.case_sources, self.cases, self.seeds)

    def make_blend_rows(self):
        cases, seeds, held = (cut(d) for d in hybrid.training_cases(self.train.interactions, self.train.playlists, seed=SEED))
        return cut(hybrid.training_rows(self.hybrid_features(self.sources(cases, seeds), cases, seeds), held))

    def blended(self, kind: str) -> DataFrame:
        blender = hybrid.Blender(kind, SEED).fit(self.blend_rows)
        return hybrid.recommend(self.feats, blender, self.cases, self.seeds, self.pop, K)

    def make_hybrid_recs(self):
        return cut(self.blended("gbt"))

    def make_weights(self):
        """Weights made of the case's number, so that another database has them too; every seventh case says nothing."""
        w = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: F.when(F.col("case_id") % 7 == 0, 0.0).otherwise((i % 5 - 2.0) * (F.col("case_id") % 3 + 1) / 6))
        return cut(self.cases.select("case_id", w.alias("w")))

    def make_rounded_z(self):
        return cut(self.z.withColumn("z", F.transform("z", lambda x: F.round(x, 6))))

    def make_recs_of(self):
        parts = {"popularity": self.pop_recs, "item_cf": self.cf_recs, "title": self.title_recs}
        return reduce(DataFrame.unionByName, [r.select("case_id", "rank", "track").withColumn("model", F.lit(m)) for m, r in parts.items()])

    def make_summary(self):
        lists = {"popularity": self.pop_lists, "item_cf": self.cf_lists, "title": self.own_title_lists}
        recs = reduce(DataFrame.unionByName, [M.relevant(x, self.holdout).withColumn("model", F.lit(m)) for m, x in lists.items()])
        return cut(M.summarise(M.evaluate(cut(recs), self.holdout, self.cases, self.tracks, list(lists))))


PER_SOURCE = 400


# ---- sources


@query("a1_slice_scan", "SELECT pid, title, pos, CAST(track AS VARCHAR) AS track, artist FROM inter JOIN titles USING (pid) JOIN tracks USING (track)")
def a1(spark, d):
    """Slice documents written to the shared folder, then read by the JSON loader."""
    folder = shared_folder(spark, "slices")
    slices.write(C.from_orders(spark, d), folder)
    got = slices.load(spark, folder, multi_line=False)
    return got.interactions.join(got.playlists, "pid").join(got.tracks.select("track", "artist"), "track").select("pid", "title", "pos", "track", "artist")


@query("a2_first_lists", "SELECT pid, pos, CAST(track AS VARCHAR) AS track FROM inter WHERE pid IN (SELECT DISTINCT pid FROM inter ORDER BY pid LIMIT 50)")
def a2(spark, d):
    """A folder of slices without the usual names, of which the first 50 lists are loaded."""
    folder = shared_folder(spark, "slices")
    slices.write(C.from_orders(spark, d), folder)
    return slices.load(spark, folder, max_playlists=50, multi_line=False).interactions


@query("a7_challenge", "SELECT case_id AS pid, any_value(title) AS title, count(*) AS num_samples, string_agg(CAST(track AS VARCHAR), ' ' ORDER BY ord) AS tracks FROM seeds JOIN cases USING (case_id) GROUP BY case_id")
def a7(spark, d):
    """The cases as a challenge document, read back."""
    r = Run(spark, d)
    folder = shared_folder(spark, "challenge")
    tracks = F.transform(F.array_sort(F.collect_list(F.struct("ord", "track"))), lambda x: F.struct(x["ord"].alias("pos"), x["track"].cast("string").alias("track_uri")))
    one = r.seeds.groupBy("case_id").agg(tracks.alias("tracks")).join(r.cases, "case_id")
    doc = F.struct(F.col("case_id").alias("pid"), F.col("title").alias("name"), F.size("tracks").alias("num_samples"), "tracks")
    one.select(F.array(doc).alias("playlists")).write.json(folder)
    got = slices.read_challenge(spark, folder, multi_line=False)
    return got.select("pid", "title", "num_samples", F.array_join("tracks", " ").alias("tracks"))


@query("a13_generated")
def a13(spark, d):
    """A generated corpus with as many lists and tracks as there are customers and parts."""
    c = generate.make(spark, C.table(spark, d, "customer").count(), C.table(spark, d, "part").count(), seed=3)
    return c.interactions


@query("a4_track_stats", "SELECT track, count(*) AS count, count(DISTINCT pid) AS n_playlists FROM inter GROUP BY track")
def a4(spark, d):
    return C.track_stats(C.order_interactions(spark, d))


MIN_COUNT = 30


@query("a5_pruned_load", f"SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY pos) - 1 AS pos, track FROM inter WHERE track IN (SELECT track FROM inter GROUP BY track HAVING count(*) >= {MIN_COUNT})")
def a5(spark, d):
    return C.prune(C.from_orders(spark, d), MIN_COUNT).interactions


@query("a6_whitelist_union", f"SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY pos) - 1 AS pos, track FROM inter WHERE track IN (SELECT track FROM inter GROUP BY track HAVING count(*) >= {MIN_COUNT} UNION SELECT p_partkey FROM part WHERE p_size <= 5)")
def a6(spark, d):
    keep = C.table(spark, d, "part").filter("p_size <= 5").select(F.col("p_partkey").alias("track"))
    return C.prune(C.from_orders(spark, d), MIN_COUNT, keep).interactions


@query("a8_feature_csv", "SELECT CAST(track AS VARCHAR) AS track, axes[1] AS tempo, 0.5::DOUBLE AS energy, axes[6] AS g0, 0.0::DOUBLE AS g9 FROM feats")
def a8(spark, d):
    """A CSV with two of the axes: the others get their neutral values."""
    folder = shared_folder(spark, "axes")
    f = C.order_features(spark, d)
    f.select(F.col("track").alias("track_uri"), F.get("axes", F.lit(0)).alias("tempo"), F.get("axes", F.lit(5)).alias(f"genre:{GENRES[0]}")).write.option("header", True).csv(folder)
    got = feature_sources.read_axis_csv(spark, folder)
    at = lambda i, n: F.get("axes", F.lit(i)).alias(n)
    return got.select("track", at(0, "tempo"), at(1, "energy"), at(5, "g0"), at(14, "g9"))


#: Parts that have audio values, as a table of features covers a part of a catalogue.
HAS_AUDIO = "p_size >= 15"
AUDIO_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS id, 30 + p_size * 5.0 AS tempo, p_retailprice / 2000 AS energy, CASE WHEN p_size > 45 THEN NULL ELSE p_size / 40.0 END AS valence,
  CASE WHEN p_size = 20 THEN CAST('nan' AS DOUBLE) ELSE 0.25 END AS acousticness, p_size / 100.0 AS instrumentalness FROM part WHERE p_size >= 15"""


def _audio(spark, d):
    p = C.table(spark, d, "part").filter(HAS_AUDIO)
    size = F.col("p_size").cast("double")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"), (30 + size * 5).alias("tempo"), (F.col("p_retailprice") / 2000).alias("energy"), F.when(F.col("p_size") <= 45, size / 40).alias("valence"),
        F.when(F.col("p_size") == 20, F.lit(float("nan"))).otherwise(0.25).alias("acousticness"), (size / 100).alias("instrumentalness"),
    )


def _clip_sql(c: str) -> str:
    return f"round(CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN 0.5 ELSE greatest(0.0, least(1.0, {c})) END, 9)"


@query("a9_a10_audio_axes", f"SELECT 'x:' || id AS track, {_clip_sql('(tempo - 30) / 220')} AS tempo, {_clip_sql('energy')} AS energy, {_clip_sql('valence')} AS valence, {_clip_sql('acousticness')} AS acousticness, {_clip_sql('(1 - instrumentalness)')} AS lyrical_depth FROM ({AUDIO_SQL})")
def a9(spark, d):
    folder = shared_folder(spark, "audio")
    _audio(spark, d).write.parquet(folder)
    tracks = C.table(spark, d, "part").select(F.concat(F.lit("x:"), F.col("p_partkey").cast("string")).alias("track"))
    f = feature_sources.attach_audio(tracks, feature_sources.read_audio(spark, folder))
    return f.select("track", *[F.round(F.get("axes", F.lit(i)), 9).alias(a) for i, a in enumerate(SCALAR_AXES)])


@query("a11_feature_match", "SELECT count(*) AS n_tracks, count(*) FILTER (p_size >= 15) AS n_matched, round(avg(CASE WHEN p_size >= 15 THEN 1.0 ELSE 0 END), 6) AS rate FROM part")
def a11(spark, d):
    tracks = C.table(spark, d, "part").select(F.concat(F.lit("x:"), F.col("p_partkey").cast("string")).alias("track"))
    return feature_sources.matched(tracks, feature_sources.attach_audio(tracks, _audio(spark, d)))


@query("a12_feature_covered", "SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY pos) - 1 AS pos, track FROM inter JOIN part ON p_partkey = track WHERE p_size >= 15")
def a12(spark, d):
    c = C.from_orders(spark, d)
    covered = C.table(spark, d, "part").filter(HAS_AUDIO).select(F.col("p_partkey").alias("track"))
    return C.restrict_to_features(C.Corpus(c.interactions, c.playlists, c.tracks, covered)).interactions


@query("a14_submission", f"""SELECT case_id, CAST(case_id AS VARCHAR) || ', ' || string_agg(CAST(track AS VARCHAR), ', ' ORDER BY rank) AS value FROM cfrecs GROUP BY case_id""")
def a14(spark, d):
    r = Run(spark, d)
    full = submission.listed(r.cf_lists, r.cases, r.seeds, ranking.popular_top(r.pop, 2 * K + 200), K)
    return submission.lines_of(full, "team", "a@b.c").filter("at >= 0").select(F.col("at").alias("case_id"), "value")


@query("a15_submission_files", f"""SELECT CAST(case_id AS VARCHAR) || ', ' || string_agg(CAST(track AS VARCHAR), ', ' ORDER BY rank) AS value, kind FROM cfrecs, (VALUES ('plain'), ('gzip')) AS v(kind) GROUP BY case_id, kind""")
def a15(spark, d):
    """Both files of a submission, read back."""
    r = Run(spark, d)
    folder = shared_folder(spark, "submission")
    full = submission.listed(r.cf_lists, r.cases, r.seeds, ranking.popular_top(r.pop, 2 * K + 200), K)
    submission.write_lists(full, folder, "team", "a@b.c", K if r.tracks.count() >= 2 * K else None)
    read = lambda kind: spark.read.text(f"{folder}/{kind}").withColumn("kind", F.lit(kind))
    return read("plain").unionByName(read("gzip")).filter("value <> '' and not startswith(value, 'team_info')")


@query("a16_a17_result_files", "SELECT model, scenario, n, r_precision, ndcg, clicks FROM summary")
def a16(spark, d):
    """Results as CSV, read back."""
    folder = shared_folder(spark, "results")
    results.write_csv(Run(spark, d).summary, folder)
    return results.read_csv(spark, folder)


# ---- projections, lookups


@query("b1_known_ids", "SELECT e.event_id, p_partkey AS track FROM events e JOIN part ON p_partkey = e.user_id * 17")
def b1(spark, d):
    e = C.table(spark, d, "events").select("event_id", (F.col("user_id") * 17).alias("track"))
    return ranking.known_ids(e, C.table(spark, d, "part").select(F.col("p_partkey").alias("track"))).select("event_id", "track")


@query("b4_feature_matrix", "SELECT track, coalesce(axes, [0.0 FOR i IN range(15)])[1] AS a0, coalesce(axes, [0.0 FOR i IN range(15)])[8] AS a7 FROM (SELECT track, CASE WHEN axes[1] < 0.2 THEN NULL ELSE axes END AS axes FROM feats)")
def b4(spark, d):
    f = C.order_features(spark, d)
    x = C.feature_matrix(f, f.filter(F.get("axes", F.lit(0)) >= 0.2), len(AXES))
    return x.select("track", F.get("axes", F.lit(0)).alias("a0"), F.get("axes", F.lit(7)).alias("a7"))


@query("b5_title_norm", r"SELECT doc_id, md5(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS t FROM documents")
def b5(spark, d):
    return C.table(spark, d, "documents").select("doc_id", F.md5(text.normalise(F.col("text"))).alias("t"))


@query("b6_length_filter", "SELECT pid, count(*) AS n FROM inter GROUP BY pid HAVING count(*) BETWEEN 12 AND 45")
def b6(spark, d):
    return C.with_length(C.order_interactions(spark, d), 12, 45)


@query("b8_dominant_genre", "SELECT track, (['" + "','".join(GENRES) + "'])[list_position(axes[6:15], list_max(axes[6:15]))] AS genre FROM feats")
def b8(spark, d):
    return C.order_features(spark, d).select("track", vectors.argmax(GENRES, F.slice("axes", 6, 10)).alias("genre"))


@query("b11_theme_filter", "SELECT pid, title FROM titles WHERE contains(title, 'auto') OR contains(title, 'build') OR contains(title, 'an')")
def b11(spark, d):
    return C.with_theme(C.from_orders(spark, d).playlists, ["auto", "build", "an"])


@query("b7_payload_axes", "SELECT * FROM (VALUES ('tempo', 0.5::DOUBLE), ('genre:rap', 1.0::DOUBLE)) AS v(axis, value)")
def b7(spark, d):
    got = taste.payload({"tempo": 0.5, "energy": 1e-12, "unknown": 3.0}, ["rap", "polka"])
    return spark.createDataFrame(list(got.items()), "axis string, value double")


# ---- joins and aggregates


@query("c1_cooccurrence", "SELECT i, j, v FROM co")
def c1(spark, d):
    return itemcf.cooccurrence(C.counts(Run(spark, d).train.interactions))


@query("d1_popularity", "SELECT track, pop FROM pop")
def d1(spark, d):
    return Run(spark, d).pop


@query("d2_corpus_stats", "SELECT count(DISTINCT pid) AS n_playlists, count(*) AS n_interactions, round(count(*) / count(DISTINCT pid), 6) AS mean_length, count(DISTINCT track) AS n_tracks FROM inter")
def d2(spark, d):
    return C.corpus_stats(C.order_interactions(spark, d))


@query("d3_tail_histogram", "SELECT CAST(n AS BIGINT) AS at_least, (SELECT count(*) FROM (SELECT track FROM inter GROUP BY track HAVING count(*) >= n)) AS n_tracks FROM (VALUES (1), (2), (3), (5), (10), (20), (50)) AS v(n)")
def d3(spark, d):
    return C.tail_histogram(C.order_interactions(spark, d))


for _kind, _expr in (
    ("raw", "CAST(v AS DOUBLE)"),
    ("cosine", "v / (sqrt(CAST(p.pop AS DOUBLE) * q.pop) + 10.0)"),
    ("pmi", "greatest(ln(v * (SELECT CAST(count(DISTINCT pid) AS DOUBLE) FROM train) / (CAST(p.pop AS DOUBLE) * q.pop + 1e-9) + 1e-9), 0.0)"),
):

    @query(f"d5_e2_similarity_{_kind}", f"SELECT i, j, round(sim, 6) AS sim, rank FROM (SELECT i, j, sim, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM (SELECT i, j, round({_expr}, 9) AS sim FROM co JOIN pop p ON p.track = i JOIN pop q ON q.track = j)) WHERE rank <= {TOPK_SIM}")
    def d5(spark, d, kind=_kind):
        r = Run(spark, d)
        n = r.train.interactions.select("pid").distinct().count() if kind == "pmi" else None
        sim = itemcf.similarities(C.counts(r.train.interactions), r.pop, n, kind).withColumn("sim", F.round("sim", 9))
        return itemcf.neighbours(sim, TOPK_SIM).select("i", "j", F.round("sim", 6).alias("sim"), "rank")


_Z = "SELECT track, [round((axes[i] - m[i]) / (s[i] + 1e-6), 6) FOR i IN range(1, 16)] AS z FROM feats, (SELECT " + "[" + ", ".join(f"avg(axes[{i}])" for i in range(1, 16)) + "] AS m, [" + ", ".join(f"stddev_pop(axes[{i}])" for i in range(1, 16)) + "] AS s FROM feats)"


@query("d7_zscore", f"SELECT track, z[1] AS z0, z[3] AS z2, z[5] AS z4, z[6] AS z5 FROM ({_Z})")
def d7(spark, d):
    z = Run(spark, d).z
    return z.select("track", *[F.round(F.get("z", F.lit(i)), 6).alias(f"z{i}") for i in (0, 2, 4, 5)])


@query("d6_seed_centroid", "SELECT case_id, count(*) AS n, round(avg(axes[1]), 9) AS a0, round(avg(axes[2]), 9) AS a1, round(avg(axes[3]), 9) AS a2 FROM seeds JOIN feats USING (track) GROUP BY case_id")
def d6(spark, d):
    r = Run(spark, d)
    m = vectors.mean_vector(r.seeds.join(r.features, "track"), "case_id", "axes", len(AXES))
    n = r.seeds.join(r.features, "track").groupBy("case_id").agg(F.count("*").alias("n"))
    return m.join(n, "case_id").select("case_id", "n", *[F.round(F.get("mean", F.lit(i)), 9).alias(f"a{i}") for i in range(3)])


@query("d8_minmax", "SELECT case_id, track, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END, 6) AS s FROM cfrecs WINDOW w AS (PARTITION BY case_id)")
def d8(spark, d):
    return Run(spark, d).cf_recs.select("case_id", "track", F.round(vectors.minmax("score", "case_id"), 6).alias("s"))


@query("d10_metric_rollup", "SELECT model, scenario, n, r_precision, ndcg, clicks FROM summary")
def d10(spark, d):
    return Run(spark, d).summary


@query("d12_spread_over_runs", "SELECT model, round(avg(r_precision), 6) AS mean, round(coalesce(stddev_samp(r_precision), 0), 6) AS std FROM summary WHERE scenario <> 'OVERALL' GROUP BY model")
def d12(spark, d):
    return M.across_seeds(Run(spark, d).summary.filter("scenario <> 'OVERALL'"))


PIVOTED = ["title_only", "title_1", "title_5", "no_title_5", "title_10", "no_title_10", "title_25", "title_random_25"]


@query("d13_pivot", "SELECT model, " + ", ".join(f"round(avg(r_precision) FILTER (scenario = '{s}'), 4) AS {s}" for s in PIVOTED) + " FROM summary GROUP BY model")
def d13(spark, d):
    return M.pivot(Run(spark, d).summary, "r_precision", PIVOTED)


@query("d14_h10_coverage", "SELECT count(DISTINCT track) AS n_tracks, round(count(DISTINCT track) / (SELECT count(*) FROM part), 6) AS coverage FROM cfrecs WHERE rank <= 50")
def d14(spark, d):
    r = Run(spark, d)
    return M.coverage(r.cf_recs, r.tracks.count(), 50)


_BUCKETS = "SELECT track, CASE WHEN rank <= nh THEN 'head' WHEN rank > n - nt THEN 'tail' ELSE 'torso' END AS bucket FROM (SELECT track, row_number() OVER (ORDER BY pop DESC, track) AS rank FROM pop), (SELECT count(*) AS n, greatest(1, round_even(0.02 * count(*), 0)) AS nh, greatest(1, round_even(0.8 * count(*), 0)) AS nt FROM pop)"


@query("e8_h12_buckets", _BUCKETS)
def e8(spark, d):
    return M.buckets(Run(spark, d).pop)


@query("d15_bucket_recall", f"SELECT bucket, count(*) AS demand, count(h) AS hits, round(count(h) / count(*), 6) AS recall FROM (SELECT DISTINCT case_id, track FROM holdout) JOIN ({_BUCKETS}) USING (track) LEFT JOIN (SELECT case_id, track, 1 AS h FROM cfrecs) USING (case_id, track) GROUP BY bucket")
def d15(spark, d):
    r = Run(spark, d)
    return M.bucket_recall(r.cf_recs, r.holdout, M.buckets(r.pop), K)


@query("d16_case_counts", "SELECT scenario, count(*) AS n FROM cases GROUP BY scenario")
def d16(spark, d):
    return Run(spark, d).cases.groupBy("scenario").agg(F.count("*").alias("n"))


@query("d17_mode", "SELECT pid, artist FROM (SELECT pid, artist, row_number() OVER (PARTITION BY pid ORDER BY count(*) DESC, artist) AS r FROM inter JOIN tracks USING (track) GROUP BY pid, artist) WHERE r = 1")
def d17(spark, d):
    c = C.from_orders(spark, d)
    return M.modes(c.interactions.join(c.tracks, "track"), "pid", "artist")


@query("d18_group_share", "SELECT artist, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM inter JOIN tracks USING (track) GROUP BY artist")
def d18(spark, d):
    c = C.from_orders(spark, d)
    return M.shares(c.interactions.join(c.tracks, "track"), "artist")


_ARI = """WITH cell AS (SELECT label, CAST(embedding[1] > 0 AS INT) + 2 * CAST(embedding[2] > 0 AS INT) AS cl, count(*) AS c FROM embeddings GROUP BY ALL),
 s AS (SELECT sum(c) AS n, sum(c * (c - 1) / 2) AS x FROM cell), a AS (SELECT sum(c * (c - 1) / 2) AS x FROM (SELECT sum(c) AS c FROM cell GROUP BY label)),
 b AS (SELECT sum(c * (c - 1) / 2) AS x FROM (SELECT sum(c) AS c FROM cell GROUP BY cl)), p AS (SELECT sum(m) AS m FROM (SELECT max(c) AS m FROM cell GROUP BY cl))
SELECT CAST(n AS BIGINT) AS n, round(p.m / n, 6) AS purity, round((s.x - a.x * b.x / (n * (n - 1) / 2)) / ((a.x + b.x) / 2 - a.x * b.x / (n * (n - 1) / 2)), 6) AS ari FROM s, a, b, p"""


@query("d19_purity_ari", _ARI)
def d19(spark, d):
    sign = lambda i: (F.get("embedding", F.lit(i)) > 0).cast("int")
    return M.purity_and_ari(C.table(spark, d, "embeddings").select("label", (sign(0) + 2 * sign(1)).alias("cl")), "label", "cl")


@query("d20_seed_coverage", "SELECT case_id, round(avg(CASE WHEN track IN (SELECT track FROM train) THEN 1.0 ELSE 0 END), 6) AS rate FROM seeds GROUP BY case_id")
def d20(spark, d):
    r = Run(spark, d)
    return M.seed_coverage(r.seeds, r.train.interactions)


@query("d21_on_target_share", "SELECT case_id, round(avg(CASE WHEN artist = top THEN 1.0 ELSE 0 END), 6) AS fit FROM cfrecs JOIN tracks USING (track) JOIN (SELECT case_id, min(artist) AS top FROM seeds JOIN tracks USING (track) GROUP BY case_id) USING (case_id) WHERE rank <= 20 GROUP BY case_id")
def d21(spark, d):
    r = Run(spark, d)
    want = r.seeds.join(r.tracks, "track").groupBy("case_id").agg(F.min("artist").alias("target"))
    return M.on_target(ranking.rows(ranking.first(r.cf_lists, 20, "scores")), r.tracks, want)


@query("d11_empty_aggregate", "SELECT CAST(0 AS BIGINT) AS n, 0.0::DOUBLE AS r_precision, 0.0::DOUBLE AS ndcg, 51.0::DOUBLE AS clicks UNION ALL SELECT count(*), round(avg(r_precision), 9), round(avg(ndcg), 9), round(avg(clicks), 9) FROM cfm")
def d11(spark, d):
    """The mean over no cases, and over all."""
    r = Run(spark, d)
    per = M.evaluate(r.cf_recs, r.holdout, r.cases, r.tracks)
    return M.overall(per.limit(0)).unionByName(M.overall(per))


@query("d21_i3_trust_curve")
def d21c(spark, d):
    """Each case with a title as a persona who states the opposite of the title's words: fit against trust."""
    r = Run(spark, d)
    want = r.seeds.join(r.tracks, "track").groupBy("case_id").agg(F.min("artist").alias("target"))
    stated = studies.oracle_stated(r.seeds, r.holdout, r.z).filter("mode = 'adversarial'").select("case_id", "stated")
    return studies.trust_curve(stated.join(want, "case_id"), r.learned, r.z, r.near, r.seeds, r.pop, r.tracks, "artist")


@query("d22_delta", "SELECT a.model, a.scenario, a.r_precision, round(a.r_precision - b.r_precision, 6) AS delta FROM summary a JOIN summary b ON a.scenario = b.scenario AND b.model = 'popularity'")
def d22(spark, d):
    return M.deltas(Run(spark, d).summary, "popularity")


# ---- ranking


@query("e3_popularity_rank", "SELECT track, pop, pop_rank AS rank FROM poprank")
def e3(spark, d):
    return M.global_rank(Run(spark, d).pop)


@query("e6_e7_rank_scores", "SELECT case_id, track, round(1 - (rank - 1) / count(*) OVER (PARTITION BY case_id), 6) AS rank_score, round(1 / (60.0 + rank - 1), 9) AS rrf FROM trecs")
def e6(spark, d):
    t = Run(spark, d).title_recs
    return t.select("case_id", "track", F.round(1 - (F.col("rank") - 1) / F.count("*").over(W.partitionBy("case_id")), 6).alias("rank_score"), F.round(routed.reciprocal(F.col("rank")), 9).alias("rrf"))


@query("e9_first_hit", "SELECT case_id, min(rank) - 1 AS first FROM cfrecs JOIN holdout USING (case_id, track) GROUP BY case_id")
def e9(spark, d):
    r = Run(spark, d)
    return M.first_hits(M.relevant(r.cf_lists, r.holdout), r.holdout)


_PRODUCTS = "SELECT track, [z[i] * (i % 4 - 1.5) FOR i IN range(1, 16)] AS p FROM ({z})"
_BY_SIZE = f"[{{{{'o': -abs(p[i]), 'i': i, 'axis': (['{'\',\''.join(AXES)}'])[i], 'value': p[i]}}}} FOR i IN range(1, 16)]"


@query("e11_top_axes", f"SELECT track, a[1].axis AS axis1, round(a[1].value, 6) AS value1, a[2].axis AS axis2, a[3].axis AS axis3 FROM (SELECT track, list_sort({_BY_SIZE.format()}) AS a FROM ({_PRODUCTS.format(z=_Z)}))")
def e11(spark, d):
    w = F.array(*[F.lit((i + 1) % 4 - 1.5) for i in range(len(AXES))])
    s = taste.contributions(F.col("z"), w)
    return Run(spark, d).rounded_z.select("track", s[0]["axis"].alias("axis1"), s[0]["value"].alias("value1"), s[1]["axis"].alias("axis2"), s[2]["axis"].alias("axis3"))


@query("b10_shown_weights", f"SELECT track, array_to_string([x.axis FOR x IN list_sort([y FOR y IN {_BY_SIZE.format()} IF y.o < -0.5])], ' ') AS axes FROM ({_PRODUCTS.format(z=_Z)})")
def b10(spark, d):
    w = F.array(*[F.lit((i + 1) % 4 - 1.5) for i in range(len(AXES))])
    shown = taste.shown_weights(F.zip_with("z", w, lambda a, b: a * b), 0.5)
    return Run(spark, d).rounded_z.select("track", F.array_join(F.transform(shown, lambda x: x["axis"]), " ").alias("axes"))


@query("e12_winners", "SELECT scenario, max(model) FILTER (r = 1) AS winner, max(model) FILTER (r = 2) AS runner_up FROM (SELECT scenario, model, row_number() OVER (PARTITION BY scenario ORDER BY r_precision DESC, model) AS r FROM summary WHERE scenario <> 'OVERALL') GROUP BY scenario")
def e12(spark, d):
    return M.winners(Run(spark, d).summary)


@query("e13_i6_overview", "SELECT CAST(CASE model WHEN 'item_cf' THEN 0 WHEN 'title' THEN 6 ELSE 7 END AS BIGINT) AS place, model, CASE model WHEN 'item_cf' THEN 'Item-CF' WHEN 'title' THEN 'Title' ELSE 'Popularity' END AS label, round(r_precision, 4) AS r_precision, round(ndcg, 4) AS ndcg, round(clicks, 3) AS clicks FROM summary WHERE scenario = 'OVERALL'")
def e13(spark, d):
    return results.overview(Run(spark, d).summary)


# ---- models


@query("g1_popularity", "SELECT case_id, rank, track FROM poprecs")
def g1(spark, d):
    return Run(spark, d).pop_recs.select("case_id", "rank", "track")


@query("g2_itemcf", "SELECT case_id, rank, track, score FROM cfrecs")
def g2(spark, d):
    return Run(spark, d).cf_recs


@query("g5_title", "SELECT case_id, rank, track, score FROM trecs")
def g5(spark, d):
    return Run(spark, d).title_recs


_ALPHA = "SELECT case_id, CASE WHEN coalesce(title, '') = '' THEN 0.0 WHEN n >= 10 THEN 0.0 WHEN n >= 5 THEN 0.35 WHEN n >= 1 THEN 0.6 ELSE 1.0 END AS alpha FROM (SELECT c.case_id, title, count(s.track) AS n FROM cases c LEFT JOIN seeds s USING (case_id) GROUP BY c.case_id, title)"


@query("g7_routing_weight", f"SELECT case_id, CAST(alpha AS DOUBLE) AS alpha FROM ({_ALPHA})")
def g7w(spark, d):
    r = Run(spark, d)
    return routed.weights(r.cases, r.seeds)


@query("g7_routed", f"""SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, track) AS rank, track FROM (
  SELECT case_id, track, CASE WHEN alpha <= 0 THEN -h.rank WHEN alpha >= 1 THEN -t.rank ELSE round((1 - alpha) * coalesce(1 / (60.0 + h.rank - 1), 0) + alpha * coalesce(1 / (60.0 + t.rank - 1), 0), 9) END AS score
  FROM cfrecs h FULL JOIN trecs t USING (case_id, track) JOIN ({_ALPHA}) USING (case_id) WHERE NOT (alpha <= 0 AND h.rank IS NULL) AND NOT (alpha >= 1 AND t.rank IS NULL)) QUALIFY rank <= {K}""")
def g7(spark, d):
    r = Run(spark, d)
    w = cut(routed.weights(r.cases, r.seeds))
    named = r.cases.join(w.filter("alpha > 0"), "case_id", "left_semi")
    return ranking.tracks_of(routed.fuse_lists(r.cf_lists, r.title_lists_of(named), w, K))


@query("g8_fast_router", "SELECT case_id, CASE WHEN coalesce(title, '') <> '' AND case_id NOT IN (SELECT case_id FROM seeds) THEN 'title' ELSE 'item_cf' END AS model FROM cases")
def g8(spark, d):
    r = Run(spark, d)
    return routed.fast_route(r.cases, r.seeds)


_FAST = f"SELECT case_id, rank, track FROM cfrecs WHERE case_id IN (SELECT case_id FROM seeds) OR case_id IN (SELECT case_id FROM cases WHERE coalesce(title, '') = '') UNION ALL SELECT case_id, rank, track FROM trecs WHERE case_id NOT IN (SELECT case_id FROM seeds) AND case_id IN (SELECT case_id FROM cases WHERE coalesce(title, '') <> '')"


@query("g8_lists", _FAST)
def g8l(spark, d):
    r = Run(spark, d)
    route = cut(routed.fast_route(r.cases, r.seeds))
    named = r.cases.join(route.filter("model = 'title'"), "case_id", "left_semi")
    return ranking.tracks_of(routed.fast_lists_of(route, r.cf_lists, r.title_lists_of(named)))


_CAND = f"SELECT DISTINCT case_id, track FROM (SELECT * FROM cfrecs WHERE rank <= {PER_SOURCE} UNION ALL SELECT * FROM trecs WHERE rank <= {PER_SOURCE} UNION ALL SELECT * FROM poprecs WHERE rank <= {PER_SOURCE})"
_FEATS = f"""SELECT case_id, track, round(CASE WHEN max(coalesce(cf, 0)) OVER (PARTITION BY case_id) > 0 THEN coalesce(cf, 0) / (max(coalesce(cf, 0)) OVER (PARTITION BY case_id) + 1e-9) ELSE 0 END, 6) AS cf, 0.0::DOUBLE AS als, 0.0::DOUBLE AS w2v,
  round(CASE WHEN coalesce(c.title, '') = '' THEN 0 ELSE coalesce(tr, 0) END, 6) AS title, round(pop / ((SELECT max(pop) FROM pop) + 1e-9), 6) AS pop, CASE WHEN (case_id, artist) IN (SELECT case_id, artist FROM seeds JOIN tracks USING (track)) THEN 1.0 ELSE 0.0 END::DOUBLE AS artist_overlap
  FROM ({_CAND}) JOIN cases c USING (case_id) JOIN pop USING (track) JOIN tracks USING (track) LEFT JOIN (SELECT case_id, track, score AS cf FROM cfrecs) USING (case_id, track)
  LEFT JOIN (SELECT case_id, track, 1 - (rank - 1) / count(*) OVER (PARTITION BY case_id) AS tr FROM trecs) USING (case_id, track)"""


def _three(r: Run) -> DataFrame:
    labels = cut(hybrid.artist_labels(r.tracks))
    lists = blocks.recommend(r.train.interactions, r.pop, r.cases, r.seeds, K, TOPK_SIM, labels=labels)
    most = r.seeds.groupBy("case_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    best = title.best_of(title.asked_titles(r.cases), r.title_model, r.train.interactions, r.pop, K + int(most), NEIGHBOURS)
    return hybrid.features_of_lists(lists, best, r.cases, r.seeds, r.pop, labels, K, PER_SOURCE)


@query("g6a_masked_features", _FEATS)
def g6a(spark, d):
    """The features of the sources that SQL has too, als and w2v left out; g6a_hybrid_features has all of them."""
    return _three(Run(spark, d))


@query("g6_masked_equal", f"SELECT case_id, track, round(round(cf, 6) + als + w2v + title + pop + artist_overlap, 6) AS score FROM ({_FEATS})")
def g6e(spark, d):
    return hybrid.equal_score(_three(Run(spark, d)))


@query("g6a_hybrid_features")
def g6f(spark, d):
    """All six features of the candidates of all five sources."""
    return Run(spark, d).feats


@query("g6_hybrid")
def g6(spark, d):
    """The whole hybrid: five sources, six features, boosted blender."""
    return Run(spark, d).hybrid_recs


@query("g6_hybrid_equal")
def g6q(spark, d):
    return Run(spark, d).blended("equal")


@query("g6_hybrid_logreg")
def g6l(spark, d):
    return Run(spark, d).blended("logreg")


@query("g7_routed_hybrid")
def g7h(spark, d):
    """The hybrid and the title model, fused by the number of seeds."""
    r = Run(spark, d)
    return routed.fuse(r.hybrid_recs, r.title_recs, routed.weights(r.cases, r.seeds), K)


@query("g3_als")
def g3(spark, d):
    return Run(spark, d).case_sources["als"]


@query("g4_track2vec")
def g4(spark, d):
    return Run(spark, d).case_sources["w2v"]


# ---- taste

PHRASES = ["slow sad country songs with meaning", "Upbeat electronic hype", "nothing known", "chill acoustic melody, deep and meaningful"]


@query("g9a_stated", "SELECT doc_id, " + ", ".join("CAST(" + " + ".join([f"CASE WHEN contains(lower(text), '{p}') THEN {e[a]} ELSE 0 END" for p, e in taste.LEXICON.items() if a in e] or ["0"]) + f" AS DOUBLE) AS a{i}" for i, a in enumerate(AXES)) + " FROM (SELECT doc_id, left(text, 0) || CASE doc_id % 4 WHEN 0 THEN '" + "' WHEN 1 THEN '".join(PHRASES[:2]) + f"' WHEN 2 THEN '{PHRASES[2]}' ELSE '{PHRASES[3]}' END || ' ' || text AS text FROM documents)")
def g9a(spark, d):
    pick = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = C.table(spark, d, "documents").select("doc_id", taste.stated(F.concat(pick, F.lit(" "), F.col("text"))).alias("a"))
    return docs.select("doc_id", *[F.get("a", F.lit(i)).alias(f"a{i}") for i in range(len(AXES))])


_CUT = "CASE WHEN {} < 0.4 THEN '{}' WHEN {} > 0.66 THEN '{}' ELSE '{}' END"


@query("g9f_flavour_name", "SELECT track, " + _CUT.format("axes[1]", "slow", "axes[1]", "fast", "mid-tempo") + " || ', ' || " + _CUT.format("axes[3]", "sad", "axes[3]", "upbeat", "even-keeled") + " || CASE WHEN axes[4] > 0.6 THEN ', acoustic' WHEN axes[4] < 0.3 THEN ', electronic' ELSE '' END || CASE WHEN axes[2] > 0.75 THEN ', high-energy' ELSE '' END || ' ' || (['" + "','".join(GENRES) + "'])[list_position(axes[6:15], list_max(axes[6:15]))] || CASE WHEN axes[5] > 0.65 THEN ' with deep lyrics' ELSE '' END AS name FROM feats")
def g9f(spark, d):
    return C.order_features(spark, d).select("track", taste.name_flavour(F.col("axes")).alias("name"))


_W = "[CASE WHEN case_id % 7 = 0 THEN 0.0 ELSE (i % 5 - 2.0) * (case_id % 3 + 1) / 6 END FOR i IN range(0, 15)]"
_TASTE = f"""SELECT case_id, track, round(1.0 * CASE WHEN hi > lo THEN (axis - lo) / (hi - lo) ELSE 0 END + 0.6 * CASE WHEN chi > clo THEN (cf - clo) / (chi - clo) ELSE 0 END, 6) AS score FROM (
  SELECT *, min(axis) OVER w AS lo, max(axis) OVER w AS hi, min(cf) OVER w AS clo, max(cf) OVER w AS chi FROM (
    SELECT case_id, track, round(list_sum([z[i] * w[i] FOR i IN range(1, 16)]), 9) AS axis, coalesce(score, 0) AS cf FROM (SELECT case_id, {_W} AS w FROM cases) CROSS JOIN ({_Z}) LEFT JOIN {{cf}} USING (case_id, track)) WINDOW w AS (PARTITION BY case_id))"""
_FIRST = "SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, track) AS BIGINT) AS rank, track, score"


@query("g9g_taste_score", f"{_FIRST} FROM ({_TASTE.format(cf='cfscore')}) QUALIFY rank <= {K}")
def g9g(spark, d):
    r = Run(spark, d)
    cf = ranking.without(itemcf.scores(r.seeds, r.near).filter("score > 0"), r.seeds)
    return taste.score(r.weights, r.rounded_z, cf, K)


#: Collaborative scores of all tracks, seeds among them.
_ALL_CF = "(SELECT case_id, j AS track, round(sum(sim), 6) AS score FROM seeds JOIN near ON track = i GROUP BY case_id, j)"
_TAKEN = "(case_id, track) NOT IN (SELECT case_id, track FROM seeds)"


@query("g9h_taste_recommend", f"""{_FIRST} FROM ({_TASTE.format(cf=_ALL_CF)}) WHERE {_TAKEN} AND (case_id % 7 <> 0 OR case_id IN (SELECT case_id FROM seeds)) QUALIFY rank <= {K}
UNION ALL SELECT case_id, rank, track, score FROM poprecs WHERE case_id % 7 = 0 AND case_id NOT IN (SELECT case_id FROM seeds)""")
def g9h(spark, d):
    r = Run(spark, d)
    return taste.recommend(r.weights, r.rounded_z, r.near, r.cases, r.seeds, r.pop, K)


@query("g9h_taste_engine")
def g9e2(spark, d):
    """The taste engine as a whole: learned weights, blended with what the title says."""
    r = Run(spark, d)
    said = r.cases.select("case_id", taste.stated(F.coalesce("title", F.lit(""))).alias("stated"))
    return taste.recommend(taste.weights_of(r.cases, r.learned, said), r.z, r.near, r.cases, r.seeds, r.pop, K)


@query("c16_support", "SELECT r.case_id, r.track, count(DISTINCT s.track) AS n FROM cfrecs r JOIN seeds s ON s.case_id = r.case_id JOIN near n ON n.i = s.track AND n.j = r.track GROUP BY r.case_id, r.track")
def c16(spark, d):
    r = Run(spark, d)
    each = r.cf_lists.select("case_id", F.explode(F.arrays_zip("tracks", "support")).alias("x"))
    return each.select("case_id", F.col("x.tracks").alias("track"), F.col("x.support").alias("n")).filter("n > 0")


@query("c15_same_artist", "SELECT DISTINCT r.case_id, r.track FROM cfrecs r JOIN tracks t USING (track) WHERE (r.case_id, artist) IN (SELECT case_id, artist FROM seeds JOIN tracks USING (track))")
def c15(spark, d):
    r = Run(spark, d)
    return taste.same_artist(r.cf_recs, r.seeds, r.tracks).distinct()


@query("g9c_i1_profile")
def g9c(spark, d):
    r = Run(spark, d)
    said = r.cases.select("case_id", taste.stated(F.coalesce("title", F.lit(""))).alias("stated"))
    both = said.join(r.learned, "case_id")
    return both.select("case_id", "stated", "learned", taste.blend(F.col("stated"), F.col("learned"), 0.4).alias("w"))


@query("g9e_flavours")
def g9e(spark, d):
    return Run(spark, d).flavours


def _explained(r: Run) -> DataFrame:
    w = r.learned.select("case_id", F.col("learned").alias("w"))
    shown = ranking.first(r.cf_lists, ranking.clamped(24), "scores", "support").select("case_id", F.posexplode(F.arrays_zip("tracks", "scores", "support")).alias("at", "x"))
    shown = cut(shown.select("case_id", (F.col("at") + 1).cast("long").alias("rank"), F.col("x.tracks").alias("track"), F.col("x.scores").alias("score"), F.col("x.support").alias("support")))
    return taste.explain(shown, r.seeds, None, r.tracks, r.flavours, r.features, r.z, w)


@query("g9i_explain")
def g9i(spark, d):
    return _explained(Run(spark, d)).drop("support", "same")


@query("i2_cards")
def i2(spark, d):
    r = Run(spark, d)
    return taste.cards(_explained(r), r.tracks, r.features)


_NEAREST = "SELECT case_id, track, arg_min(name, d) AS flavour FROM (SELECT r.case_id, r.track, f.name, {{'d': round(list_sum([(a.axes[i] - f.c[i]) * (a.axes[i] - f.c[i]) FOR i IN range(1, 16)]), 9), 'n': f.flavour}} AS d FROM (SELECT * FROM cfrecs WHERE rank <= 24) r JOIN feats a USING (track) JOIN ({f}) f ON true) GROUP BY case_id, track"
#: Three flavours made of corners of the axes, the same for all cases.
_CORNERS = [(0, "low", 0.1), (1, "middle", 0.5), (2, "high", 0.9)]


@query("e10_nearest_flavour", _NEAREST.format(f=" UNION ALL ".join(f"SELECT {i} AS flavour, '{n}' AS name, [CASE WHEN x <= 5 THEN {v} ELSE 0.0 END FOR x IN range(1, 16)] AS c" for i, n, v in _CORNERS)))
def e10(spark, d):
    r = Run(spark, d)
    corner = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("flavour"), F.lit(n).alias("name"), F.array(*[F.lit(v if x < 5 else 0.0) for x in range(15)]).alias("centroid")) for i, n, v in _CORNERS]))
    flavour = r.cases.select("case_id", corner.alias("f")).select("case_id", "f.*")
    return taste.nearest_flavour(r.cf_recs.filter("rank <= 24"), flavour, r.features)


# ---- harness


@query("h1_split", "SELECT pid FROM testp")
def h1(spark, d):
    r = Run(spark, d)
    return C.test_pids(r.all, r.n_lists // TEST_SHARE, SEED)


@query("h4_scenarios", "SELECT pid, scenario FROM assigned")
def h4(spark, d):
    r = Run(spark, d)
    return S.assign(r.test.interactions.groupBy("pid").agg(F.count("*").alias("n")), max(1, r.n_lists // QUOTA_SHARE))


@query("h5_cut", "SELECT case_id, ord, track, true AS is_seed FROM seeds UNION ALL SELECT case_id, ord, track, false FROM holdout")
def h5(spark, d):
    r = Run(spark, d)
    return r.seeds.withColumn("is_seed", F.lit(True)).unionByName(r.holdout.withColumn("is_seed", F.lit(False)))


def _long_lists(spark, d) -> C.Corpus:
    """Suppliers as lists of what they delivered."""
    items = C.table(spark, d, "lineitem")
    w = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    inter = items.select(F.col("l_suppkey").alias("pid"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.col("l_partkey").alias("track"))
    return C.Corpus(cut(inter), inter.select("pid").distinct().withColumn("title", F.lit("t")), inter.select("track").distinct())


@query("h4_long_scenarios", "SELECT pid, scenario FROM longassigned")
def h4g(spark, d):
    """Lists of over 120 tracks: all ten scenarios."""
    return S.assign(_long_lists(spark, d).interactions.groupBy("pid").agg(F.count("*").alias("n")), LONG_QUOTA)


@query("h5_long_cut", "SELECT case_id, ord, track, true AS is_seed FROM longseeds UNION ALL SELECT case_id, ord, track, false FROM longholdout")
def h5g(spark, d):
    _, seeds, holdout = S.build(_long_lists(spark, d), LONG_QUOTA, SEED)
    return seeds.withColumn("is_seed", F.lit(True)).unionByName(holdout.withColumn("is_seed", F.lit(False)))


@query("h6_h7_h8_metrics", "SELECT case_id, scenario, r_precision, ndcg, clicks FROM cfm")
def h6(spark, d):
    r = Run(spark, d)
    return M.evaluate(r.cf_recs, r.holdout, r.cases, r.tracks)




@query("h11_intra_list", "SELECT case_id, round(CASE WHEN n < 2 THEN 0 ELSE (list_sum([x * x FOR x IN s]) - own) / (n * (n - 1)) END, 6) AS ils FROM (SELECT case_id, count(*) AS n, sum(CASE WHEN len > 0 THEN 1.0 ELSE 0 END) AS own, [" + ", ".join(f"sum(axes[{i}] / len)" for i in range(1, 16)) + "] AS s FROM (SELECT case_id, axes, sqrt(list_sum([x * x FOR x IN axes])) AS len FROM cfrecs JOIN feats USING (track) WHERE rank <= 100) GROUP BY case_id)")
def h11(spark, d):
    r = Run(spark, d)
    return M.intra_list_similarity(r.cf_recs.filter("rank <= 100"), r.features, len(AXES))


@query("h13_submission_build", f"SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY tier, o, track) AS rank, track FROM (SELECT case_id, track, 0 AS tier, rank AS o FROM cfrecs WHERE rank % 3 > 0 UNION ALL SELECT case_id, track, 1, pop_rank FROM cases, poprank WHERE (case_id, track) NOT IN (SELECT case_id, track FROM cfrecs WHERE rank % 3 > 0) AND (case_id, track) NOT IN (SELECT case_id, track FROM seeds)) QUALIFY rank <= {K}")
def h13(spark, d):
    """Two thirds of a model's rows, topped up with popular tracks."""
    r = Run(spark, d)
    part = r.cf_lists.select("case_id", F.filter("tracks", lambda x, i: (i + 1) % 3 > 0).alias("tracks"))
    return ranking.tracks_of(submission.listed(part, r.cases, r.seeds, ranking.popular_top(r.pop, 2 * K + 200), K))


@query("h13_challenge", _FAST)
def h13c(spark, d):
    """The cases as a challenge set, answered as a submission."""
    r = Run(spark, d)
    tracks = F.transform(F.array_sort(F.collect_list(F.struct("ord", "track"))), lambda x: x["track"])
    kind = r.seeds.schema["track"].dataType.simpleString()
    asked = r.cases.join(r.seeds.groupBy("case_id").agg(tracks.alias("tracks")), "case_id", "left")
    asked = asked.select(F.col("case_id").alias("pid"), "title", F.coalesce("tracks", F.array().cast(f"array<{kind}>")).alias("tracks"))
    return challenge.answer(r.train, asked, K, TOPK_SIM, NEIGHBOURS)


@query("h14_validation", "SELECT event_id + 2 AS line, CASE WHEN user_id % 5 = 0 THEN 'pid must be an integer, got u' || user_id WHEN user_id % 5 = 1 THEN 'pid ' || event_id || ' has duplicate track_uris' ELSE 'bad track_uri z' END AS error FROM events WHERE user_id % 5 < 3")
def h14(spark, d):
    e = C.table(spark, d, "events")
    good = F.concat(F.col("event_id").cast("string"), F.lit(",spotify:track:a,spotify:track:b"))
    row = F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(",spotify:track:a"))).when(F.col("user_id") % 5 == 1, F.concat(good, F.lit(",spotify:track:a"))).when(F.col("user_id") % 5 == 2, F.concat(good, F.lit(",z"))).otherwise(good)
    head = spark.createDataFrame([(1, "team_info,t,a@b.c")], "line long, value string")
    return submission.validate_lines(head.unionByName(e.select((F.col("event_id") + 2).alias("line"), row.alias("value"))))


@query("i4_sample_lists", "SELECT artist, pid FROM (SELECT artist, pid, row_number() OVER (PARTITION BY artist ORDER BY md5('5:' || pid), pid) AS r FROM (SELECT pid, artist FROM (SELECT pid, artist, row_number() OVER (PARTITION BY pid ORDER BY count(*) DESC, artist) AS q FROM inter JOIN tracks USING (track) GROUP BY pid, artist) WHERE q = 1) JOIN (SELECT pid FROM inter GROUP BY pid HAVING count(*) BETWEEN 12 AND 45) USING (pid)) WHERE r = 1 ORDER BY artist LIMIT 6")
def i4(spark, d):
    return C.sample_lists(C.order_interactions(spark, d), d17(spark, d), "artist")


@query("i5_weighted_sample", "SELECT track, pop FROM (SELECT track, pop, round(-ln((CAST('0x' || left(md5('7:' || track), 12) AS BIGINT) + 1) / 281474976710657.0) / (pop + 0.001), 12) AS k FROM allpop) ORDER BY k, track LIMIT 600")
def i5(spark, d):
    c = C.from_orders(spark, d)
    return C.sample_tracks(ranking.popularity(c.interactions, c.tracks))


# ---- studies


@query("h15_verdicts")
def h15(spark, d):
    """Whether what holds for lists with a title holds for those without."""
    r = Run(spark, d)
    per = cut(M.evaluate(r.recs_of, r.holdout, r.cases, r.tracks, ["popularity", "item_cf", "title"]))
    titled = r.cases.filter("title is not null").select("case_id")
    return results.verdicts(M.summarise(per.join(titled, "case_id", "left_semi")), M.summarise(per.join(titled, "case_id", "left_anti")))


_SWEPT = " UNION ALL ".join(f"SELECT '{n}' AS topk, count(*) AS n, round(avg(r_precision), 9) AS r_precision, round(avg(ndcg), 9) AS ndcg, round(avg(clicks), 9) AS clicks FROM cf{n}m" for n in SWEEP)


@query("h16_sweep_neighbours", _SWEPT)
def h16(spark, d):
    r = Run(spark, d)
    make = lambda n: itemcf.recommend(r.near.filter(F.col("rank") <= n), r.cases, r.seeds, r.pop, K)
    return studies.sweep(list(SWEEP), make, "topk", r.holdout, r.cases, r.tracks)


@query("h16_sweep_normalization")
def h16n(spark, d):
    r = Run(spark, d)
    make = lambda kind: itemcf.recommend(cut(itemcf.fit(r.train.interactions, r.pop, kind, TOPK_SIM)), r.cases, r.seeds, r.pop, K)
    return studies.sweep(list(itemcf.NORMALIZATIONS), make, "normalization", r.holdout, r.cases, r.tracks)


_ALLRECS = "(SELECT 'popularity' AS model, case_id, rank, track FROM poprecs UNION ALL SELECT 'item_cf', case_id, rank, track FROM cfrecs UNION ALL SELECT 'title', case_id, rank, track FROM trecs)"
_ILS = "SELECT model, case_id, round(CASE WHEN n < 2 THEN 0 ELSE (list_sum([x * x FOR x IN s]) - own) / (n * (n - 1)) END, 6) AS ils FROM (SELECT model, case_id, count(*) AS n, sum(CASE WHEN len > 0 THEN 1.0 ELSE 0 END) AS own, [" + ", ".join(f"sum(axes[{i}] / len)" for i in range(1, 16)) + f"] AS s FROM (SELECT model, case_id, axes, sqrt(list_sum([x * x FOR x IN axes])) AS len FROM {_ALLRECS} JOIN feats USING (track) WHERE rank <= 100) GROUP BY model, case_id)"


@query("h17_popularity_bias", f"""SELECT model, coverage, intra_list_sim, coalesce(head_recall, 0.0) AS head_recall, coalesce(torso_recall, 0.0) AS torso_recall, coalesce(tail_recall, 0.0) AS tail_recall FROM
  (SELECT model, round(count(DISTINCT track) / (SELECT count(*) FROM part), 6) AS coverage FROM {_ALLRECS} GROUP BY model) JOIN (SELECT model, round(avg(ils), 4) AS intra_list_sim FROM ({_ILS}) GROUP BY model) USING (model)
  LEFT JOIN (SELECT model, {", ".join(f"round(max(hits / demand) FILTER (bucket = '{b}'), 6) AS {b}_recall" for b in ("head", "torso", "tail"))} FROM
    (SELECT model, bucket, count(*) AS hits FROM {_ALLRECS} JOIN (SELECT DISTINCT case_id, track FROM holdout) USING (case_id, track) JOIN ({_BUCKETS}) USING (track) GROUP BY model, bucket)
    JOIN (SELECT bucket, count(*) AS demand FROM (SELECT DISTINCT case_id, track FROM holdout) JOIN ({_BUCKETS}) USING (track) GROUP BY bucket) USING (bucket) GROUP BY model) USING (model)""")
def h17(spark, d):
    r = Run(spark, d)
    return M.bias(r.recs_of, r.holdout, M.buckets(r.pop), r.features, r.tracks.count(), K, len(AXES))


def _halves(r: Run) -> DataFrame:
    """Popularity and item-to-item lists of the whole corpus and of halves of it, by hash."""

    def run(part: int | None):
        inter = r.train.interactions if part is None else r.train.interactions.filter(F.pmod(F.xxhash64("pid"), F.lit(2)) == part)
        pop = cut(ranking.popularity(inter, r.tracks))
        near = cut(itemcf.fit(inter, pop, topk=TOPK_SIM))
        found = {"popularity": ranking.with_backfill(r.none, r.cases, r.seeds, pop, K), "item_cf": itemcf.recommend(near, r.cases, r.seeds, pop, K)}
        return studies.judged(found, r.holdout, r.cases, r.tracks)

    return cut(studies.runs({"whole": lambda: run(None), "half 0": lambda: run(0), "half 1": lambda: run(1)}, "size"))


@query("h17_spread_over_halves")
def h17s(spark, d):
    return studies.spread(_halves(Run(spark, d)).filter("size <> 'whole'"))


@query("h17_scale")
def h17z(spark, d):
    return studies.by_scale(_halves(Run(spark, d)), ["whole", "half 0"])


@query("h18_stated_vectors", f"SELECT case_id, mode, round(s * c[1] / len, 6) AS a0, round(s * c[3] / len, 6) AS a2, round(s * c[6] / len, 6) AS a5 FROM (SELECT case_id, c, sqrt(list_sum([x * x FOR x IN c])) AS len FROM (SELECT case_id, [" + ", ".join(f"avg(z[{i}])" for i in range(1, 16)) + f"] AS c FROM (SELECT case_id, track FROM seeds UNION ALL SELECT case_id, track FROM holdout) JOIN ({_Z}) USING (track) GROUP BY case_id)), (VALUES ('honest', 1.0), ('adversarial', -1.0)) AS v(mode, s)")
def h18(spark, d):
    r = Run(spark, d)
    s = studies.oracle_stated(r.seeds, r.holdout, r.rounded_z)
    return s.select("case_id", "mode", *[F.round(F.get("stated", F.lit(i)), 6).alias(f"a{i}") for i in (0, 2, 5)])


@query("h18_trust_study")
def h18t(spark, d):
    r = Run(spark, d)
    return studies.trust_study(studies.oracle_stated(r.seeds, r.holdout, r.z), r.learned, r.z, r.near, r.cases, r.seeds, r.pop, r.holdout, r.tracks, K)


@query("h19_axis_ablation")
def h19(spark, d):
    r = Run(spark, d)
    w = taste.weights_of(r.cases, r.learned)
    return studies.axis_ablation(w, r.z, r.near, r.cases, r.seeds, r.pop, r.holdout, r.tracks, K, AXES[:5])
