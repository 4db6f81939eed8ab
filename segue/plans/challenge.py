"""A challenge set answered as a submission: read, route, recommend, fill up, write, validate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import cut
from ..operators import blocks, ranking, routed, title
from ..sources import results, submission
from .corpus import Corpus
from .metrics import seed_coverage


def cases_of(challenge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases(case_id, title), seeds(case_id, ord, track)) of challenge rows (pid, title, tracks)."""
    seeds = challenge.select(F.col("pid").alias("case_id"), F.posexplode("tracks").alias("ord", "track"))
    return challenge.select(F.col("pid").alias("case_id"), "title"), seeds


def answer(corpus: Corpus, challenge: DataFrame, k: int = submission.MOST, topk: int = 200, neighbours: int = 50) -> DataFrame:
    """case_id, rank, track: k tracks for each case, by the title model where there are no seeds but a title, else item-to-item."""
    cases, seeds = (cut(d) for d in cases_of(challenge))
    pop = cut(ranking.popularity(corpus.interactions, corpus.tracks))
    route = cut(routed.fast_route(cases, seeds))
    part = lambda model: cases.join(route.filter(F.col("model") == model), "case_id", "left_semi")  # noqa: E731  only the model's own cases are answered by it
    by_seeds, by_title = cut(part("item_cf")), cut(part("title"))
    own = cut(seeds.join(by_seeds.select("case_id"), "case_id", "left_semi"))
    cf = ranking.rows(blocks.recommend(corpus.interactions, pop, by_seeds, own, k, topk))
    lists = corpus.playlists.join(corpus.interactions.select("pid").distinct(), "pid", "left_semi")
    named = title.recommend(tuple(cut(d) for d in title.fit(lists)), corpus.interactions, by_title, seeds.limit(0), pop, k, neighbours)
    recs = routed.fast_lists(route, cf, named, k)
    most = seeds.groupBy("case_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    return submission.build(recs, cases, seeds, ranking.popular_top(pop, 2 * k + int(most)), k)


def submit(corpus: Corpus, challenge: DataFrame, path: str, team: str, contact: str, k: int = submission.MOST) -> dict:
    """Answers, writes both files below path and a description, validates; returns the description."""
    spark = challenge.sparkSession
    recs = cut(answer(corpus, challenge, k))
    submission.write_both(recs, path, team, contact, k if corpus.tracks.count() >= 2 * k else None)
    _, seeds = cases_of(challenge)
    errors = submission.validate(spark, f"{path}/plain", seeds).count()
    known = seed_coverage(seeds, corpus.tracks).agg(F.round(F.avg("rate"), 4)).first()[0]
    meta = {"model": "fast_router", "cases": challenge.count(), "tracks": recs.count(), "errors": errors, "seed_coverage": known}
    results.write_meta(spark, meta, f"{path}/meta")
    return meta
