"""Hand-computed values of the evaluation harness, and brute force on random cases."""

import math
import random

from pyspark.sql import functions as F

from segue.plans import metrics as M
from segue.plans import scenarios as S


def one(spark, gt, pred, artists=None):
    cases = spark.createDataFrame([(1, "s")], "case_id long, scenario string")
    hold = spark.createDataFrame([(1, t) for t in gt], "case_id long, track string")
    recs = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(pred)], "case_id long, rank long, track string")
    tracks = spark.createDataFrame(list(artists.items()), "track string, artist string") if artists else None
    return M.evaluate(recs, hold, cases, tracks).first()


def test_hand_computed(spark):
    assert one(spark, "abcd", "azbwcd").r_precision == 0.5
    assert one(spark, "ab", "az", {"a": "A", "b": "B", "z": "B"}).r_precision == 0.625
    assert one(spark, "", "a").r_precision == 0 and one(spark, "", "a").clicks == 51
    assert abs(one(spark, "ab", "axb").ndcg - (1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3))) < 1e-6
    assert one(spark, "a", [f"x{i}" for i in range(11)] + ["a"]).clicks == 1
    assert one(spark, "a", "xyz").clicks == 51


def plain(gt, pred, artist):
    R = len(gt)
    top, left = pred[:R], list(gt)
    hits = {t for t in top if t in gt}
    demand = {}
    for t in left:
        if t not in hits:
            demand[artist[t]] = demand.get(artist[t], 0) + 1
    credit = 0.0
    for t in top:
        if t not in gt and demand.get(artist[t], 0) > 0:
            demand[artist[t]] -= 1
            credit += 0.25
    rp = min(1.0, (len(hits) + credit) / R)
    dcg = sum(1 / math.log2(i + 2) for i, t in enumerate(pred) if t in gt)
    idcg = sum(1 / math.log2(i + 2) for i in range(len(set(gt))))
    first = next((i for i, t in enumerate(pred) if t in gt), None)
    return round(rp, 6), round(dcg / idcg, 6), 51.0 if first is None else float(first // 10)


def test_random_cases_equal_the_loop(spark):
    r = random.Random(1)
    artist = {f"t{i}": f"a{i % 7}" for i in range(60)}
    cases, hold, recs, want = [], [], [], {}
    for c in range(60):
        gt = r.choices(list(artist), k=r.randint(1, 15))
        pred = r.sample(list(artist), r.randint(1, 40))
        cases.append((c, "s"))
        hold += [(c, t) for t in gt]
        recs += [(c, i + 1, t) for i, t in enumerate(pred)]
        want[c] = plain(gt, pred, artist)
    got = M.evaluate(
        spark.createDataFrame(recs, "case_id long, rank long, track string"), spark.createDataFrame(hold, "case_id long, track string"),
        spark.createDataFrame(cases, "case_id long, scenario string"), spark.createDataFrame(list(artist.items()), "track string, artist string"),
    ).collect()
    assert all(abs(a - b) < 2e-6 for x in got for a, b in zip((x.r_precision, x.ndcg, x.clicks), want[x.case_id]))


def test_coverage_similarity_buckets(spark):
    recs = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "b"), (2, 2, "c"), (2, 3, "d")], "case_id long, rank long, track string")
    assert M.coverage(recs, 8, 3).first().coverage == 0.5 and M.coverage(recs, 8, 1).first().coverage == 0.25
    axes = {"a": [1.0, 0.0, 0.0], "b": [0.0, 1.0, 0.0], "c": [1.0, 1.0, 0.0], "d": [0.0, 0.0, 0.0]}
    v = spark.createDataFrame(list(axes.items()), "track string, axes array<double>")
    got = {r.case_id: r.ils for r in M.intra_list_similarity(recs, v, 3).collect()}
    assert abs(got[1] - (0 + 2 * math.sqrt(0.5)) / 3) < 1e-6 and abs(got[2] - math.sqrt(0.5) / 3) < 1e-6
    pop = spark.createDataFrame([("h", 100), ("x", 50), ("y", 10), ("z", 5), ("t", 1)], "track string, pop long")
    assert {r.track: r.bucket for r in M.buckets(pop, 0.2, 0.2).collect()} == {"h": "head", "x": "torso", "y": "torso", "z": "torso", "t": "tail"}


def greedy(pool, quota):
    used, out = set(), {}
    for n in sorted({s[1] for s in S.SCENARIOS}, reverse=True):
        specs = [s[0] for s in S.SCENARIOS if s[1] == n]
        left, turn = {s: quota for s in specs}, 0
        for pid, size in pool:
            if pid in used or size < S.min_length(n) or not any(left.values()):
                continue
            out[pid] = specs[turn % len(specs)]
            left[specs[turn % len(specs)]] -= 1
            turn += 1
            used.add(pid)
    return out


def test_assignment_equals_the_loop(spark):
    assert [S.min_length(n) for n in (0, 1, 5, 10, 25, 100)] == [3, 4, 8, 13, 31, 121]
    r = random.Random(2)
    for quota in (1, 3, 50):
        pool = [(i, r.choice([2, 3, 5, 9, 14, 35, 60, 130, 200])) for i in range(120)]
        got = {x.pid: x.scenario for x in S.assign(spark.createDataFrame(pool, "pid long, n long"), quota).collect()}
        assert got == greedy(pool, quota)


def test_relevant_rows_give_the_same_metrics(spark):
    """Rows that are neither held out nor among the first R change nothing; a hit after R does."""
    lists = spark.createDataFrame([(1, list("abcdefgh")), (2, list("hgfedcba")), (3, list("abc"))], "case_id long, tracks array<string>")
    holdout = spark.createDataFrame([(1, "b"), (1, "g"), (1, "g"), (2, "a"), (2, "x")], "case_id long, track string")
    cases = spark.createDataFrame([(1, "s"), (2, "s"), (3, "s")], "case_id long, scenario string")
    tracks = spark.createDataFrame([(c, "AB"[i % 2]) for i, c in enumerate("abcdefghx")], "track string, artist string")
    each = lists.select("case_id", F.posexplode("tracks").alias("at", "track")).selectExpr("case_id", "at + 1L AS rank", "track")
    few = M.relevant(lists, holdout)
    assert few.count() < each.count()
    assert sorted(M.evaluate(few, holdout, cases, tracks).collect()) == sorted(M.evaluate(each, holdout, cases, tracks).collect())
    assert sorted(M.first_hits(few, holdout).collect()) == [(1, 1), (2, 7)]
