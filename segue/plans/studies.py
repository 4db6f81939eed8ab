"""Studies: many settings judged in one pass, instead of one evaluation a setting.

A setting becomes a column of the recommendations (or, where it changes the queries, a part of the case's key), so
each study is one plan over all its settings.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2, mean_vector
from ..operators import taste
from ..schema import AXES
from . import metrics as M

#: Trust in stated preferences along the two curves.
TRUST_STUDY, TRUST_CURVE = (0.0, 0.25, 0.5, 0.75, 1.0), (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


def judged(by_setting: dict[str, DataFrame], holdout: DataFrame, cases: DataFrame, tracks: DataFrame) -> DataFrame:
    """model (the setting), scenario, n and mean metrics of the recommendations of each setting."""
    recs = reduce(DataFrame.unionByName, [r.select("case_id", "rank", "track").withColumn("model", F.lit(m)) for m, r in by_setting.items()])
    return M.summarise(M.evaluate(recs, holdout, cases, tracks, list(by_setting)))


def sweep(values: list, make: Callable[[object], DataFrame], knob: str, holdout: DataFrame, cases: DataFrame, tracks: DataFrame) -> DataFrame:
    """knob, n and OVERALL metrics for each value; make(value) gives recommendations for the cases."""
    out = judged({str(v): make(v) for v in values}, holdout, cases, tracks).filter(F.col("scenario") == "OVERALL")
    return out.select(F.col("model").alias(knob), "n", "r_precision", "ndcg", "clicks")


def runs(settings: dict[str, Callable[[], DataFrame]], name: str) -> DataFrame:
    """Summaries (model, scenario, ..) of several whole runs, such as seeds or sizes of the corpus, with the run's name."""
    return reduce(DataFrame.unionByName, [make().withColumn(name, F.lit(k)) for k, make in settings.items()])


def spread(summaries: DataFrame) -> DataFrame:
    """model, mean and sample deviation of the OVERALL metrics over runs."""
    o = summaries.filter(F.col("scenario") == "OVERALL")
    cols = [f(c).alias(f"{c}_{n}") for c in ("r_precision", "ndcg", "clicks") for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    g = o.groupBy("model").agg(*cols)
    return g.select("model", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in g.columns[1:]])


def by_scale(summaries: DataFrame, sizes: list[str], name: str = "size") -> DataFrame:
    """The run's size and OVERALL R-precision of each model."""
    models = [r[0] for r in summaries.select("model").distinct().orderBy("model").collect()]  # as many as there are models
    return summaries.filter((F.col("scenario") == "OVERALL") & F.col(name).isin(sizes)).groupBy(name).pivot("model", models).agg(F.round(F.avg("r_precision"), 4))


def oracle_stated(seeds: DataFrame, holdout: DataFrame, z: DataFrame) -> DataFrame:
    """case_id, mode, stated: the direction of a case's whole list (honest), and its opposite (adversarial)."""
    whole = seeds.select("case_id", "track").unionByName(holdout.select("case_id", "track")).join(z, "track")
    own = mean_vector(whole, "case_id", "z", len(AXES)).select("case_id", l2(F.col("mean")).alias("v"))
    modes = F.explode(F.array(F.struct(F.lit("honest").alias("mode"), F.col("v").alias("stated")), F.struct(F.lit("adversarial").alias("mode"), F.transform("v", lambda x: -x).alias("stated"))))
    return own.select("case_id", modes.alias("m")).select("case_id", "m.mode", "m.stated")


def _named(mode: str, trust: float) -> str:
    return f"{mode}:{trust}"


def trust_study(stated: DataFrame, learned: DataFrame, z: DataFrame, near: DataFrame, cases: DataFrame, seeds: DataFrame, pop: DataFrame, holdout: DataFrame, tracks: DataFrame, k: int, trusts: tuple[float, ...] = TRUST_STUDY) -> DataFrame:
    """knob, mode, trust and OVERALL metrics of the taste engine with stated weights (case_id, mode, stated)."""
    found = {}
    for mode in ("honest", "adversarial"):
        own = stated.filter(F.col("mode") == mode)
        for t in trusts:
            w = taste.weights_of(cases, learned, own, t)
            found[_named(mode, t)] = taste.recommend(w, z, near, cases, seeds, pop, k)
    o = judged(found, holdout, cases, tracks).filter(F.col("scenario") == "OVERALL")
    parts = F.split("model", ":")
    return o.select(F.lit("trust").alias("knob"), F.get(parts, F.lit(0)).alias("mode"), F.get(parts, F.lit(1)).cast("double").alias("trust"), "n", "r_precision", "ndcg", "clicks")


def axis_ablation(weights: DataFrame, z: DataFrame, near: DataFrame, cases: DataFrame, seeds: DataFrame, pop: DataFrame, holdout: DataFrame, tracks: DataFrame, k: int, axes: list[str] | None = None) -> DataFrame:
    """axis, metrics and the change of R-precision when the axis is 0 in the whole catalogue; (none) is the baseline."""
    found = {"(none)": taste.recommend(weights, z, near, cases, seeds, pop, k)}
    for a in axes or AXES:
        at = AXES.index(a)
        zero = F.concat(F.slice("z", F.lit(1), F.lit(at)), F.array(F.lit(0.0)), F.slice("z", F.lit(at + 2), F.lit(len(AXES))))
        found[a] = taste.recommend(weights, z.withColumn("z", zero), near, cases, seeds, pop, k)
    o = judged(found, holdout, cases, tracks).filter(F.col("scenario") == "OVERALL")
    return M.deltas(o, "(none)").select(F.col("model").alias("axis"), "r_precision", "delta")


def trust_curve(personas: DataFrame, learned: DataFrame, z: DataFrame, near: DataFrame, seeds: DataFrame, pop: DataFrame, tracks: DataFrame, column: str, top: int = 20, trusts: tuple[float, ...] = TRUST_CURVE) -> DataFrame:
    """case_id, trust, fit: the share of a persona's first `top` recommendations that are on target, at each trust.

    personas (case_id, stated, target); all trusts are one batch: a persona at a trust is a case of its own.
    """
    each = F.explode(F.array(*[F.lit(t) for t in trusts]))
    key = F.concat_ws("@", F.col("case_id").cast("string"), F.col("trust").cast("string")).alias("key")
    p = personas.select("case_id", "stated", "target", each.alias("trust")).select("*", key)
    w = p.join(learned, "case_id", "left").withColumn("learned", F.coalesce("learned", F.array_repeat(F.lit(0.0), len(AXES))))
    says = F.exists("stated", lambda x: F.abs(x) > 1e-9)
    w = w.select(F.col("key").alias("case_id"), F.when(says, taste.blend(F.col("stated"), F.col("learned"), F.col("trust"))).otherwise(l2(F.col("learned"))).alias("w"))
    own = seeds.join(p.select("case_id", "key"), "case_id").select(F.col("key").alias("case_id"), "ord", "track")
    recs = taste.recommend(w, z, near, w.select("case_id"), own, pop, top)
    fit = M.on_target(recs, tracks, p.select(F.col("key").alias("case_id"), "target"), column, top)
    return p.select("case_id", "trust", "key").join(fit.withColumnRenamed("case_id", "key"), "key", "left").select("case_id", "trust", F.coalesce("fit", F.lit(0.0)).alias("fit"))
