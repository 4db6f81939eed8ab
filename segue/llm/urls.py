"""URL filtering by rules and by empirical-Bayes host reputation, with DataFrame functions only.

Rules come first: a rule (host, path) fits its host and all subdomains if the url's path starts
with the rule's path; the longest rule string wins. Other urls get the verdict of their host's
reputation: labelled pages of a host give counts (bad, all), which are shrunk through
beta-binomial priors: the host's towards its registered domain's mean, that towards its
suffix's, that towards the overall mean. The strength of each prior is estimated from the
spread between the groups of its level (ANOVA estimator of the intra-class correlation). A host
is blocked if the lower posterior bound of its bad rate exceeds a threshold.

Defined results: a null url, or one without `://`, has empty host and path and the reputation of
the empty host; null labels count for nothing; several labels of a page are several outcomes;
with no labels at all, the overall mean is 0 and the method allows; repeated rows are judged
alike; columns that are not needed are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Common public suffixes of two labels.
TWO_LABEL_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "ne.jp", "ac.jp", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr", "co.za", "com.ar", "com.tw", "com.hk", "com.sg"]
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0
#: Beyond so many rules they are joined instead of written into the expression.
INLINE_RULES = 200

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def split_url(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, parts, 1), UPPER, LOWER), F.regexp_extract(u, parts, 2)


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column) -> Column:
    """The suffix and one label more; numeric addresses and single labels stay whole."""
    two = F.substring_index(host, ".", -2)
    name = F.when(two.isin(TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)
    return F.when(host.rlike(r"^[0-9.]+(:[0-9]+)?$"), host).otherwise(name)


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host))) & F.startswith(path, rule_path)


def apply_rules(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Adds rule and rule_verdict (null if none fits) to (page_id, host, path)."""
    if not isinstance(rules, DataFrame) and len(rules) <= INLINE_RULES:
        best, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is tested first
            fits = _fits(F.col("host"), F.col("path"), F.lit(h), F.lit(p))
            best, verdict = F.when(fits, F.lit(h + p)).otherwise(best), F.when(fits, F.lit(v)).otherwise(verdict)
        return pages.withColumn("rule", best).withColumn("rule_verdict", verdict)
    spark = pages.sparkSession
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, "rule_host string, rule_path string, verdict string")
    table = table.toDF("__rh", "__rp", "__rv")
    # Distinct (host, path) pairs meet the rules of each of their host's suffixes by an equi-join.
    labels = F.split("host", r"\.")
    heads = F.expr("transform(sequence(1, size(__l)), i -> array_join(slice(__l, i, size(__l)), '.'))")
    urls = pages.select("host", "path").distinct().withColumn("__l", labels)
    hit = urls.withColumn("__rh", F.explode(heads)).join(table, "__rh").filter(F.startswith("path", "__rp"))
    rule = F.concat("__rh", "__rp")
    best = hit.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), F.col("__rv").alias("v"))).alias("b"))
    return pages.join(best.select("host", "path", F.col("b.rule").alias("rule"), F.col("b.v").alias("rule_verdict")), ["host", "path"], "left")


def _strength(groups: DataFrame, name: str) -> Column:
    """One row: the prior strength for groups (x bad of n), 1/rho - 1."""
    s = groups.filter(F.col("n") > 0).agg(
        F.count("*").alias("g"), F.sum("n").alias("N"), F.sum("x").alias("X"),
        F.sum(F.col("x").cast("double") * F.col("x") / F.col("n")).alias("q"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
    )
    p = F.col("X") / F.col("N")
    within = p * (1 - p)
    rho = F.try_divide(F.col("q") - F.col("N") * p * p - (F.col("g") - 1) * within, within * (F.col("N") - F.try_divide(F.col("nn"), F.col("N")) - (F.col("g") - 1)))
    k = F.when(rho > 0, F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), 1 / rho - 1))).otherwise(F.lit(STRONGEST))
    return s.select(F.round(F.coalesce(k, F.lit(STRONGEST)), 6).alias(name))


def reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """host, domain, suffix, rows, pages (with an outcome), bad_mean, bad_bound of outcomes (host, bad: 0, 1 or null)."""
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("rows"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("x"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", registered_domain(F.col("host")))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    # Four numbers for all levels: read by the driver, so that no one-row join is needed.
    whole = suffixes.agg(F.coalesce(F.sum("x") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("m")).first()["m"]
    k1, k2, k3 = (_strength(g, "k").first()["k"] for g in (suffixes, domains, hosts))
    shrunk = lambda prior, k: (F.lit(k) * prior + F.col("x")) / (F.lit(k) + F.col("n"))
    s = suffixes.select("suffix", shrunk(F.lit(whole), k1).alias("suffix_mean"))
    d = domains.join(s, "suffix").select("suffix", "domain", shrunk(F.col("suffix_mean"), k2).alias("domain_mean"))
    h = hosts.join(d, ["suffix", "domain"])
    mean = shrunk(F.col("domain_mean"), k3)
    sd = F.sqrt(F.col("bad_mean") * (1 - F.col("bad_mean")) / (F.lit(k3) + F.col("n") + 1))
    return h.withColumn("bad_mean", mean).withColumn("bad_bound", F.col("bad_mean") - z * sd).select("host", "domain", "suffix", "rows", F.col("n").alias("pages"), "bad_mean", "bad_bound")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, z: float = 1.645, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_mean, bad_bound of each row of pages (page_id, url).

    Labels (doc_id, quality, toxic) are outcomes of the pages with their ids; bad is low quality or toxic.
    """
    host, path = split_url(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    known = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    outcomes = p.select("page_id", "host").join(known, "page_id", "left").select("host", "bad")
    known = cut(reputation(outcomes, z))
    judged = spread_join(apply_rules(p, rules), known, "host", known.select("host", F.col("rows").alias("c")), p.count(), "page_id")
    own = F.when(F.col("bad_bound") > threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "bad_mean", "bad_bound")
