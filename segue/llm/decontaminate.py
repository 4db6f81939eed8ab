"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

A benchmark item is cut into windows of `size` consecutive words (an item of fewer words, but
not none, is one window). A window is a set of shingles of up to three words; shingles are
ordered by rarity, that is by their count over all documents. Exact containment has a required
overlap of the whole set, so one shingle is a sufficient prefix: each window is looked up by its
rarest shingle only, and a window with a shingle that no document has is dropped. A match says
where the window would start, which must lie within the text (positional bound) and leave room
for the window (length bound); then all its words are compared.

Defined results: null text has no words; a document without words has no hits; repeated
documents are reported once each; items with the same id count as one item; an item with a null
id marks words as hit but is not listed; empty tables give empty results or no hits; columns other
than doc_id, text, item_id are not read, so none can clash; texts of any length are looked through whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut
from .urls import LOWER, UPPER

SHINGLE = 3
#: Broadcast the windows only up to so many of them (each of at most a few hundred bytes).
BROADCAST_WINDOWS = 200_000


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """Distinct windows: win (string), w (its words), len, ids (items that hold it)."""
    w = items.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1))))
    w = w.select("item_id", "words", at.alias("s")).select(F.col("item_id").cast("string").alias("id"), F.slice("words", F.col("s"), F.lit(size)).alias("w"))
    return w.withColumn("win", F.array_join("w", " ")).groupBy("win", "w").agg(F.collect_set("id").alias("ids")).withColumn("len", F.size("w"))


def _key(words: str, at: Column, size: int) -> Column:
    """Hash of the shingle that begins at the 0-based place `at`."""
    return F.xxhash64(F.lit(size), *[F.get(F.col(words), at + i) for i in range(size)])


def _exploded(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each word of a document (one at least) and shingle size, with the hash of the shingle that begins there.
    All sizes come from one pass, so a document's number is the same for all of them."""
    d = docs.select("row", "doc_id", "words", "n", F.posexplode_outer("words").alias("pos", "word"))
    keys = [F.struct(F.lit(k).alias("k"), F.when(F.col("pos") + k <= F.col("n"), _key("words", F.col("pos"), k)).alias("key")) for k in sizes]
    return d.select("row", "doc_id", "words", "n", "pos", F.explode(F.array(*keys)).alias("s")).select("row", "doc_id", "words", "n", "pos", "s.k", "s.key")


def find(docs: DataFrame, items: DataFrame, size: int = 10, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """row, doc_id, n_words, spans (array of struct start, length: hits in words), item_ids (sorted strings)
    for each row of docs (doc_id, text) against items (item_id, text).
    """
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    wins = cut(windows_of(items.select("item_id", "text"), size))
    sizes = sorted(r[0] for r in wins.select(F.least(F.col("len"), F.lit(SHINGLE)).alias("k")).distinct().collect()) or [SHINGLE]  # at most three numbers
    small = wins.count() <= broadcast_windows
    put = F.broadcast if small else (lambda x: x)
    if not small:
        d = cut(d)
    # Shingles of the windows, and their rarity: how often each occurs in all documents.
    shingles = None
    for k in sizes:
        own = wins.filter(F.least(F.col("len"), F.lit(SHINGLE)) == k)
        offs = own.select("win", "w", "len", "ids", F.explode(F.sequence(F.lit(0), F.col("len") - k)).alias("off"))
        part = offs.withColumn("k", F.lit(k)).withColumn("key", _key("w", F.col("off"), k))
        shingles = part if shingles is None else shingles.unionByName(part)
    shingles = cut(shingles)
    counts = _exploded(d, sizes).select("k", "key").join(put(shingles.select("k", "key").distinct()), ["k", "key"]).groupBy("k", "key").agg(F.count("*").alias("df"))
    ranked = shingles.join(counts, ["k", "key"], "left").groupBy("win", "w", "len", "ids", "k").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key", "off")).alias("r")
    )
    cand = F.struct(F.col("r.off").alias("off"), "len", "w", "ids")
    prefix = cut(ranked.filter(F.col("r.df") > 0).groupBy("k", F.col("r.key").alias("key")).agg(F.collect_list(cand).alias("cands")))
    if small:
        m = _exploded(d, sizes).join(put(prefix), ["k", "key"], "left")
    else:  # only places travel; the words come back for the candidates
        places = _exploded(d, sizes).select("row", "pos", "k", "key").filter(F.col("key").isNotNull()).join(prefix, ["k", "key"]).select("row", "pos", "cands")
        m = d.join(places, "row", "left")
    begin = lambda c: F.col("pos") - c["off"]
    inside = lambda c: (begin(c) >= 0) & (begin(c) + c["len"] <= F.col("n"))  # noqa: E731  positional and length bounds
    same = lambda c: F.slice(F.col("words"), F.greatest(begin(c), F.lit(0)) + 1, c["len"]) == c["w"]
    occ = F.transform(F.filter("cands", lambda c: F.when(inside(c), same(c)).otherwise(False)), lambda c: F.struct(begin(c).alias("start"), c["len"].alias("length"), c["ids"].alias("ids")))
    first = F.coalesce(F.col("pos") == 0, F.lit(True))
    found = m.filter(F.col("cands").isNotNull() | first).select("row", "doc_id", "n", occ.alias("occ"))
    got = F.flatten(F.collect_list("occ"))
    return (
        found.groupBy("row", "doc_id", "n").agg(got.alias("occ"))
        .select(
            "row", "doc_id", F.col("n").cast("long").alias("n_words"),
            F.array_sort(F.array_distinct(F.transform("occ", lambda o: F.struct(o["start"].alias("start"), o["length"].alias("length"))))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.transform("occ", lambda o: o["ids"])))).alias("item_ids"),
        )
    )


def covered(spans: str = "spans") -> Column:
    """How many places sorted spans cover together."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["end"], s["start"] + s["length"]).alias("end"),
        (acc["total"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(acc["end"], s["start"]))).cast("long").alias("total"),
    )
    return F.aggregate(spans, zero, step, lambda acc: acc["total"])
