"""Toxicity by boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is mined from labelled training texts by smoothed
log-odds, beside a short fixed one. Features of a whole text: lexicon densities, hits near
second-person words, capitals, punctuation and obfuscation rates. The trees are fitted on at most
`sample` labelled rows outside fold 0 (a documented bound); a fifth of them calibrates the score.

Defined results: null and empty texts have the features of the empty text; labels that are null
or belong to no document are ignored, several labels of a row are several examples; with no
labels, or labels of one class, the score is the smoothed rate of toxic rows; repeated rows score
alike; other columns pass through (`held_out`, `score`, `predicted` are replaced).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import gbt
from ._common import bounded_batches, bounded_sample, is_held_out, sample_key, training_fold

#: Labelled rows used for training, mined lexicon entries, least toxic texts and odds of an entry.
SAMPLE, ENTRIES, LEAST_TEXTS, LEAST_ODDS = 16_000, 600, 6, 8.0
#: Lengths of the word beginnings that may become lexicon entries.
BEGINNINGS = (4, 5, 6)
#: Plain insults, second-person words, and what digits and symbols stand for in disguised words.
INSULTS = ["idiot", "moron", "stupid", "trash", "scum", "loser", "clown", "pathetic", "worthless", "disgusting", "dumb", "garbage", "imbecile", "jerk"]
SECOND_PERSON = {"you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "tú", "ti", "tus", "usted", "vosotros"}
DISGUISES = [str.maketrans("013457@$!|", "oieastasil"), str.maketrans("013457@$!|", "oleastasil")]
NEAR = 5
WORD = re.compile(r"[^\W_]+")
# Possessive runs from the start of a token, and single letters that either go on or end: linear in texts of any kind.
MIXED = re.compile(r"(?<![\w@$!|*])[0-9@$!|*]*+[^\W\d_]++[0-9@$!|*]++[^\W\d_][\w@$!|*]*+")
SPELT = re.compile(r"(?<![^\W_])[^\W\d_](?:[.\-*_ ][^\W\d_](?![^\W_])){3,}+")
FEATURES = ["hits", "hit_rate", "top_weight", "weight_rate", "weight_sum", "near_you", "you_rate", "upper_rate", "shout_rate", "mark_rate", "punct_rate", "mixed_rate", "disguised_hits"]


class Lexicon:
    """words: weight of whole words; heads: weight of word beginnings."""

    def __init__(self, words: dict[str, float], heads: dict[str, float]):
        self.words, self.heads = words, heads
        self.first = {w[:3] for w in words} | {h[:3] for h in heads}

    def weight(self, w: str) -> float:
        if w[:3] not in self.first:
            return 0.0
        best = self.words.get(w, 0.0)
        for k in BEGINNINGS:
            best = max(best, self.heads.get(w[:k], 0.0))
        return best


def features(text: str | None, lex: Lexicon) -> list[float]:
    text = text or ""
    low = text.lower()
    words = WORD.findall(low)
    n, first, weight = max(1, len(words)), lex.first, lex.weight
    at = [i for i, w in enumerate(words) if w[:3] in first]
    hits = [(i, x) for i in at if (x := weight(words[i])) > 0]
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    places, hit_at = np.array(you, int), np.array([i for i, _ in hits], int)
    near = int((np.searchsorted(places, hit_at + NEAR, side="right") > np.searchsorted(places, hit_at - NEAR)).sum())
    mixed = MIXED.findall(low)
    disguised = sum(1 for w in mixed if any(weight(w.translate(d).replace("*", "")) > 0 for d in DISGUISES))
    disguised += sum(1 for w in SPELT.findall(low) if weight(re.sub(r"[.\-*_ ]", "", w)) > 0)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = max(1, len(cp))
    upper = int(((cp >= 65) & (cp <= 90)).sum())
    letters = int((((cp | 32) >= 97) & ((cp | 32) <= 122)).sum())
    marks = text.count("!") + text.count("?")
    punct = int((((cp >= 33) & (cp <= 47)) | ((cp >= 58) & (cp <= 64))).sum())
    total = sum(x for _, x in hits)
    return [
        len(hits), len(hits) / n, max((x for _, x in hits), default=0.0), total / n, total, near, len(you) / n,
        upper / max(1, letters), float(upper > 0.6 * max(1, letters)), marks / n, punct / size, len(mixed) / n, disguised,
    ]


def mine(texts: DataFrame, entries: int = ENTRIES) -> Lexicon:
    """The lexicon of texts (text, y): entries are far more often in texts with y = 1. Counts are made by Spark; the driver gets `entries` rows."""
    own = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"))
    n = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    words = texts.select("y", F.explode(own).alias("w")).filter(F.length("w") >= 3).groupBy("w").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    heads = F.explode(F.array(*[F.when(F.length("w") > k, F.substring("w", 1, k)) for k in BEGINNINGS]))
    parts = words.select(heads.alias("w"), "bad", "good").filter(F.col("w").isNotNull()).groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    both = words.withColumn("head", F.lit(False)).unionByName(parts.withColumn("head", F.lit(True)))
    odds = ((F.col("bad") + 0.5) / (n.get(1, 0) + 1)) / ((F.col("good") + 0.5) / (n.get(0, 0) + 1))
    found = both.withColumn("odds", odds).filter((F.col("bad") >= LEAST_TEXTS) & (F.col("odds") >= LEAST_ODDS)).orderBy((F.ln("odds") * F.col("bad")).desc(), "head", "w").limit(entries).collect()
    known = {w: 4.0 for w in INSULTS}
    words_of = {r["w"]: float(np.log(r["odds"])) for r in found if not r["head"]}
    return Lexicon(known | words_of, {r["w"]: float(np.log(r["odds"])) for r in found if r["head"]})


class Model:
    def __init__(self, lex: Lexicon, trees: gbt.Trees, points):
        self.lex, self.trees, self.points = lex, trees, points

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t, self.lex) for t in texts], float).reshape(-1, len(FEATURES))
        raw = self.trees.probability(x)
        return np.clip(gbt.calibrated(self.points, raw), 0, 1)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From documents (doc_id, text) and labels (doc_id, toxic) outside fold 0; ids of any type that casts to text."""
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out())
    known = bounded_sample(known, "doc_id", sample)
    # At most `sample` short rows: small enough for each executor, by the bound.
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")
    lex = mine(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t, lex) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(x, pa.list_(pa.float64()))], ["k", "fold", "y", "x"])

    key = sample_key("doc_id")
    made = texts.select(key.alias("k"), training_fold(key).alias("fold"), "text", "y").mapInArrow(run, "k long, fold int, y int, x array<double>")
    rows = made.orderBy("k", "y", "x").limit(sample).collect()  # ids may repeat in documents: at most `sample` rows of a few numbers
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES))
    y = np.array([r["y"] for r in rows], float)
    apart = np.array([r["fold"] == 0 for r in rows], bool)
    rising = {FEATURES.index(f): 1 for f in ("hits", "hit_rate", "top_weight", "weight_rate", "weight_sum", "disguised_hits")}
    trees = gbt.fit(x[~apart], y[~apart], rising)
    points = gbt.isotonic(trees.probability(x[apart]), y[apart]) if apart.any() and y[apart].min() != y[apart].max() else (np.zeros(0), np.zeros(0))
    return Model(lex, trees, points)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with score (double, 0 to 1) of its whole texts and predicted (1 if 0.5 or more)."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
