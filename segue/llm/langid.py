"""Language identification by averaged hashed subword embeddings and a linear softmax.

Character n-grams (1 to 4, of the lower-cased text with other than letters as spaces) are hashed
into buckets, each with an embedding; a text's vector is the mean over all its n-grams. Embeddings
and softmax are trained together by stochastic gradient descent in numpy, on at most `sample`
documents outside fold 0 (a documented bound); a fifth of them calibrates the temperature and the
score below which a prediction is marked as rejected. Since both layers are linear, prediction
adds up one precomputed row of class scores per n-gram.

Defined results: null text and text without a letter get `und` with score 0; rows with null lang
are not learnt from; without any learnt row all predictions are `und`; ties go to the first
language in order; repeated rows are predicted alike; other columns pass through (`lang_pred`,
`score` and `rejected` are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_batches, is_held_out, sample_key, training_fold

SAMPLE, BUCKETS, DIM, GRAMS = 4_000, 1 << 13, 16, (1, 2, 3, 4)
EPOCHS, BATCH, RATE = 10, 32, 0.05
#: Share of calibration rows whose score may fall below the rejection bound.
REJECTED_SHARE = 0.01
UND = "und"
#: Code points of a text that are hashed at a time.
STEP = 1 << 18


def buckets_of(text: str | None) -> Iterator[np.ndarray]:
    """The n-gram buckets of a whole text, in blocks; nothing if it has no letter."""
    text = (text or "").lower()
    if not any(map(str.isalpha, text)):
        return
    cp = np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    cp[(cp < 97) | ((cp > 122) & (cp < 0xAA))] = 32  # plain digits and punctuation
    for a in range(0, len(cp), STEP):
        part = cp[a : a + STEP + max(GRAMS) - 1]
        n_here = min(STEP, len(cp) - a)
        h = np.zeros(len(part), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            h = (h[: len(part) - n + 1] * np.uint32(0x01000193)) ^ (part[n - 1 :] * np.uint32(0x9E3779B1))
            if n in GRAMS:
                got = h[:n_here] if len(h) > n_here else h
                yield ((got ^ (got >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)) >> np.uint32(32 - 13)


class Model:
    def __init__(self, langs: list[str], rows: np.ndarray, bias: np.ndarray, heat: float, reject: float):
        self.langs, self.rows, self.bias, self.heat, self.reject = langs, rows.astype(np.float32), bias, heat, reject

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [], np.zeros(len(texts))
        for k, t in enumerate(texts):
            total, n = np.zeros(len(self.langs)), 0
            for ids in buckets_of(t):
                total += self.rows[ids].sum(axis=0, dtype=np.float64)
                n += len(ids)
            if not n or not self.langs:
                langs.append(UND)
                continue
            z = (total / n + self.bias) / self.heat
            p = np.exp(z - z.max())
            p /= p.sum()
            best = int(np.argmax(p))
            langs.append(self.langs[best])
            scores[k] = p[best]
        return langs, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, classes: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Class scores of each bucket, and biases, from bags of n-grams x (rows sum to 1) and classes y."""
    r = np.random.default_rng(seed)
    scale = np.float32(8)  # means of many embeddings are small
    params = [r.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32), r.normal(0, 1 / DIM, (DIM, classes)).astype(np.float32), np.zeros(classes, np.float32)]
    squares = [np.full_like(p, 1e-8) for p in params]  # each parameter's step shrinks with the gradients it has had
    step, steps = 0, EPOCHS * max(1, len(x) // BATCH)
    for _ in range(EPOCHS):
        for at in np.array_split(r.permutation(len(x)), max(1, len(x) // BATCH)):
            rate = RATE * (1 - step / steps)
            step += 1
            e, w, bias = params
            v = scale * (x[at] @ e)
            d = softmax(v @ w + bias)
            d[np.arange(len(at)), y[at]] -= 1
            d /= len(at)
            for p, q, g in zip(params, squares, (scale * (x[at].T @ (d @ w.T)), v.T @ d, d.sum(axis=0))):
                q += g * g
                p -= rate * g / np.sqrt(q)
    e, w, bias = params
    return scale * (e @ w), bias


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """From documents (doc_id, text, lang) outside fold 0 with a lang."""
    bounded_batches(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & ~is_held_out()).select(sample_key("doc_id").alias("k"), "text", F.col("lang").cast("string").alias("lang"))
    n = known.count()
    if n > sample:  # texts are long: a first look by hash keeps somewhat more than the bound, and bags are cut to it
        known = known.filter(F.pmod("k", F.lit(1 << 30)) < int(min(1.0, 1.2 * sample / n + 200 / n) * (1 << 30)))
    known = known.select("k", training_fold(F.col("k")).alias("fold"), "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at, count = [], [], []
            for row, t in enumerate(b.column(3).to_pylist()):
                bag = np.zeros(BUCKETS, np.int64)
                for got in buckets_of(t):
                    bag += np.bincount(got, minlength=BUCKETS)
                if bag.any():
                    k = np.flatnonzero(bag)
                    rows.append(row), at.append(k.astype(np.int16)), count.append((bag[k] / bag.sum()).astype(np.float32))
            took = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(took) for c in range(3)], pa.array(at, pa.list_(pa.int16())), pa.array(count, pa.list_(pa.float32()))], ["k", "fold", "lang", "at", "share"])

    made = known.mapInArrow(run, "k long, fold int, lang string, at array<smallint>, share array<float>")
    got = made.orderBy(F.pmod("k", F.lit(1 << 30)), "k", "lang", "at", "share").limit(sample).toArrow()  # at most `sample` bags of at most BUCKETS entries
    if not len(got):
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    names = got.column("lang").to_pylist()
    langs = sorted(set(names))
    y = np.array([langs.index(v) for v in names])
    x = np.zeros((len(names), BUCKETS), np.float32)
    at, share = got.column("at").combine_chunks(), got.column("share").combine_chunks()
    offs, at_v, share_v = at.offsets.to_numpy(), at.flatten().to_numpy(), share.flatten().to_numpy()
    for row in range(len(names)):
        a, z = offs[row] - offs[0], offs[row + 1] - offs[0]
        x[row, at_v[a:z]] = share_v[a:z]
    apart = np.array(got.column("fold").to_pylist()) == 0
    if apart.all() or not apart.any():
        apart[:] = False
    rows, bias = fit(x[~apart], y[~apart], len(langs))
    heat, reject = 1.0, 0.0
    if apart.any():
        z = x[apart] @ rows + bias
        heats = np.geomspace(0.05, 20, 60)
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(z)), y[apart]], 1e-12)).mean() for t in heats]
        heat = float(heats[int(np.argmin(loss))])
        p = softmax(z / heat)
        right = p.argmax(axis=1) == y[apart]
        reject = float(np.quantile(p.max(axis=1)[right], REJECTED_SHARE)) if right.any() else 0.0
    return Model(langs, rows, bias, heat, reject)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred, score (calibrated probability) and rejected."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "rejected")
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = model.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(scores < model.reject)], [*names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))
