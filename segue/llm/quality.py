"""Quality rules and boosted trees over document statistics.

The base rules are exact counts of a whole text. Texts that pass them are kept if boosted trees,
fitted on at most `sample` labelled rows (a documented bound), hold good quality likelier than
not. Symbols, repeated lines, repeated words and exclamation marks may only lower the score.

Defined results: null text is empty and fails the base rules; null labels and labels without a
document are ignored, several labels are several examples; without labels of both classes the
trees are a constant (the smoothed rate); repeated rows are judged alike; other columns pass
through, result columns of clashing names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import gbt
from ._common import bounded_batches, bounded_sample, sample_key

SAMPLE = 16_000
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATS = ["log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "bang_rate", "bar_rate", "upper_rate", "digit_rate", "line_words", "end_rate", "distinct_rate"]
#: 1: the score may only rise with it, -1: only fall.
MONOTONE = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "bang_rate": -1}


def measure(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the statistics of a whole text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # ASCII white space only
    n = len(words)
    space = sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    word_chars = len(text) - space
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    first: dict[tuple, int] = {}
    mark = bytearray(n)
    for i, t in enumerate(zip(words, words[1:], words[2:])):
        j = first.setdefault(t, i)
        if j != i:
            mark[i : i + 3] = mark[j : j + 3] = b"\1\1\1"
    repeat = mark.count(1)
    b = np.frombuffer(raw, np.uint8)
    upper, lower = int(((b >= 65) & (b <= 90)).sum()), int(((b >= 97) & (b <= 122)).sum())
    digits = int(((b >= 48) & (b <= 57)).sum())
    m, c = max(1, n), max(1, len(text))
    ends = raw.count(b".") + raw.count(b"?")
    stats = [
        np.log1p(n), word_chars / m, symbols / m, dup / max(1, lines), repeat / m, text.count("!") / m, text.count("|") / m,
        upper / max(1, upper + lower), digits / c, n / max(1, lines), ends / m, len(set(words)) / m,
    ]
    return [n, word_chars, symbols, dup, repeat], stats


def base_failed(counts: list[int]) -> bool:
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> gbt.Trees:
    """From documents (doc_id, text) and labels (doc_id, quality); ids of any type that casts to text."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = bounded_sample(known, "doc_id", sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")  # at most `sample` short rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [measure(t)[1] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], ["k", "y", "x"])

    made = texts.select(sample_key("doc_id").alias("k"), "text", "y").mapInArrow(run, "k long, y int, x array<double>")
    rows = made.orderBy("k", "y", "x").limit(sample).collect()  # ids may repeat in documents: at most `sample` rows of a few numbers
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(STATS))
    return gbt.fit(x, np.array([r["y"] for r in rows], float), {STATS.index(k): v for k, v in MONOTONE.items()})


def judge(docs: DataFrame, trees: gbt.Trees, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """`docs` with the base counts, base_failed, quality_score (double) and kept."""
    bounded_batches(docs.sparkSession)
    new = [*COUNTS, "base_failed", "quality_score", "kept"]
    docs = docs.drop(*new)
    names = docs.columns
    at = names.index(text_col)
    kinds = [*[T.LongType()] * 5, T.BooleanType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(new, kinds)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [measure(t) for t in b.column(at).to_pylist()]
            counts = np.array([f[0] for f in found], np.int64).reshape(-1, 5)
            failed = np.array([base_failed(f[0]) for f in found], bool)
            score = trees.probability(np.array([f[1] for f in found], float).reshape(-1, len(STATS)))
            extra = [*[pa.array(counts[:, k]) for k in range(5)], pa.array(failed), pa.array(score, pa.float64()), pa.array(~failed & (score >= threshold))]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*names, *new])

    return docs.mapInArrow(run, schema)
