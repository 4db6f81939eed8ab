"""Matrix products of many queries with a whole catalogue, dealt into cells.

A cell is a block of queries and a block of the catalogue, of bounded size both; it keeps the best k of its
tracks for each query. So no task holds all queries or all tracks, and any number of either can be asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries and tracks of a cell, and the queries whose scores it makes at a time.
QUERIES, TRACKS, STEP = 4096, 1 << 16, 256


def matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _cells(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows (qb, vb, side, case_id, track, x) of queries (case_id, q) and vectors (track, vector)."""
    nq, nt = queries.count(), vectors.count()
    v_blocks = max(1, -(-nt // TRACKS))
    q_blocks = max(1, -(-nq // QUERIES), min(nq, -(-queries.sparkSession.sparkContext.defaultParallelism // v_blocks)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    case_t, track_t = queries.schema["case_id"].dataType, vectors.schema["track"].dataType
    floats = lambda c: F.transform(c, lambda x: x.cast("double"))
    q = queries.select(block("case_id", q_blocks).alias("qb"), every(v_blocks).alias("vb"), F.lit(0).alias("side"), "case_id", F.lit(None).cast(track_t).alias("track"), floats("q").alias("x"))
    v = vectors.select(every(q_blocks).alias("qb"), block("track", v_blocks).alias("vb"), F.lit(1).alias("side"), F.lit(None).cast(case_t).alias("case_id"), "track", floats("vector").alias("x"))
    return q.unionByName(v).repartition(q_blocks * v_blocks, "qb", "vb").sortWithinPartitions("qb", "vb", "side", "case_id", "track")


class _Cell:
    """The queries of one cell and, for each, its best k tracks so far and the bounds of all its scores."""

    def __init__(self, k: int):
        self.k, self.ids, self.rows, self.q, self.tracks = k, [], [], None, []
        self.n = 0

    def add_queries(self, ids: pa.Array, x: pa.Array) -> None:
        self.ids.append(ids)
        self.rows.append(matrix(x))

    def add_tracks(self, tracks: pa.Array, x: pa.Array, cosine: bool) -> None:
        if self.q is None:
            self.q = np.vstack(self.rows) if self.rows else np.zeros((0, 0))
            self.q = unit(self.q) if cosine and len(self.q) else self.q
            self.best = np.zeros((len(self.q), 0))
            self.at = np.zeros((len(self.q), 0), np.int64)
            self.low, self.high = np.full(len(self.q), np.inf), np.full(len(self.q), -np.inf)
        if not len(self.q):
            return
        v = matrix(x)
        v = unit(v) if cosine else v
        self.tracks.append(tracks)
        best, at = [], []
        for a in range(0, len(self.q), STEP):
            s = self.q[a : a + STEP] @ v.T
            self.low[a : a + STEP] = np.minimum(self.low[a : a + STEP], s.min(axis=1))
            self.high[a : a + STEP] = np.maximum(self.high[a : a + STEP], s.max(axis=1))
            s = np.hstack([self.best[a : a + STEP], s])
            where = np.hstack([self.at[a : a + STEP], np.broadcast_to(np.arange(self.n, self.n + len(v)), (len(s), len(v)))])
            if s.shape[1] > self.k:
                top = np.argpartition(-s, self.k - 1, axis=1)[:, : self.k]
                s, where = np.take_along_axis(s, top, 1), np.take_along_axis(where, top, 1)
            best.append(s)
            at.append(where)
        self.best, self.at = np.vstack(best), np.vstack(at)
        self.n += len(v)


def _run(queries: DataFrame, vectors: DataFrame, k: int, cosine: bool, schema: str, out) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cell = None, _Cell(k)
        for b in batches:
            qb, vb, side = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(qb):
                continue
            new = np.flatnonzero((qb[1:] != qb[:-1]) | (vb[1:] != vb[:-1]) | (side[1:] != side[:-1])) + 1
            for a, z in zip([0, *new.tolist()], [*new.tolist(), len(qb)]):
                if own != (qb[a], vb[a]):
                    yield from out(cell)
                    own, cell = (qb[a], vb[a]), _Cell(k)
                x = b.column(5).slice(a, z - a)
                if side[a] == 0:
                    cell.add_queries(b.column(3).slice(a, z - a), x)
                else:
                    cell.add_tracks(b.column(4).slice(a, z - a), x, cosine)
        yield from out(cell)

    return _cells(queries, vectors).mapInArrow(run, schema)


def _name(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def dense_top(queries: DataFrame, vectors: DataFrame, k: int, cosine: bool = False) -> DataFrame:
    """case_id, track, score: the k best tracks of each query (case_id, q), by the product with their vectors (track, vector)."""

    def out(cell: _Cell) -> Iterator[pa.RecordBatch]:
        if cell.n and len(cell.q):
            ids, tracks = pa.concat_arrays(cell.ids), pa.concat_arrays(cell.tracks)
            width = cell.at.shape[1]
            for a in range(0, len(cell.q), STEP):
                z = min(len(cell.q), a + STEP)
                who = pa.array(np.repeat(np.arange(a, z), width))
                yield pa.RecordBatch.from_arrays([ids.take(who), tracks.take(pa.array(cell.at[a:z].ravel())), pa.array(np.round(cell.best[a:z].ravel(), 9))], ["case_id", "track", "score"])

    local = _run(queries, vectors, k, cosine, f"case_id {_name(queries, 'case_id')}, track {_name(vectors, 'track')}, score double", out)
    w = W.partitionBy("case_id").orderBy(F.desc("score"), "track")
    return local.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("case_id", "track", F.round("score", 9).alias("score"))


def dense_bounds(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """case_id, low, high: the bounds of each query's products with all vectors."""

    def out(cell: _Cell) -> Iterator[pa.RecordBatch]:
        if cell.n and len(cell.q):
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(cell.ids), pa.array(cell.low), pa.array(cell.high)], ["case_id", "low", "high"])

    local = _run(queries, vectors, 1, False, f"case_id {_name(queries, 'case_id')}, low double, high double", out)
    return local.groupBy("case_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
