"""Near-copies: SimHash candidates, completed by min-hash bands, verified by the exact similarity of their word shingles.

Two texts are linked if their sets of shingles have a Jaccard similarity of `similarity` or more; the
groups are the components of all links. Candidates are what the SimHash operator (simhash.py, by its
pigeonhole partitions) links at TAU differing bits. At a similarity of 0.8 the spread
of that distance is so wide that a bound that loses no pairs takes in a share of all pairs of the corpus,
and one that keeps them out loses pairs: so min-hash bands find the rest. Every node has BANDS keys of ROWS
min-hashes; a pair of similarity s shares no key with probability (1 - s ** ROWS) ** BANDS: 2.7e-5 at 0.8,
less above. Each candidate pair is compared shingle by shingle before it is linked.

Texts of equal shingles are one node. Only nodes that share a key (a SimHash star or a band) are read again
for their shingles, and keys with the same nodes are looked at once. Keys with more than BLOCK nodes are dealt
into blocks; each pair of blocks is a task's cell, which reports a spanning forest of its links.

Defined results: texts without words are one group; a text of fewer words than a shingle is one
shingle; null ids and repeated rows are rows of their group, which keeps one row, that of its smallest
id that is not null, if any; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import simhash
from ._common import bounded_batches, cut, spread_join
from .components import connected_components

BANDS, ROWS = 20, 4
#: Differing bits of SimHash candidates.
TAU = 6
#: Nodes of one key that are compared in one task.
BLOCK = 512
#: Shingles whose min-hashes are made at a time.
STEP = 2048

_r = np.random.default_rng(5)
_A = _r.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_B = _r.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The sorted hashes of a text's distinct word shingles, A-Z lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    begin = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stop = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(begin, stop)), np.uint64, n))


def node_of(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes()) >> 1 if len(h) else 0


def keys_of(h: np.ndarray) -> list[int]:
    """A key for each band; the first members of equal sets are equal."""
    least = np.full(BANDS * ROWS, ~np.uint64(0), np.uint64)
    for at in range(0, len(h), STEP):
        least = np.minimum(least, (h[at : at + STEP, None] * _A + _B).min(axis=0))
    return [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) >> 1 for k in range(BANDS)]


def links(nodes: list[int], sets: list[np.ndarray], left: int, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between the first `left` sets and the others, or of all links if left is 0."""
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for j in range(max(left, 1), len(nodes)):
        b = sets[j]
        for i in range(left or j):
            a = sets[i]
            if min(len(a), len(b)) < similarity * max(len(a), len(b)) or find(i) == find(j):
                continue
            both = np.concatenate((a, b))
            both.sort(kind="stable")
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            if common >= similarity * (len(a) + len(b) - common):
                root[find(j)] = find(i)
                out.append((nodes[i], nodes[j]))
    return out


def _row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Ids may be null or repeated, so a hash of the text is a part of the key."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.xxhash64(text).cast("string"))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row, node, fp (SimHash of the distinct shingles), keys for each row of docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    d = docs.select("doc_id", _row_key().alias("row"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(node_of(h), simhash.signed(simhash.majority(h)), keys_of(h)) for t in b.column(2) for h in (shingles(t.as_py(), width),)]
            cols = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "row", "node", "fp", "keys"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, row string, node long, fp long, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, shingles of the rows of docs that are in wanted (row)."""
    d = docs.select(_row_key().alias("row"), F.col("text").cast("binary").alias("text")).join(wanted, "row", "left_semi").dropDuplicates(["row"]).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py(), width) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(h) for h in found], pa.int64()), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], ["node", "shingles"])

    return d.mapInArrow(run, "node long, shingles array<long>")


def _cells(similarity: float):
    """Rows sorted by (key, p, q, b): the nodes of block p, then those of block q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, nodes, sets, left = None, [], [], 0

        def done() -> pa.RecordBatch:
            got = links(nodes, sets, left if cell[1] != cell[2] else 0, similarity) if cell and (cell[1] == cell[2] or 0 < left < len(nodes)) else []
            return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            key, p, q, b, node = (batch.column(k).to_pylist() for k in range(5))
            for k, h in enumerate(batch.column(5)):
                if (key[k], p[k], q[k]) != cell:
                    yield done()
                    cell, nodes, sets, left = (key[k], p[k], q[k]), [], [], 0
                nodes.append(node[k])
                sets.append(h.values.to_numpy().copy().view(np.uint64))
                left += b[k] == p[k]
        yield done()

    return run


def link(docs: DataFrame, nodes: DataFrame, width: int, similarity: float) -> DataFrame:
    """Edges (u, v) whose components are those of all linked pairs of nodes (node, row, fp, keys)."""
    # A SimHash edge leads to the centre of its star: the star is a key, without looking for components.
    star = cut(simhash.link(nodes.select(F.col("fp").alias("node"), "fp").distinct(), TAU).distinct())
    star = star.select(F.col("u").alias("fp"), "v").unionByName(star.select(F.col("v").alias("fp"), "v").distinct())
    by_bits = nodes.select("node", "fp").join(star, "fp").select("node", F.xxhash64(F.lit("simhash"), "v").alias("key"))
    bands = nodes.select("node", F.explode("keys").alias("key")).unionByName(by_bits)
    shared = bands.groupBy("key").agg(F.count("*").alias("c"), F.expr("bit_xor(xxhash64(node))").alias("who")).filter("c > 1")
    chosen = cut(shared.groupBy("c", "who").agg(F.min("key").alias("key")).select("key", "c", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")))
    n = chosen.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    members = cut(spread_join(bands, chosen.select("key", "blocks"), "key", chosen.select("key", "c"), n, "node"))
    wanted = members.select("node").distinct().join(nodes.select("node", "row"), "node").select("row")
    b = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = members.select("key", "node", b.alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"))
    cells = spread.select("key", F.least("b", "x").alias("p"), F.greatest("b", "x").alias("q"), "b", "node")
    order = ["key", "p", "q"]
    full = cells.join(_sets(docs, wanted, width), "node").select(*order, "b", "node", "shingles")
    return full.repartition(*order).sortWithinPartitions(*order, "b", "node").mapInArrow(_cells(similarity), "u long, v long")


def groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """node, root, first (none, doc_id, row: the node's row of the smallest id) for each distinct set of shingles."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    nodes = cut(sketches(docs.select("doc_id", "text"), width).groupBy("node").agg(first, F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    roots = connected_components(link(docs, nodes.select("node", "first.row", "fp", "keys"), width, similarity))
    return nodes.select("node", "first").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs of which each group of near-copies keeps one: one row with the group's smallest id."""
    names = docs.columns
    keys = groups(docs, width, similarity).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("__key"))
    # The row travels as one value beside its key, so none of its columns can clash.
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), _row_key().alias("__key"))
    rank = F.row_number().over(W.partitionBy("__key").orderBy("__row.text"))
    return row.join(keys, "__key", "left_semi").withColumn("__rank", rank).filter(F.col("__rank") == 1).select("__row.*")
