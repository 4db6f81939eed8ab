"""Byte-level BPE by overlapping chunks, and decoding by concatenated bytes.

A short text is one chunk. A long text is dealt out as overlapping chunks, which are
pre-tokenised in parallel; neighbouring chunks are stitched at the first position of
their overlap where both have a boundary (from there on the scan of one is the scan of
the other, since the pattern looks at nothing before a boundary). Where an overlap has
no common boundary, the left chunk's scan goes on over the right one's text, so the
pieces are those of one scan over the whole text. Each piece is then encoded by the ranks.

Defined results: null text and empty text have no ids and decode to the empty string;
repeated rows are encoded once each; other columns pass through untouched; an empty table gives
an empty table.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_batches

#: Characters of a chunk, and of what it shares with the next one.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Pieces of up to so many bytes, and so many of them, are remembered by a worker.
CACHE_BYTES, CACHE_PIECES = 32, 100_000


@lru_cache(maxsize=1)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Ranks and pattern of one vocabulary; kept by a worker between batches."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})._core_bpe
        self.pieces: dict[str, list[int]] = {}

    def encode_pieces(self, pieces: list[str]) -> list[int]:
        known, out = self.pieces, []
        for p in pieces:
            ids = known.get(p)
            if ids is None:
                ids = self.core.encode_single_piece(p.encode())
                if len(p) <= CACHE_BYTES and len(known) < CACHE_PIECES:
                    known[p] = ids
            out += ids
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_pieces(self.pattern.findall(text or ""))

    def boundaries(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.pattern.finditer(text)]


@lru_cache(maxsize=1)
def tokens_of(path: str) -> list[bytes]:
    """The bytes of each id; all that decoding needs (it runs in workers of its own)."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f]
    out = [b""] * (1 + max(int(i) for _, i in rows))
    for token, i in rows:
        out[int(i)] = base64.b64decode(token)
    return out


def decode_ids(ids: list[int], tokens: list[bytes]) -> bytes:
    return b"".join([tokens[i] for i in ids])


@lru_cache(maxsize=1)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def stitch(spans: list[list[tuple[int, int]]], starts: list[int], overlap: int, text: str, pattern) -> list[tuple[int, int]]:
    """The spans of one scan over `text`, from the spans (relative to `starts`) of its chunks.

    A chunk's last span touches its cut end, so it counts only for the last chunk.
    """
    out = [(a + starts[0], b + starts[0]) for a, b in spans[0]]
    for k in range(1, len(spans)):
        if out:
            out.pop()  # may be cut short by the chunk's end
        own = [(a + starts[k], b + starts[k]) for a, b in spans[k]]
        at = [a for a, _ in own]
        left = {a for a, _ in out if a >= starts[k]}
        meet = next((a for a in at if a in left and a - starts[k] <= overlap), None)
        if meet is None:  # no common boundary: scan on from the last sure one until one is found
            here = out[-1][1] if out else 0
            ends = set(at)
            for m in pattern.finditer(text, here):
                if m.start() in ends:
                    meet = m.start()
                    break
                out.append(m.span())
            if meet is None:
                continue
        else:
            while out and out[-1][0] >= meet:
                out.pop()
        out += own[bisect_left(at, meet) :]
    return out


def encode_long(c: Codec, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The same steps within one process; for tests."""
    starts = list(range(0, max(1, len(text)), chunk))
    spans = [c.boundaries(text[s : s + chunk + overlap]) for s in starts]
    return c.encode_pieces([text[a:b] for a, b in stitch(spans, starts, overlap, text, c.pattern)])


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """`docs` with the ids of its whole texts in `ids_col` (array of int; a column of that name is replaced)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop(ids_col)
    names = [f.name for f in docs.schema.fields]
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    at = names.index(text_col)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            ids = pa.array([c.encode(t) for t in b.column(at).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*names, ids_col])

    size = F.coalesce(F.length(text_col), F.lit(0))
    short = docs.filter(size <= chunk + overlap).mapInArrow(whole, schema)
    # Long texts: chunks go to other tasks, the text itself only to the task that stitches it.
    # A text's hash is its key, so that equal texts are scanned once and lost tasks give the same keys again.
    long = docs.filter(size > chunk + overlap).withColumn("__row", F.sha2(F.col(f"`{text_col}`"), 256))
    pieces = long.select(
        "__row",
        F.explode(F.expr(f"transform(sequence(0, int((length(`{text_col}`) - 1) div {chunk})), k -> struct(k as k, substring(`{text_col}`, k * {chunk} + 1, {chunk + overlap}) as part))")).alias("c"),
    ).select("__row", "c.k", "c.part")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        kind = pa.list_(pa.int32())
        for b in batches:
            spans = [c.boundaries(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[a for a, _ in s] + [s[-1][1]] for s in spans], kind)], ["__row", "k", "cuts"])

    scanned = (
        pieces.dropDuplicates(["__row", "k"])
        .mapInArrow(scan, "__row string, k int, cuts array<int>")
        .groupBy("__row")
        .agg(F.sort_array(F.collect_list(F.struct("k", "cuts"))).alias("__chunks"))
    )
    long_schema = schema

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            found = []
            for text, chunks in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist()):
                spans = [list(zip(x["cuts"], x["cuts"][1:])) for x in chunks]
                pieces_of = stitch(spans, [x["k"] * chunk for x in chunks], overlap, text, c.pattern)
                found.append(c.encode_pieces([text[a:z] for a, z in pieces_of]))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(found, pa.list_(pa.int32()))], [*names, ids_col])

    stitched = long.join(scanned, "__row").select(*[F.col(f"`{n}`") for n in names], "__chunks").mapInArrow(finish, long_schema)
    return short.unionByName(stitched)


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`docs` with the bytes of its ids in `out_col` (binary; null ids: empty)."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(out_col)
    names = [f.name for f in docs.schema.fields]
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        for b in batches:
            got = pa.array([decode_ids(i or [], tokens) for i in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, got], [*names, out_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.BinaryType())]))
