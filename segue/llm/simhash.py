"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints have 64 bits, and link at `tau` or fewer differing bits. The bits are dealt into
m partitions, correlated bits together. If the thresholds t_1..t_m of the partitions add up to
tau - m + 1, any linked pair differs in at most t_i bits of some partition i (a threshold of -1
leaves its partition out). Thresholds are allocated by dynamic programming on the estimated
number of candidates of each (partition, threshold); m is the count of partitions for which the
estimate is least. Each distinct fingerprint is put into an index under its value in each
partition and probes the index with all values within the partition's threshold; the candidates
of an index value are verified on all 64 bits.

Exact copies are one fingerprint before any of this. An index value that holds more than `BLOCK`
fingerprints is looked up by further bits too: a linked pair differs in at most `tau` of the bits outside
the partition, so of tau + 1 groups of those one is equal. What still is hot then (fingerprints that are
close to each other indeed) is dealt into blocks, which are probed by separate tasks. A block reports a
spanning forest of its links instead of the links, so groups of any size give few edges; components are
those of all links.

A stricter second look is optional: `wide_tau` also asks that of 256 bits (the 64 and three more words
made of the same shingle hashes) at most so many differ. That estimates the shingle similarity closely
enough to tell near-copies from chance at any size of corpus, so `tau` may then be large.

Defined results: text without words has fingerprint zero, linked like any other; null text
counts as empty; repeated rows and null ids are rows of their group (a component's id is the
smallest id that is not null, if any); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bounded_batches, cut, spread_join
from .components import connected_components

BITS = 64
#: Index fingerprints that one task compares with a stream of probes.
BLOCK = 2048
#: Shingle hashes that are counted at a time.
STEP = 1 << 14
#: Cost of making and moving a probe, in verified candidates (microseconds against nanoseconds).
PROBE_COST = 500.0
#: Counts of partitions that are considered.
PARTITIONS = (2, 3, 4, 5, 6, 7, 8)
#: Words of a wide fingerprint after the first.
WIDE = ["fp1", "fp2", "fp3"]


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Independent 64-bit words of hashes, for k = 1, 2, 3 (a finaliser of splitmix64 with another start each)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def wide_fingerprint(text: bytes | None, width: int = 4) -> list[int]:
    """The fingerprint and its three further words."""
    return _words(text, width, 1 + len(WIDE))


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """The SimHash of a text's word shingles, A-Z lower-cased (bytes.lower and bytes.split know ASCII only)."""
    return _words(text, width, 1)[0]


def _words(text: bytes | None, width: int, n_words: int) -> list[int]:
    words = (text or b"").lower().split()
    if not words:
        return [0] * n_words
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    begin = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stop = (ends[-n:] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros((n_words, BITS), np.int64)
    for at in range(0, n, STEP):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(begin[at : at + STEP], stop[at : at + STEP])], np.uint64)
        for k in range(n_words):
            own = (mixed(h, k) if k else h).astype(">u8")
            ones[k] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return [int.from_bytes(np.packbits(2 * o > n).tobytes(), "big") for o in ones]


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), STEP):
        ones += np.unpackbits(h[at : at + STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", width: int = 4, wide: bool = False) -> DataFrame:
    """`docs` with the fingerprint of each whole text as a (signed) long fp, and fp1, fp2, fp3 if wide, in place of the text's column."""
    bounded_batches(docs.sparkSession)
    made = ["fp", *(WIDE if wide else [])]
    kept = [c for c in docs.columns if c not in (text_col, *made)]
    d = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([_words(t.as_py(), width, len(made)) for t in b.column(len(kept))], np.uint64).reshape(-1, len(made)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *[pa.array(fp[:, k], pa.int64()) for k in range(len(made))]], [*kept, *made])

    return d.mapInArrow(run, T.StructType([*d.schema.fields[:-1], *[T.StructField(m, T.LongType()) for m in made]]))


# ---- partitions and thresholds


def bit_sums(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each pair of bits how many have both (64 x 64; its diagonal counts single bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            bits = np.unpackbits(b.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1), pa.int32()), pa.array(np.append(both.ravel(), n))], ["k", "v"])

    got = fps.select("fp").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # 4097 numbers
    v = np.zeros(BITS * BITS + 1)
    for r in got:
        v[r["k"]] = r["v"]
    return int(v[-1]), v[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of nearly equal size; a group grows by the free bit that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        at = sorted(free)
        group = [at[int(np.argmax(corr[np.ix_(at, at)].sum(axis=1)))]]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: corr[b, group].mean())
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def mask_of(bits: list[int]) -> int:
    """Bit 0 is the highest."""
    return sum(1 << (BITS - 1 - b) for b in bits)


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def estimate(n: int, both: np.ndarray, bits: list[int], equal_pairs: float, most: int) -> list[float]:
    """Estimated cost of the thresholds -1, 0, .., most of one partition: verified candidates and probes.

    Pairs that are equal in the partition are counted; the share that differs in k bits is that of
    independent bits with the partition's frequencies.
    """
    n = max(n, 1)  # an empty table has costs too: they keep the thresholds low
    p = np.clip(np.diag(both)[bits] / n, 0, 1)
    differ = np.array([1.0])
    for q in 2 * p * (1 - p):
        differ = np.append(differ * (1 - q), 0) + np.append(0, differ * q)
    out, pairs, probes = [0.0], 0.0, 0.0
    for t in range(most + 1):
        pairs += 2 * equal_pairs + n if t == 0 else n * n * differ[t] if t < len(differ) else 0
        probes += n * comb(len(bits), t)
        out.append(pairs + PROBE_COST * probes)
    return out


def allocate(costs: list[list[float]], tau: int) -> tuple[float, list[int]]:
    """Thresholds (-1 or more) that add up to tau - m + 1 at the least total cost; costs[i][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for total, (c, ts) in best.items():
            for t1, more in enumerate(own):
                new = (c + more, [*ts, t1 - 1])
                if total + t1 - 1 not in after or new < after[total + t1 - 1]:
                    after[total + t1 - 1] = new
        best = after
    return best[tau - len(costs) + 1]


def plan(fps: DataFrame, tau: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions in use, for distinct fingerprints `fps` (fp)."""
    n, both = bit_sums(fps)
    choices = {m: group_bits(n, both, m) for m in PARTITIONS if m <= tau + 2}
    masks = [(m, i, signed(mask_of(bits))) for m, groups in choices.items() for i, bits in enumerate(groups)]
    keys = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(x)).alias("value")) for m, i, x in masks]))
    sizes = fps.select(keys.alias("k")).groupBy("k.m", "k.i", "k.value").agg(F.count("*").alias("c"))
    equal = {(r["m"], r["i"]): r["p"] for r in sizes.groupBy("m", "i").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("p")).collect()}  # 14 numbers
    found = []
    for m, groups in choices.items():
        costs = [estimate(n, both, bits, equal.get((m, i), 0.0), tau) for i, bits in enumerate(groups)]
        cost, ts = allocate(costs, tau)
        found.append((cost, m, ts))
    _, m, ts = min(found)
    return [(bits, t) for bits, t in zip(choices[m], ts) if t >= 0]


# ---- probing


def forest(a: np.ndarray, b: np.ndarray, tau: int, wide_tau: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the links between a and b: rows of node, fingerprint and further words."""
    left, right = np.nonzero(np.bitwise_count(a[:, 1][:, None] ^ b[:, 1][None, :]) <= tau)
    if wide_tau is not None:
        apart = np.bitwise_count(a[left, 1:] ^ b[right, 1:]).sum(axis=1, dtype=np.int64)
        left, right = left[apart <= wide_tau], right[apart <= wide_tau]
    nodes, at = np.unique(np.concatenate((a[left, 0], b[right, 0])).view(np.int64), return_inverse=True)
    u, v = at[: len(left)], at[len(left) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        was = root.copy()
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        np.minimum.at(root, was[u], low)  # hook whole trees, not only the two ends
        np.minimum.at(root, was[v], low)
        root = root[root]
        if (root == was).all():
            break
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _links(tau: int, wide_tau: int | None, n_words: int):
    """Rows sorted by (key, block, side): the index side of a block, then its probes in any number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, index = None, np.empty((0, 1 + n_words), np.uint64)
        for b in batches:
            key, block, side = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            rows = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(3, 4 + n_words)], axis=1).view(np.uint64)
            new = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            edges = [0, *new.tolist(), len(key)]
            got_u, got_v = [], []
            for a, z in zip(edges, edges[1:]):
                if a == z:
                    continue
                here = a + int(np.searchsorted(side[a:z], 1))
                if (key[a], block[a]) != own:
                    own, index = (key[a], block[a]), rows[a:here]
                elif here > a:
                    index = np.concatenate((index, rows[a:here]))
                if len(index) and here < z:
                    for at in range(here, z, BLOCK):
                        u, v = forest(index, rows[at : min(z, at + BLOCK)], tau, wide_tau)
                        got_u.append(u)
                        got_v.append(v)
            if got_u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got_u), pa.int64()), pa.array(np.concatenate(got_v), pa.int64())], ["u", "v"])

    return run


def further_masks(bits: list[int], tau: int) -> list[int]:
    """Masks of tau + 1 groups of the bits outside a partition."""
    rest = [b for b in range(BITS) if b not in bits]
    return [signed(mask_of(rest[k :: tau + 1])) for k in range(tau + 1)]


def link(nodes: DataFrame, tau: int = 4, wide_tau: int | None = None) -> DataFrame:
    """Edges (u, v) whose components are those of all linked pairs of nodes (node: a distinct long, fp, and fp1, fp2, fp3 if wide)."""
    bounded_batches(nodes.sparkSession)
    carried = ["node", "fp", *(WIDE if wide_tau is not None else [])]
    nodes = nodes.select(*carried)
    parts = plan(nodes.select("fp").distinct() if wide_tau is not None else nodes.select("fp"), tau)
    value = lambda i: F.col("fp").bitwiseAND(F.lit(signed(mask_of(parts[i][0]))))
    index = nodes.select(*carried, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), value(i).alias("value")) for i in range(len(parts))])).alias("k")).select(*carried, "k.i", "k.value")
    probes = None
    for i, (bits, t) in enumerate(parts):
        flips = [signed(mask_of(list(c))) for k in range(t + 1) for c in combinations(bits, k)]
        one = nodes.select(*carried, F.lit(i).alias("i"), F.explode(F.transform(F.lit(flips), lambda x: x.bitwiseXOR(value(i)))).alias("value"))
        probes = one if probes is None else probes.unionByName(one)
    hot = cut(index.groupBy("i", "value").agg(F.count("*").alias("c")).filter(F.col("c") > BLOCK).select("i", "value", F.lit(True).alias("hot")))
    any_hot = not hot.isEmpty()
    plain = F.xxhash64("i", "value")
    masks = F.get(F.array(*[F.array(*[F.lit(m) for m in further_masks(bits, tau)]) for bits, _ in parts]), F.col("i"))

    def keyed(d: DataFrame) -> DataFrame:
        if not any_hot:
            return d.select(*carried, plain.alias("key"))
        further = F.transform(masks, lambda m, j: F.xxhash64(plain, j, F.col("fp").bitwiseAND(m)))
        return d.join(hot, ["i", "value"], "left").select(*carried, F.explode(F.when(F.col("hot"), further).otherwise(F.array(plain))).alias("key"))

    placed, sent = keyed(index), keyed(probes)
    # Keys that still have many fingerprints are dealt into blocks; each probe goes to all blocks of its key.
    still = cut(placed.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > BLOCK).select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))) if any_hot else None
    dealt = any_hot and not still.isEmpty()
    spread = lambda d: d.join(still, "key", "left") if dealt else d.withColumn("blocks", F.lit(None).cast("int"))
    block = F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks"))).cast("int")
    everywhere = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = spread(placed).select("key", block.alias("block"), F.lit(0).alias("side"), *carried)
    rows = rows.unionByName(spread(sent).select("key", everywhere.alias("block"), F.lit(1).alias("side"), *carried))
    order = ["key", "block"]
    return rows.repartition(*order).sortWithinPartitions(*order, "side").mapInArrow(_links(tau, wide_tau, len(carried) - 1), "u long, v long")


def components(ids: DataFrame, tau: int = 4, wide_tau: int | None = None) -> DataFrame:
    """node, root (the component's smallest node), component_id for each distinct fingerprint of ids (doc_id, node, fp, ..)."""
    distinct = cut(ids.groupBy(*[c for c in ids.columns if c != "doc_id"]).agg(F.min("doc_id").alias("least")))
    roots = connected_components(link(distinct, tau, wide_tau))
    of = cut(distinct.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    ids_of = of.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("c"))
    return spread_join(of, ids_of.select("root", "component_id"), "root", ids_of.select("root", "c"), of.count(), "node").select("node", "root", "component_id")


def _with_node(fps: DataFrame) -> DataFrame:
    """A long for each distinct fingerprint: itself, or a hash of the wide one's words."""
    return fps.withColumn("node", F.xxhash64("fp", *WIDE) if "fp1" in fps.columns else F.col("fp"))


def near_duplicates(docs: DataFrame, tau: int = 4, width: int = 4, wide_tau: int | None = None) -> DataFrame:
    """doc_id, fp, node, root, component_id for each row of docs (doc_id, text)."""
    ids = cut(_with_node(fingerprints(docs.select("doc_id", "text"), width=width, wide=wide_tau is not None)))
    sizes = ids.groupBy("node").agg(F.count("*").alias("c"))
    own = ids.select("doc_id", "fp", "node")
    return spread_join(own, components(ids, tau, wide_tau), "node", sizes, ids.count(), "doc_id").select("doc_id", "fp", "node", "root", "component_id")


def keep_one(docs: DataFrame, tau: int = 4, width: int = 4, wide_tau: int | None = None) -> DataFrame:
    """The rows of docs of which each group of near-duplicates keeps one: one row with the group's smallest id."""
    names = docs.columns
    # The row's own hash stands for it, so that fingerprints are made once; its text travels in the second look only.
    key = lambda i, t: F.concat_ws(":", F.coalesce(F.col(i).cast("string"), F.lit("null")), F.sha2(F.coalesce(F.col(t), F.lit("")), 256))
    ids = cut(_with_node(fingerprints(docs.select("doc_id", "text", key("doc_id", "text").alias("__key")), width=width, wide=wide_tau is not None)))
    groups = components(ids.drop("__key"), tau, wide_tau).select("node", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key"))
    least = ids.groupBy("node").agg(first.alias("k"))
    keys = least.join(groups, "node").groupBy("root").agg(F.min("k").alias("k")).select(F.col("k.__key").alias("__key"))
    # The row travels as one value beside its key, so none of its columns can clash.
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), key("doc_id", "text").alias("__key"))
    rank = F.row_number().over(W.partitionBy("__key").orderBy(F.length("__row.text").desc_nulls_last(), "__row.text"))
    return row.join(keys, "__key", "left_semi").withColumn("__rank", rank).filter(F.col("__rank") == 1).select("__row.*")
