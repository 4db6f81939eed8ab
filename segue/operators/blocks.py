"""Item-to-item recommendations by blocks of the catalogue, fitted and answered in one pass.

A block is a range of tracks. It gets every list that has one of its tracks, and of each case the seeds that it has. It
makes the rows of the similarity of those seeds alone, a bounded number at a time, cuts them to their neighbours and sends
these to the cases: tracks, popularities and counts, from which a case makes the similarities again, so that a neighbour
takes few bytes. Pairs of tracks are never exchanged. What a case got is added up, ranked and filled with popular tracks. A
track that is in very many lists has its row made by a plain aggregate instead.

Lists may have tracks of all blocks. So they travel packed, many at a time, and a block keeps four bytes for a place; the
number of blocks follows from the places that blocks get if no two tracks of a list are in one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.tables import cut, remove_folder
from .ranking import popular_top

#: Tracks and their places that a block has on average, and places from which a track is no block's.
TRACKS, PLACES, HOT = 1 << 17, 1 << 22, 1 << 18
#: Places that a block gets at most on average, with all tracks of its lists.
ENTRIES = 1 << 25
#: Pairs that a block unfolds at a time; rows and bytes of a batch.
STEP, ROWS, BYTES = 1 << 19, 2048, 16 << 20
#: Numbers before a packed row, and bits of a label that travels with a track's popularity.
HEAD, LABEL = 6, 31
PARTS = "block int, side int, packed binary, case_id {}, nos array<long>, cnts array<long>"
PART_NAMES = ["block", "side", "packed", "case_id", "nos", "cnts"]
SUMS = "case_id {}, side int, seed long, pop long, times long, packed binary"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of few rows, which hold arrays, for what runs inside."""
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BYTES)}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def flat(x: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and where each one begins."""
    at = x.offsets.to_numpy()
    return x.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False), (at - at[0]).astype(np.int64)


def starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def unfolded(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, .. of so many each."""
    return np.arange(lengths.sum()) + np.repeat(begin - starts(lengths)[:-1], lengths)


def lists_of(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def changes(*cols: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it, the first row too."""
    if not len(cols[0]):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1])


def best(x: np.ndarray, at: np.ndarray, k: int, exact: bool) -> np.ndarray:
    """Which values are among the k largest of their row (rows begin at `at`); of equal ones the first, or all if not exact."""
    lengths = np.diff(at)
    least = np.full(len(lengths), -np.inf)
    long = np.flatnonzero(lengths > k)
    kind = np.ceil(np.log2(np.maximum(lengths[long], 1))).astype(int)
    for c in np.unique(kind):
        rows = long[kind == c]
        width = int(lengths[rows].max())
        for a in range(0, len(rows), max(1, STEP // width)):
            r = rows[a : a + max(1, STEP // width)]
            m = np.full((len(r), width), -np.inf)
            m[np.repeat(np.arange(len(r)), lengths[r]), unfolded(np.zeros(len(r), np.int64), lengths[r])] = x[unfolded(at[r], lengths[r])]
            least[r] = np.partition(m, width - k, axis=1)[:, width - k]
    bound = np.repeat(least, lengths)
    above, equal = x > bound, x == bound
    if not exact:
        return above | equal
    sure, tied = starts(above), starts(equal)
    left = k - (sure[at[1:]] - sure[at[:-1]])
    return above | equal & (tied[1:] - np.repeat(tied[at[:-1]], lengths) <= np.repeat(left, lengths))


def summed(keys: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their weights (None: 1 each)."""
    if weights is not None and (not len(weights) or weights.sum() < 2 * len(weights)):
        keys, weights = np.repeat(keys, weights), None  # most are 1: sorting keys alone is faster
    if weights is None:
        keys.sort()
        at = changes(keys)
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = changes(keys)
    return keys[at], np.add.reduceat(weights[order], at) if len(at) else weights[:0]


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as hold them."""
    if len(x) and x.min() < 0:
        return x.astype(np.int64)
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def squeezed(cols: list[np.ndarray]) -> tuple[list[str], int, bytes]:
    """Types of columns, bytes of them, and these in few bytes: first the first byte of all values of a column, then the second."""
    body = b"".join([x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in cols])
    return [x.dtype.char for x in cols], len(body), pa.compress(body, codec="zstd", asbytes=True)


def columns(n: list[int], chars: list[str], size: int, body: pa.Buffer) -> list[np.ndarray]:
    """The columns of `squeezed`, of so many values each."""
    body, at, cols = pa.decompress(body, decompressed_size=size, codec="zstd"), 0, []
    for n_x, t in zip(n, map(np.dtype, chars)):
        raw = np.frombuffer(body, np.uint8, n_x * t.itemsize, at)
        cols.append(np.ascontiguousarray(raw.reshape(t.itemsize, n_x).T).view(t).reshape(n_x))
        at += raw.nbytes
    return cols


def packed(nos: np.ndarray, pops: np.ndarray, sums: np.ndarray, ns: np.ndarray) -> bytes:
    """Tracks with their sums (or counts) in few bytes: what blocks send on is by far the most that is exchanged."""
    chars, size, body = squeezed([narrow(np.diff(nos, prepend=0)), narrow(pops), narrow(ns), sums if sums.dtype.kind == "f" else narrow(sums)])
    return np.array([len(nos), size, *map(ord, chars)], np.int64).tobytes() + body


def unpacked(rows: pa.Array) -> tuple[np.ndarray, ...]:
    """nos, pops, sums, ns of packed rows, one after another."""
    out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0), np.zeros(0, np.int64))]
    for x in rows:
        n, size, *chars = np.frombuffer(x.as_buffer(), np.int64, HEAD).tolist()
        nos, pops, ns, sums = columns([n] * 4, list(map(chr, chars)), size, x.as_buffer()[8 * HEAD :])
        out.append((np.cumsum(nos, dtype=np.int64), pops, sums, ns))
    return tuple(np.concatenate([x[i] for x in out], dtype=out[0][i].dtype) for i in range(4))


def lengths_of(rows: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(x.as_buffer(), np.int64, 1)[0] for x in rows], np.int64)


def packed_rows(cols: list[np.ndarray], at: np.ndarray) -> pa.Array:
    """A packed row for each of the ranges that begin at `at`."""
    return pa.array([packed(*[x[a:z] for x in cols]) for a, z in zip(at[:-1], at[1:])], pa.binary())


def packed_lists(nos: np.ndarray, pops: np.ndarray, cnts: np.ndarray, lengths: np.ndarray) -> bytes:
    """Many lists as one value; no list is empty."""
    steps, at = np.diff(nos, prepend=0), starts(lengths)[:-1]
    steps[at] = nos[at]
    chars, size, body = squeezed([narrow(x) for x in (lengths, steps, pops, cnts)])
    return np.array([len(lengths), len(nos), nos.min(), nos.max(), size, *map(ord, chars)], np.int64).tobytes() + body


def unpacked_lists(x: pa.Buffer) -> tuple[np.ndarray, ...]:
    n, places, _, _, size, *chars = np.frombuffer(x, np.int64, 9).tolist()
    lengths, steps, pops, cnts = columns([n, places, places, places], list(map(chr, chars)), size, x[72:])
    lengths, total = lengths.astype(np.int64), np.cumsum(steps, dtype=np.int64)
    first = starts(lengths)[:-1]
    return total - np.repeat(total[first] - steps[first].astype(np.int64), lengths), pops, cnts, lengths


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows case_id, side, seed, pop, times, nos, pops, vs, packed."""
    for b in batches:
        cols, at = [flat(b.column(i))[0] for i in range(5, 8)], flat(b.column(5))[1]
        rows = packed_rows([*cols, np.ones(len(cols[0]), np.int64)], at)
        yield pa.RecordBatch.from_arrays([*b.columns[:5], rows], [*b.schema.names[:5], "packed"])


def rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


class _Block:
    """The lists of one block; of some seeds, their neighbours."""

    def __init__(self, topk: int, shrink: float, bits: int):
        self.topk, self.shrink, self.bits, self.lists, self.seeds = topk, shrink, bits, [], []

    def read(self) -> None:
        """Lists as codes of their tracks (places in u), which are unpacked twice, so that no wider numbers are held."""
        heads = np.array([np.frombuffer(x, np.int64, 4) for x in self.lists])
        places, low, high = int(heads[:, 1].sum()), heads[:, 2].min(), heads[:, 3].max()
        dense = int(high) - int(low) < max(places // 4, 1)
        if dense:
            seen = np.zeros(high - low + 1, bool)
            for x in self.lists:
                seen[unpacked_lists(x)[0] - low] = True
            self.u, code_of = np.flatnonzero(seen) + low, (np.cumsum(seen) - 1).astype(np.int32)
        else:
            self.u, new, at = np.zeros(0, np.int64), [], 0
            for x in self.lists:
                new.append(np.unique(unpacked_lists(x)[0]))
                at += len(new[-1])
                if at > STEP or x is self.lists[-1]:
                    self.u, new, at = np.unique(np.concatenate([self.u, *new])), [], 0
        self.code, self.cnt, self.pop, lengths, at = np.empty(places, np.int32), None, np.zeros(len(self.u), np.int64), [], 0
        for i, x in enumerate(self.lists):
            nos, pops, cnts, n = unpacked_lists(x)
            code = code_of[nos - low] if dense else np.searchsorted(self.u, nos)
            self.pop[code] = pops
            if cnts.max() > 1 and (self.cnt is None or self.cnt.itemsize < cnts.itemsize):
                self.cnt = (self.cnt if self.cnt is not None else np.ones(places, np.uint8)).astype(cnts.dtype)
            if self.cnt is not None:
                self.cnt[at : at + len(nos)] = cnts
            self.code[at : at + len(nos)] = code
            at += len(nos)
            lengths.append(n)
            self.lists[i] = None
        self.at, self.lists = starts(np.concatenate(lengths)), None

    def rows(self, asked: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of the asked tracks (in order), some at a time: first and last, where each one's neighbours begin, codes of these, counts."""
        code, cnt, pop = self.code, self.cnt, self.pop >> self.bits
        at_u = np.searchsorted(self.u, asked)
        known = (at_u < len(self.u)) & (self.u[np.minimum(at_u, len(self.u) - 1)] == asked)
        row_of = np.full(len(self.u), -1, np.int32)
        row_of[at_u[known]] = np.flatnonzero(known)
        narrow_t = np.int32 if len(code) < 1 << 31 else np.int64
        occ = np.concatenate([(a + np.flatnonzero(row_of[code[a : a + STEP]] >= 0)).astype(narrow_t) for a in range(0, len(code), STEP)])
        occ = occ[np.argsort(row_of[code[occ]], kind="stable")]
        row = row_of[code[occ]]
        own_list = np.searchsorted(self.at, occ, side="right").astype(narrow_t) - 1
        lengths = np.diff(self.at)
        work = starts(np.bincount(row, weights=lengths[own_list], minlength=len(asked)).astype(np.int64))
        first = np.searchsorted(row, np.arange(len(asked) + 1))
        a = 0
        while a < len(asked):
            z = max(a + 1, int(np.searchsorted(work, work[a] + STEP, side="right")) - 1)
            s = slice(first[a], first[z])
            length = lengths[own_list[s]]
            idx = unfolded(self.at[own_list[s]], length)
            j, keys = code[idx], np.repeat(row[s].astype(np.int64) - a, length) * len(self.u)
            w = None if cnt is None else cnt[idx].astype(np.int64) * np.repeat(cnt[occ[s]].astype(np.int64), length)
            keys += j
            other = np.repeat(code[occ[s]], length) != j
            keys, v = summed(keys[other], None if w is None else w[other])
            r, j = np.divmod(keys, max(1, len(self.u)))
            own = at_u[a:z][r]
            sim = similarity(v, pop[own], pop[j], self.shrink)
            keep = best(sim, starts(np.bincount(r, minlength=z - a)), self.topk, True)
            yield a, z, starts(np.bincount(r[keep], minlength=z - a)), j[keep], v[keep]
            a = z

    def answers(self) -> Iterator[pa.RecordBatch]:
        """A row for each seed of a case that has neighbours."""
        if not self.lists or not self.seeds:
            return
        self.read()
        nos, times = (np.concatenate([x[i] for x in self.seeds]) for i in (1, 2))
        place = np.repeat(np.arange(sum(len(x[0]) for x in self.seeds)), np.concatenate([x[3] for x in self.seeds]))
        ids = pa.concat_arrays([x[0] for x in self.seeds])
        self.seeds = None
        asked, seed = np.unique(nos, return_inverse=True)
        order = np.argsort(seed, kind="stable")
        seed, times, place = seed[order], times[order], place[order]
        for a, z, at, js, vs in self.rows(asked):
            own = self.pop[np.minimum(np.searchsorted(self.u, asked[a:z]), len(self.u) - 1)]
            rows = packed_rows([self.u[js], self.pop[js], vs, np.ones(len(js), np.int64)], at)
            some = np.arange(*np.searchsorted(seed, [a, z]))
            some = some[np.diff(at)[seed[some] - a] > 0]
            for i in range(0, len(some), ROWS):
                m = some[i : i + ROWS]
                t = seed[m]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(place[m])), pa.array(np.ones(len(m), np.int32)), pa.array(asked[t]), pa.array(own[t - a]), pa.array(times[m]), rows.take(pa.array(t - a))], ["case_id", "side", "seed", "pop", "times", "packed"])


def similarity(v: np.ndarray, pop_i: np.ndarray, pop_j: np.ndarray, shrink: float) -> np.ndarray:
    return v / (np.sqrt(pop_i.astype(float) * pop_j) + shrink)


def _answered(topk: int, shrink: float, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = None, None
        for b in batches:
            if not b.num_rows:
                continue
            at, side = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            new = changes(at, side)
            for a, z in zip(new, [*new[1:], len(at)]):
                if own != at[a]:
                    if block:
                        yield from block.answers()
                    own, block = at[a], _Block(topk, shrink, bits)
                part = b.slice(a, z - a)
                if side[a] == 0:
                    block.lists += [x.as_buffer() for x in part.column(2)]
                else:
                    nos, of = flat(part.column(4))
                    block.seeds.append((part.column(3), nos, flat(part.column(5))[0], np.diff(of)))
        if block:
            yield from block.answers()

    return run


def _dealt(bounds: np.ndarray, hot: np.ndarray, case_t: str, seeds: bool):
    """Lists (nos, pops) go to each block that has one of their tracks; of a case's seeds (case_id, nos) each block gets its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            nos, at = flat(b.column(b.num_columns - 2))
            pops = flat(b.column(b.num_columns - 1))[0]
            row = np.repeat(np.arange(b.num_rows), np.diff(at))
            order = np.lexsort((nos, row))
            nos, row, pops = nos[order], row[order], pops[order]
            one = changes(nos, row)
            cnts = np.diff(np.append(one, len(nos)))
            nos, row, pops = nos[one], row[one], pops[one]
            at = starts(np.bincount(row, minlength=b.num_rows))
            free = np.flatnonzero(~np.isin(nos, hot))
            block = np.searchsorted(bounds, nos[free], side="right")
            new = changes(row[free], block)
            to, who = block[new], row[free][new]
            if seeds:
                off = np.append(new, len(free))
                parts, ids = [lists_of(x[free], off) for x in (nos, cnts)], b.column(0).take(pa.array(who))
                for a in range(0, len(to), ROWS):
                    n = len(to[a : a + ROWS])
                    got = [pa.nulls(n, pa.binary()), ids.slice(a, n), *[p.slice(a, n) for p in parts]]
                    yield pa.RecordBatch.from_arrays([pa.array(to[a : a + n].astype(np.int32)), pa.array(np.ones(n, np.int32)), *got], PART_NAMES)
                continue
            for x in np.unique(to):
                mine = who[to == x]
                # As many lists at a time as are read at a time, whatever their lengths.
                length = np.diff(at)[mine]
                work, a = starts(length), 0
                while a < len(mine):
                    z = max(a + 1, int(np.searchsorted(work, work[a] + (STEP >> 2), side="right")) - 1)
                    idx = unfolded(at[:-1][mine[a:z]], length[a:z])
                    got = [pa.array([packed_lists(nos[idx], pops[idx], cnts[idx], length[a:z])], pa.binary()), pa.nulls(1, case_t), *[pa.nulls(1, pa.list_(pa.int64()))] * 2]
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()), pa.array([0], pa.int32()), *got], PART_NAMES)
                    a = z

    return run


def _cases(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches, sorted by case_id, that hold whole cases, and the place of the case of each row."""
    kept = None
    for b in batches:
        if not b.num_rows:
            continue
        kept = pa.Table.from_batches([kept, b]).combine_chunks().to_batches()[0] if kept is not None else b
        new = _news(kept)
        if len(new) > 1:
            done = int(new[-1])
            yield kept.slice(0, done), _places(new[:-1], done)
            kept = kept.slice(done)
    if kept is not None:
        yield kept, _places(_news(kept), kept.num_rows)


def _news(b: pa.RecordBatch) -> np.ndarray:
    ids = b.column(0)
    return np.concatenate([[0], np.flatnonzero(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)) + 1])


def _some(b: pa.RecordBatch, place: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The cases of a batch, so many at a time that their tracks fit when unpacked."""
    new = np.append(changes(place), len(place))
    work, a = starts(lengths_of(b.column("packed")))[new], 0
    while a < len(new) - 1:
        z = max(a + 1, int(np.searchsorted(work, work[a] + STEP, side="right")) - 1)
        yield b.slice(new[a], new[z] - new[a]), place[new[a] : new[z]] - place[new[a]]
        a = z


def _places(new: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.arange(len(new)), np.diff(np.append(new, n)))


def _merged(b: pa.RecordBatch, place: np.ndarray, shrink: float, bits: int) -> tuple[np.ndarray, ...]:
    """case, no, pop, sum, n, whether a seed: one row for each track of a case, in their order."""
    length = lengths_of(b.column("packed"))
    nos, pops, vs, _ = unpacked(b.column("packed"))
    side, own, times = (np.repeat(b.column(c).to_numpy(), length) for c in ("side", "pop", "times"))
    sums = times * similarity(vs, own >> bits, pops >> bits, shrink)
    case = np.repeat(place, length)
    # Rows are sorted, so one key is sorted faster than two.
    low, span = (int(nos.min()), int(nos.max()) - int(nos.min()) + 1) if len(nos) else (0, 1)
    fits = (int(case.max(initial=0)) + 1) * span < 1 << 62
    order = np.argsort(case * span + (nos - low), kind="stable") if fits else np.lexsort((nos, case))
    case, nos = case[order], nos[order]
    one = changes(case, nos)
    add = lambda f, x: f.reduceat(x[order], one) if len(one) else x[:0]
    return case[one], nos[one], add(np.maximum, pops), add(np.add, sums), add(np.add, side.astype(np.int64)), add(np.maximum, side == 0)


def _filled(k: int, head: np.ndarray, pops: np.ndarray, shrink: float, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, place in (x for whole in _cases(batches) for x in _some(*whole)):
            ids = b.column(0).take(pa.array(changes(place)))
            case, no, pop, total, n, seed = _merged(b, place, shrink, bits)
            score = rounded(total)
            use = np.flatnonzero((score > 0) & ~seed)
            use = use[np.lexsort((no[use], -(pop[use] >> bits), -score[use], case[use]))]
            have = np.bincount(case[use], minlength=len(ids))
            rank = unfolded(np.ones(len(ids), np.int64), have)
            use, rank = use[rank <= k], rank[rank <= k]
            out = [(case[use], rank, no[use], score[use], n[use], pop[use])]
            of = starts(np.bincount(case, minlength=len(ids)))
            for c in np.flatnonzero(have < k):
                mine = slice(of[c], of[c + 1])
                gone = seed[mine] | (score[mine] > 0)
                take = np.flatnonzero(~np.isin(head, no[mine][gone]))[: k - have[c]]
                more = head[take]
                # Tracks whose score is 0 when rounded rank as popular ones do, but have their seeds.
                low = dict(zip(no[mine][~gone].tolist(), n[mine][~gone].tolist()))
                near = np.array([low.get(x, 0) for x in more.tolist()] if low else np.zeros(len(more)), np.int64)
                out.append((np.full(len(more), c), np.arange(have[c] + 1, have[c] + 1 + len(more)), more, np.zeros(len(more)), near, pops[take]))
            case, rank, no, score, n, pop = (np.concatenate([x[i] for x in out]) for i in range(6))
            order = np.lexsort((rank, case))
            at = starts(np.bincount(case, minlength=len(ids)))
            lists = [no.astype(np.int64), score, n.astype(np.int64), *([pop >> bits, pop & (1 << bits) - 1] if bits else [])]
            yield pa.RecordBatch.from_arrays([ids, *[lists_of(x[order], at) for x in lists]], ["case_id", "nos", "scores", "support", *(["pops", "labels"] if bits else [])])

    return run


def recommend(interactions: DataFrame, pop: DataFrame, cases: DataFrame, seeds: DataFrame, k: int, topk: int = 200, shrink: float = 10.0, labels: DataFrame | None = None) -> DataFrame:
    """case_id, tracks, scores, support (seeds that have the track among their neighbours), in order of rank: itemcf.recommend of itemcf.fit with cosines, without the table of neighbours between.

    With labels (track, label: a whole number below 2^31) the lists also have the popularity and the label of each track (pops, labels; 0 without one),
    which come along with the tracks and need no join with the lists.
    """
    spark = pop.sparkSession
    case_t, track_t = cases.schema["case_id"].dataType, pop.schema["track"].dataType
    numbers = isinstance(track_t, IntegralType)
    if numbers:
        known = pop.select("track", "pop", F.col("track").cast("long").alias("no"))
    else:
        # Numbers in the tracks' order, whatever their type.
        parts = max(1, -(-pop.count() // TRACKS))
        known = cut(pop.repartitionByRange(parts, "track").sortWithinPartitions("track").select("track", "pop", F.monotonically_increasing_id().alias("no")))
    bits = LABEL if labels is not None else 0
    n, places = known.agg(F.count("*"), F.coalesce(F.sum("pop"), F.lit(0))).first()
    often = known.filter(F.col("pop") > HOT)
    hot = np.sort(np.array([r["no"] for r in often.select("no").collect()], np.int64))  # at most places / HOT tracks
    # A track counts once, and once more for each so many places as a track has on average: at most 2n rows.
    weighed = known.filter(F.col("pop") <= HOT).select("no", F.explode(F.array_repeat(F.lit(0), (1 + F.col("pop") * n / max(1, places)).cast("int"))))

    if bits:
        known = cut(known.join(labels.select("track", "label"), "track", "left").withColumn("pop", F.shiftleft("pop", LABEL) + F.coalesce("label", F.lit(0))).drop("label"))
        often = known.filter(F.shiftright("pop", LABEL) > HOT)
    placed = interactions.select("pid", "track").join(known, "track")
    lists = placed.groupBy("pid").agg(F.collect_list(F.struct("no", "pop")).alias("x")).select(F.col("x.no").alias("nos"), F.col("x.pop").alias("pops"))
    lists = cut(lists)  # its shuffles go before those of the blocks come
    met = lists.agg(F.coalesce(F.sum(F.size("nos").cast("double") * F.size("nos")), F.lit(0.0))).first()[0] if places > ENTRIES else 0
    tasks = spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n // TRACKS), -(-places // PLACES), -(-int(met) // ENTRIES), min(tasks, n >> 12))
    blocks = -(-blocks // tasks) * tasks if blocks > tasks else blocks
    bounds = np.array(weighed.approxQuantile("no", [i / blocks for i in range(1, blocks)], 0.1 / blocks) if blocks > 1 else []).astype(np.int64)
    own = seeds.select("case_id", "track").join(known.select("track", "no"), "track").groupBy("case_id").agg(F.collect_list("no").alias("nos"))
    own = cases.select("case_id").join(own, "case_id", "left").select("case_id", F.coalesce("nos", F.array().cast("array<long>")).alias("nos"))
    arrow_t = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[case_t.simpleString()]
    parts_t = PARTS.format(case_t.simpleString())
    dealt = lists.mapInArrow(_dealt(bounds, hot, arrow_t, False), parts_t).unionByName(own.filter(F.size("nos") > 0).select("case_id", "nos", F.col("nos").alias("pops")).mapInArrow(_dealt(bounds, hot, arrow_t, True), parts_t))
    sums_t = SUMS.format(case_t.simpleString())
    sums = dealt.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "side").mapInArrow(_answered(topk, shrink, bits), sums_t)
    if len(hot):
        sums = sums.unionByName(_often(placed, often, seeds.join(known.select("track", "no"), "track"), topk, shrink, bits).mapInArrow(_pack, sums_t))
    nothing = lambda t: F.transform("nos", lambda x: F.lit(0).cast(t))
    asked = own.select("case_id", F.lit(0).alias("side"), *[F.lit(0).cast("long").alias(c) for c in ("seed", "pop", "times")], "nos", nothing("long").alias("pops"), nothing("long").alias("vs")).mapInArrow(_pack, sums_t)
    most = own.agg(F.coalesce(F.max(F.size("nos")), F.lit(0))).first()[0]
    top = popular_top(pop, 2 * k + int(most)).select("track", "pop_rank").join(known, "track").orderBy("pop_rank").select("no", "pop").collect()  # bounded: 2k + seeds of a case
    head, pops = (np.array([r[c] for r in top], np.int64) for c in ("no", "pop"))
    each = {"scores": "double", "support": "long", **({"pops": "long", "labels": "long"} if bits else {})}
    rows_t = ", ".join([f"case_id {case_t.simpleString()}, nos array<long>", *[f"{c} array<{t}>" for c, t in each.items()]])
    out = sums.unionByName(asked).repartition("case_id").sortWithinPartitions("case_id", "side", "seed").mapInArrow(_filled(k, head, pops, shrink, bits), rows_t)
    if numbers:
        out = out.withColumn("tracks", F.col("nos").cast(f"array<{track_t.simpleString()}>"))
    else:
        rows = out.select("case_id", F.posexplode(F.arrays_zip("nos", *each)).alias("at", "x")).select("case_id", "at", "x.*").join(known.select("track", F.col("no").alias("nos")), "nos")
        rows = rows.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("at", "track", *each))).alias("x"))
        out = rows.select("case_id", F.col("x.track").alias("tracks"), *[f"x.{c}" for c in each])
    with small_batches(spark):
        done = cut(out.select("case_id", "tracks", *each))
    remove_folder(spark, lists.inputFiles()[0].rpartition("/")[0])
    return done


def _often(placed: DataFrame, often: DataFrame, seeds: DataFrame, topk: int, shrink: float, bits: int = 0) -> DataFrame:
    """What the seeds in very many lists give to their cases: pairs of these tracks alone, by an aggregate."""
    c = placed.groupBy("pid", "no", "pop").agg(F.count("*").alias("cnt"))
    a = c.join(F.broadcast(often.select("no")), "no", "left_semi").select("pid", F.col("no").alias("i"), F.col("pop").alias("p"), F.col("cnt").alias("n"))
    pairs = c.join(a, "pid").filter("i <> no").groupBy("i", "p", "no", "pop").agg(F.sum(F.col("n") * F.col("cnt")).alias("v"))
    sim = pairs.select("i", "p", "no", "pop", "v", (F.col("v") / (F.sqrt(F.shiftright("p", bits).cast("double") * F.shiftright("pop", bits)) + shrink)).alias("sim"))
    near = sim.withColumn("r", F.row_number().over(W.partitionBy("i").orderBy(F.desc("sim"), "no"))).filter(F.col("r") <= topk)
    rows = near.groupBy("i", "p").agg(F.array_sort(F.collect_list(F.struct("no", "pop", "v"))).alias("x"))
    s = seeds.groupBy("case_id", F.col("no").alias("i")).agg(F.count("*").alias("times")).join(rows, "i")
    return s.select("case_id", F.lit(1).alias("side"), F.col("i").alias("seed"), F.col("p").alias("pop"), "times", F.col("x.no").alias("nos"), F.col("x.pop").alias("pops"), F.col("x.v").alias("vs"))
