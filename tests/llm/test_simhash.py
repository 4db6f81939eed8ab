import random

import numpy as np
import xxhash

from segue.llm import simhash
from segue.llm.components import connected_components


def plain_fingerprint(text, width=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, tau):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(root)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= tau and find(a) != find(b):
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprints():
    r = random.Random(1)
    texts = [None, "", " \t\n", "One", "a b c", "A b\x0bC D e", "É é x y z", "a a a a a a a", "w\u00a0x y", "\x1cq w"] + [" ".join(r.choices("the of and to in é Z".split(), k=r.randint(1, 60))) for _ in range(40)]
    for t in texts:
        assert simhash.fingerprint((t or "").encode()) == plain_fingerprint(t), t


def nodes(spark, rows):
    return simhash._with_node(spark.createDataFrame(rows, "doc_id long, fp long"))


def test_groups_equal_brute_force(spark):
    r = random.Random(3)
    fps = []
    for _ in range(40):  # chains and dense groups around centres
        f = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            fps.append(f)
            for b in r.sample(range(64), r.randint(0, 6)):
                f ^= 1 << b
    fps += [0, 1, 3, (1 << 64) - 1, 1 << 63]
    rows = [(None if i % 17 == 0 else i % 90, simhash.signed(f)) for i, f in enumerate(fps)]
    for tau in (4, 2):
        want = plain_components(fps, tau)
        least = {}
        for (i, _), f in zip(rows, fps):
            if i is not None:
                least[want[f]] = min(i, least.get(want[f], i))
        got = {x.node: x.component_id for x in simhash.components(nodes(spark, rows), tau).collect()}
        assert got == {simhash.signed(f): least.get(want[f]) for f in fps}


def test_hot_values_take_further_bits_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    r = random.Random(4)
    base = r.getrandbits(64)
    # One dense group, and unlike fingerprints that share their first half: hot by their partitions, cold by further bits.
    dense = {base ^ sum(1 << b for b in r.sample(range(40), 3)) for _ in range(150)}
    half = r.getrandbits(32) << 32
    apart = {half | r.getrandbits(32) for _ in range(150)}
    pairs = {f ^ 1 for f in list(apart)[:20]}
    fps = sorted(dense | apart | pairs)
    got = simhash.components(nodes(spark, [(i, simhash.signed(f)) for i, f in enumerate(fps)]), 4).collect()
    want = plain_components(fps, 4)
    assert len({x.root for x in got}) == len(set(want.values()))
    assert all(len(simhash.further_masks([0, 5, 63], t)) == t + 1 and sum(m.bit_count() if m >= 0 else (m + (1 << 64)).bit_count() for m in simhash.further_masks([0, 5, 63], t)) == 61 for t in (2, 4, 6))


def test_forest_spans_all_links():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 8, 60).astype(np.uint64)
    b = r.integers(0, 1 << 8, 50).astype(np.uint64)
    u, v = simhash.forest(np.stack([a, a], axis=1), np.stack([b, b], axis=1), 1)
    want = {}
    for x in a:
        for y in b:
            if int(x ^ y).bit_count() <= 1:
                want.setdefault(int(x), set()).add(int(y))
    nodes = sorted({x for x in want} | {y for s in want.values() for y in s})

    def components(edges):
        root = {n: n for n in nodes}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for p, q in edges:
            root[find(p)] = find(q)
        return {frozenset(n for n in nodes if find(n) == find(m)) for m in nodes}

    assert components([(int(x), int(y)) for x, y in zip(u, v)]) == components([(x, y) for x, s in want.items() for y in s])


def test_hot_groups_and_hubs_are_dealt_over_tasks(spark, monkeypatch):
    from segue.llm import _common

    monkeypatch.setattr(_common, "HOT_ROWS", 4)
    monkeypatch.setattr(_common, "HOT_KEYS", 50)
    star = [(i, 0) for i in range(1, 200)] + [(i, 500) for i in range(501, 600)] + [(600, 3), (600, 555)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(star, "u long, v long")).collect()}
    assert set(got.values()) == {0} and len(got) == 301
    r = random.Random(8)
    f = r.getrandbits(64)
    fps = [f] * 50 + [f ^ (1 << b) for b in range(40)] + [r.getrandbits(64) for _ in range(30)]
    rows = [(i, simhash.signed(x)) for i, x in enumerate(fps)]
    want = plain_components(fps, 4)
    got = {x.node: x.component_id for x in simhash.components(nodes(spark, rows), 4).collect()}
    assert len(set(got.values())) == len(set(want.values())) and sum(c == 0 for c in got.values()) == 41


def test_allocation_is_least():
    r = random.Random(2)
    for m in (1, 2, 3, 5):
        costs = [[0.0] + sorted(r.random() for _ in range(5)) for _ in range(m)]
        cost, ts = simhash.allocate(costs, 4)
        assert sum(ts) == 4 - m + 1 and abs(cost - sum(c[t + 1] for c, t in zip(costs, ts))) < 1e-9


def test_long_chain_of_components(spark):
    n = 300
    got = {x.node: x.root for x in connected_components(spark.createDataFrame([(i + 1, i) for i in range(n)], "u long, v long")).collect()}
    assert got == {i: 0 for i in range(n + 1)}


def test_one_of_each_group_stays(spark):
    t = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3
    rows = [(5, t, 1), (3, t.upper(), 2), (3, t.upper(), 2), (None, "lonely words of a null id", 3), (None, "another row without any id", 4), (7, "quite another text about something else", 5), (8, None, 6), (9, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.fp) for r in kept.collect()), key=str)
    assert got == sorted([(3, 2), (None, 3), (None, 4), (7, 5), (8, 6)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_wide_fingerprints_find_near_copies_only(spark):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [r.choices(vocabulary, k=200) for _ in range(40)]
    rows, want = [], {}
    for g, words in enumerate(base):
        for c in range(3):
            w = list(words)
            for at in r.sample(range(200), 3 * c):  # 5-word shingles: similarity of 0.86 and 0.73 at least
                w[at] = r.choice(vocabulary)
            rows.append((g * 10 + c, " ".join(w)))
            want[g * 10 + c] = g
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id // 10 for x in simhash.near_duplicates(docs, tau=10, width=5, wide_tau=38).collect()}
    assert all(got[i] in (g, i // 10) for i, g in want.items())
    firsts = [got[g * 10 + 1] == g and got[g * 10] == g for g in range(40)]
    assert sum(firsts) >= 34
    first = simhash.wide_fingerprint(rows[0][1].encode(), 4)
    assert first[0] == simhash.fingerprint(rows[0][1].encode(), 4) and len(set(first)) == 4
