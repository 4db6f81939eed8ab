import random

from segue.llm import similar, simhash


def corpus():
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows = []
    for g in range(40):
        base = r.choices(vocabulary, k=r.choice((60, 120, 300)))
        rows.append((g * 10, " ".join(base)))
        for c in range(1, 5):  # cut at the end: the similarity is the share that stays, from 0.78 to 0.9
            keep = round((len(base) - 4) * (0.76 + 0.03 * c + 0.01 * (g % 3))) + 4
            rows.append((g * 10 + c, " ".join(base[:keep])))
    return rows


def brute(rows, least):
    sets = [(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) for i, t in rows for w in (t.split(),)]
    root = {i: i for i, _ in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if len(a & b) >= least * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {find(i) for i in root}


def test_all_pairs_of_the_similarity_are_linked_and_no_others(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 0.8)
    assert 40 <= len(want) < 60
    for block in (512, 2):
        monkeypatch.setattr(similar, "BLOCK", block)
        assert {x.doc_id for x in similar.keep_one(docs).collect()} == want


def test_pairs_only(spark):
    r = random.Random(13)
    rows = []
    for g in range(100):  # pairs of similarity 0.81 and 0.79 in turn
        base = [f"v{r.randrange(10**6)}" for _ in range(204)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[: (162 if g % 2 == 0 else 158) + 4]))]
    kept = {x.doc_id for x in similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * g for g in range(100)} | {2 * g + 1 for g in range(1, 100, 2)}


def test_a_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    """A dense group in one hot key, and a chain of texts whose ends are unlike each other."""
    monkeypatch.setattr(similar, "BLOCK", 8)
    r = random.Random(21)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        w[r.randrange(200)] = f"own{i}"
        rows.append((i, " ".join(w)))
    chain = [f"c{r.randrange(10**6)}" for _ in range(400)]
    rows += [(100 + i, " ".join(chain[i * 6 : i * 6 + 200])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id for x in similar.keep_one(docs).collect()} == brute(rows, 0.8) == {0, 100}


def test_recall_of_simhash_alone_and_of_the_stage(spark):
    """Against all pairs at similarities from 0.8 on: SimHash alone misses many pairs, the stage none of these."""
    import corpus_pipeline

    r = random.Random(30)
    rows, apart = [], []
    for g in range(300):
        base = [f"v{r.randrange(10**7)}" for _ in range(r.choice((64, 104, 304)))]
        keep = round((len(base) - 4) * r.uniform(0.81, 0.95)) + 4
        a, b = " ".join(base), " ".join(base[:keep])
        rows += [(2 * g, a), (2 * g + 1, b)]
        bits = simhash.majority(similar.shingles(a.encode(), 5)) ^ simhash.majority(similar.shingles(b.encode(), 5))
        apart.append(bits.bit_count())
    kept = [x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert sum(i % 2 for i in kept) <= 3  # recall of 0.99 or more
    assert sorted(i for i in kept if i % 2 == 0) == [2 * g for g in range(300)]
    assert 0.1 < sum(d <= similar.TAU for d in apart) / 300 < 0.9


def test_pipeline_stage_refuses_pairs_of_0_81(spark):
    import corpus_pipeline

    r = random.Random(14)
    rows = []
    for g in range(50):
        base = [f"v{r.randrange(10**6)}" for _ in range(204)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[:166]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [2 * g for g in range(50)]


def test_one_of_each_group_stays(spark):
    t = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3
    rows = [(5, t, 1), (3, t.upper(), 2), (3, t.upper(), 2), (2, "of a few words", 8), (None, "lonely words of a null id", 3), (None, "another row without any id", 4), (8, None, 6), (9, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.row) for r in kept.collect()), key=str) == sorted([(3, 2), (2, 8), (None, 3), (None, 4), (8, 6)], key=str)
    assert similar.keep_one(docs.limit(0)).count() == 0
