"""Trees, toxicity, quality and language on small tables."""

import random
import time

import numpy as np

from segue.llm import gbt, langid, quality, toxicity
from segue.llm._common import crc_fold, is_held_out


def test_trees_learn_and_keep_constraints():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    t = gbt.fit(x[:2000], y[:2000], trees=60)
    assert ((t.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    noisy = (r.random(3000) < 1 / (1 + np.exp(-2 * x[:, 2]))).astype(float)
    for sign in (1, -1):
        m = gbt.fit(x, noisy, {2: sign}, trees=30)
        grid = np.repeat(r.normal(size=(1, 4)), 200, axis=0)
        grid[:, 2] = np.linspace(-3, 3, 200)
        assert (sign * np.diff(m.margin(grid)) >= -1e-12).all()
    assert gbt.fit(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_flat_arrays_equal_walking():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 3))
    t = gbt.fit(x, (x.sum(axis=1) > 0).astype(float), trees=10)

    def walk(row):
        total = t.base
        for n in t.roots:
            while t.left[n] != n:
                n = t.left[n] if row[t.feature[n]] <= t.threshold[n] else t.right[n]
            total += t.value[n]
        return total

    assert np.allclose(t.margin(x[:50]), [walk(v) for v in x[:50]])


def test_isotonic_is_monotone():
    r = np.random.default_rng(2)
    s = r.random(400)
    y = (r.random(400) < s).astype(float)
    px, pp = gbt.isotonic(s, y)
    assert (np.diff(px) > 0).all() and (np.diff(pp) >= 0).all()
    assert abs(gbt.calibrated((px, pp), s).mean() - y.mean()) < 0.03


WORDS = "river stone music garden paper light window travel letter season market bridge".split()


def toxic_docs():
    r = random.Random(0)
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = r.choices(WORDS, k=r.randint(10, 60)) + (["you", r.choice(["moron", "zarkling", "zarkest", "zarkone"])] if bad else [])
        r.shuffle(w)
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(i % 3 > 0), int(bad)))
    return docs, labels


def test_toxicity_on_held_out_and_edges(spark):
    docs, labels = toxic_docs()
    edges = [(None, None, None), (1000, "", "x"), (1001, None, "x"), (0, docs[0][1], "x"), (1002, " ".join(WORDS * 30_000), "x")]
    d = spark.createDataFrame(docs + edges, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (9999, 0, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score(d, toxicity.train(d, lab)).select("doc_id", "score", "predicted", is_held_out().alias("h")).collect()
    assert len(out) == len(docs) + len(edges) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    want = {i: t for i, _, t in labels}
    held = [r for r in out if r.h and r.doc_id in want]
    assert len(held) > 40 and np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.97
    assert [r.predicted for r in out if r.doc_id in (None, 1000, 1001, 1002)] == [0] * 4
    assert len({r.score for r in out if r.doc_id == 0}) == 1
    none = toxicity.score(d.limit(3), toxicity.train(d, lab.limit(0))).collect()
    assert len(none) == 3 and toxicity.score(d.limit(0), toxicity.train(d.limit(0), lab)).count() == 0


def test_disguises():
    lex = toxicity.Lexicon({"idiot": 4.0}, {"zark": 3.0})
    f = lambda t: dict(zip(toxicity.FEATURES, toxicity.features(t, lex)))
    assert f("You IDIOT!")["hits"] == 1 and f("You IDIOT!")["near_you"] == 1
    assert f("an 1d1ot or id1ot")["disguised_hits"] >= 1 and f("i.d.i.o.t here")["disguised_hits"] == 1
    assert f("zarklings")["hits"] == 1 and f("nothing here")["hits"] == 0


def test_features_are_linear_in_hostile_texts():
    lex = toxicity.Lexicon({"idiot": 4.0}, {"zark": 3.0})
    f = lambda t: dict(zip(toxicity.FEATURES, toxicity.features(t, lex)))
    began = time.time()
    for bit in ("a_", "a_a_a_ ", "1a1", "a1", "@$!", "you idiot ", "a.b.c", "aa_b_", "**a", "é-"):
        f(bit * ((1 << 20) // len(bit)))
    assert time.time() - began < 120
    assert f("i_d_i_o_t")["disguised_hits"] == f("so i d i o t here")["disguised_hits"] == 1 and f("i.d.i.ot")["disguised_hits"] == 0
    words = "idiot x you x x x x x x x idiot".split()
    assert f(" ".join(words))["near_you"] == 1 and f("you x x x x idiot")["near_you"] == 1 and f("you x x x x x idiot")["near_you"] == 0


def test_ids_of_text_and_repeated_labelled_rows(spark):
    docs, labels = toxic_docs()
    d = spark.createDataFrame([(f"d{i}", t, "en" if i % 2 else "de") for i, t, _ in docs] + [("d0", docs[0][1], "de")] * 300, "doc_id string, text string, lang string")
    lab = spark.createDataFrame([(f"d{i}", q, t) for i, q, t in labels], "doc_id string, quality int, toxic int")
    m = toxicity.train(d, lab, sample=250)
    out = toxicity.score(d, m).collect()
    want = {f"d{i}": t for i, _, t in labels}
    assert np.mean([r.predicted == want[r.doc_id] for r in out]) > 0.9
    again = toxicity.train(d.repartition(7), lab.repartition(5), sample=250)
    assert (again.trees.value == m.trees.value).all() and again.lex.words == m.lex.words
    assert quality.judge(d, quality.train(d, lab, sample=100)).count() == len(out)
    assert langid.predict(d, langid.train(d, sample=100)).filter("lang_pred in ('en', 'de')").count() == len(out)


def test_toxicity_query_equals_brute_force(spark):
    """Trees walked node by node and calibration by hand, over the operator's whole table."""
    docs, labels = toxic_docs()
    d = spark.createDataFrame(docs, "doc_id long, text string, x string")
    m = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    t, (px, pp) = m.trees, m.points

    def plain(text):
        x, z = toxicity.features(text, m.lex), t.base
        for n in t.roots:
            while t.left[n] != n:
                n = t.left[n] if x[t.feature[n]] <= t.threshold[n] else t.right[n]
            z += t.value[n]
        p = 1 / (1 + np.exp(-z))
        if not len(px):
            return p
        k = int(np.searchsorted(px, p))
        if k == 0 or k == len(px):
            return pp[min(k, len(px) - 1)]
        return pp[k - 1] + (pp[k] - pp[k - 1]) * (p - px[k - 1]) / (px[k] - px[k - 1])

    for r in toxicity.score(d, m).collect():
        assert abs(r.score - plain(r.text)) < 1e-9 and r.predicted == int(r.score >= 0.5)


def test_quality_verdict_equals_brute_force(spark):
    r = random.Random(4)
    docs = [(i, " ".join("".join(r.choices("abcdefghij", k=5)) + ("###" if i % 3 == 0 else "") for _ in range(r.randint(30, 90)))) for i in range(150)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = quality.train(d, spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in docs], "doc_id long, quality int, toxic int"))

    def plain(text):
        counts, x = quality.measure(text)
        z = t.base
        for n in t.roots:
            while t.left[n] != n:
                n = t.left[n] if x[t.feature[n]] <= t.threshold[n] else t.right[n]
            z += t.value[n]
        return counts[0] >= 50 and 100 * counts[4] <= 50 * counts[0] and z >= 0

    got = {r.doc_id: r.kept for r in quality.judge(d, t).collect()}
    assert got == {i: plain(x) for i, x in docs} and len(set(got.values())) == 2


def test_language_equals_brute_force_and_ties(spark):
    """Class scores added up n-gram by n-gram from the hash's definition; equal scores go to the first language."""
    docs = [(i, ("der die und " if i % 2 else "the and of ") * (3 + i % 5) + str(i), "de" if i % 2 else "en") for i in range(120)]
    d = spark.createDataFrame(docs + docs[:3], "doc_id long, text string, lang string")
    m = langid.train(d)

    def grams(text):
        cp = [32 if c < 97 or 122 < c < 0xAA else c for c in map(ord, " " + text.lower() + " ")]
        for n in langid.GRAMS:
            for i in range(len(cp) - n + 1):
                h = 0
                for c in cp[i : i + n]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ (c * 0x9E3779B1 & 0xFFFFFFFF)
                h = ((h ^ h >> 15) * 0x85EBCA6B + n) & 0xFFFFFFFF
                yield h >> 19

    for text in ("der und die katze", "the cat and the hat", "x"):
        own = [m.rows[g] for g in grams(text)]
        z = (np.sum(own, axis=0, dtype=float) / len(own) + m.bias) / m.heat
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        lang, score = m.predict([text])
        assert lang == [m.langs[int(p.argmax())]] and abs(score[0] - p.max()) < 1e-6
    got = langid.predict(d, m).collect()
    assert len(got) == 123 and len({(r.doc_id, r.lang_pred, r.score) for r in got}) == 120
    assert langid.Model(["aa", "bb"], np.zeros((langid.BUCKETS, 2)), np.zeros(2), 1.0, 0.6).predict(["word"])[0] == ["aa"]
    flat = langid.predict(d.limit(2), langid.Model(["aa", "bb"], np.zeros((langid.BUCKETS, 2)), np.zeros(2), 1.0, 0.6)).collect()
    assert all(r.rejected and r.lang_pred == "aa" for r in flat)


def plain_counts(t):
    t = t or ""
    ws = " \t\n\x0b\x0c\r"
    split = lambda s: [w for w in "".join(" " if c in ws else c for c in s).split(" ") if w]
    w = split(t)
    lines = t.split("\n")
    dup = sum(1 for i, line in enumerate(lines) if split(line) and line in lines[:i])
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)]


def test_quality_counts_equal_brute_force():
    r = random.Random(3)
    bits = ["a", "b", "cé", "😀", " ", " ", "\n", "\t", "#", "|x", " ", "\x1c", "\r\n"]
    for t in [None, "", "\n\n", " a\n a\na"] + ["".join(r.choices(bits, k=r.randint(1, 120))) for _ in range(150)]:
        assert quality.measure(t)[0] == plain_counts(t), t


def test_quality_query_and_edges(spark):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(300):
        w = ["".join(r.choices("abcdefghij", k=5)) for _ in range(80)]
        docs.append((i, " ".join(x + "###" if i % 3 == 0 else x for x in w), 1))
        labels.append((i, int(i % 3 > 0), 0))
    edges = [(None, None, 1), (700, "", 1), (701, "a b c " * 40, 1), (0, docs[0][1], 1)]
    d = spark.createDataFrame(docs + edges, "doc_id long, text string, kept int")
    lab = spark.createDataFrame(labels + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    out = quality.judge(d, quality.train(d, lab)).collect()
    by = {x.doc_id: x for x in out}
    assert len(out) == len(docs) + len(edges)
    assert np.mean([by[i].kept == bool(q) for i, q, _ in labels]) > 0.98
    assert by[701].base_failed and by[700].base_failed and not by[701].kept and by[None].n_words == 0
    assert quality.judge(d.limit(0), quality.train(d, lab.limit(0))).count() == 0


def test_language_and_edges(spark):
    r = random.Random(5)
    syll = {"en": "the ing and ion that her for".split(), "de": "sch ung ein der ich ä ü".split(), "fr": "eau oui les est qu é ment".split()}
    docs = []
    for i in range(450):
        la = list(syll)[i % 3]
        docs.append((i, " ".join("".join(r.choices(syll[la], k=2)) for _ in range(r.randint(5, 60))), la))
    edges = [(None, None, "en"), (800, "", None), (801, "123 !! 456", "de"), (802, docs[0][1], None), (803, docs[0][1] * 3000, "fr")]
    d = spark.createDataFrame(docs + edges, "doc_id long, text string, lang string")
    m = langid.train(d.filter("doc_id is null or doc_id < 800"))
    out = {x.doc_id: x for x in langid.predict(d.withColumnRenamed("lang", "score"), m).select("doc_id", "lang_pred", "score", is_held_out().alias("h")).collect()}
    held = [x for x in out.values() if x.h and x.doc_id < 450]
    assert held and np.mean([x.lang_pred == docs[x.doc_id][2] for x in held]) > 0.97
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (None, 800, 801)) and all(0 <= x.score <= 1 for x in out.values())
    assert out[802].lang_pred == "en" and out[803].lang_pred == "en"
    none = langid.predict(d, langid.train(d.limit(0))).select("lang_pred").distinct().collect()
    assert [x[0] for x in none] == ["und"]
    assert d.filter(crc_fold() == 0).count() > 0


def test_long_text_is_hashed_in_blocks(monkeypatch):
    t = "Häuser und Straßen " * 200
    whole = np.bincount(np.concatenate(list(langid.buckets_of(t))), minlength=langid.BUCKETS)
    monkeypatch.setattr(langid, "STEP", 100)
    assert (np.bincount(np.concatenate(list(langid.buckets_of(t))), minlength=langid.BUCKETS) == whole).all()
