import random

import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from segue.llm import bpe, chat, pii, simhash, toxicity
from tests.llm.test_native import plain_hits, plain_surrogates
from tests.llm.test_similar import brute

P = pytest.importorskip("public_tokenizers")


def text(i, n=80):
    r = random.Random(i)
    return " ".join(f"w{r.randrange(10**6)}x" for _ in range(n))


def write(spark, folder, rows, extra=""):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + extra).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(t is not None and "moron" in t)) for i, t, *_ in rows if i is not None and i < 200]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, text(900, 30)), (2, "short item")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_do_what_they_say(spark, tmp_path):
    rows = [(i, ("you moron " if i % 5 == 0 else "") + text(i), "en", "s", 1) for i in range(200)]
    rows += [(300, text(1).upper(), "en", "s", 1), (301, "before " + text(900, 30)[20:] + " after", "en", "s", 1), (302, "mail jo.doe@mail.example.org now " + text(302), "en", "s", 1)]
    rows += [(303, None, None, None, None), (304, "", "en", "s", 0), (None, text(305), "en", "s", 1), (302, "mail jo.doe@mail.example.org now " + text(302), "en", "s", 1)]
    rows = [(*r, 7) for r in rows]
    write(spark, str(tmp_path), rows, ", predicted int")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    toxic = {i for i in range(0, 200, 5)}
    assert not toxic & set(out) and 301 not in out and 300 not in out
    # Each of null and empty text has fingerprint zero: the smaller id stays.
    want = (set(range(200)) - toxic) | {302, 303, None}
    assert set(out) == want and len(out) == len(want)
    assert "jo.doe@mail.example.org" not in out[302].text and out[302].text.endswith(text(302)) and out[302].n_chars == len(out[302].text)
    c = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert all(r.ids == c.encode(r.text) and r.n_tokens == len(r.ids) and r.predicted == 7 for r in out.values())
    assert out[1].text == text(1) and out[303].text is None


def test_stages_keep_columns_and_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [(1, text(1), "en", "s", 1)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert chat and simhash


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Stage by stage in plain Python: trees' scores, all pairs, all windows, entities one by one, the tokenizer's own ids.
    With exact and near copies in number, a very long text, personal data and benchmark passages."""
    r = random.Random(40)
    rows = [(i, ("you moron " if i % 5 == 0 else "") + text(i)) for i in range(150)]
    words = text(1000, 120).split()
    rows += [(200 + i, " ".join(words)) for i in range(60)]  # one group of copies
    for i in range(40):  # and of near copies
        w = list(words)
        w[r.randrange(120)] = f"own{i}"
        rows.append((300 + i, " ".join(w)))
    rows += [(400, "the start " + text(2000, 60_000)), (401, text(900, 30) + " tail " + text(401)), (402, text(402) + " by Maria Lopez, maria.lopez@mail.example.org; Lopez again")]
    rows += [(403, "Anna Meier " + text(403, 9)), (404, "short item"), (405, "10.20.30.40 and 10.20.30.41")]
    write(spark, str(tmp_path), [(i, t, "en", "s", len(t)) for i, t in rows])
    out = {x.doc_id: (x.text, x.ids) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [(i, t) for (i, t), s in zip(rows, model.score([t for _, t in rows])) if s < 0.5]
    first = brute([(i, t) for i, t in left if i != 400], 0.8) | {400}
    left = [(i, t) for i, t in left if i in first]
    hits = plain_hits([t for _, t in left], [(1, text(900, 30)), (2, "short item")])
    left = [(i, t) for (i, t), (_, n, _) in zip(left, hits) if n == 0]
    d = spark.createDataFrame(left, "doc_id long, text string")
    table = {x.entity: x.surrogate for x in pii.checked(d.select(F.explode(pii.entities(F.col("text"))).alias("entity")).distinct(), corpus_pipeline.PII_KEY).collect()}
    enc = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    want = {i: plain_surrogates(t, table) for i, t in left}
    assert set(out) == set(want) and {200, 400, 402, 403, 405} <= set(out) and not {401, 404, 201, 300} & set(out)
    assert all(out[i] == (t, enc.encode(t)) for i, t in want.items())
    assert want[402] != dict(rows)[402]
