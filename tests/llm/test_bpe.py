import random

import pytest

from segue.llm import bpe

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


def plain():
    import tiktoken

    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def texts():
    r = random.Random(5)
    parts = ["the", " ", "  ", "\n\n", "don't", "12345", "é", "😀", "ß.", "###", "'ll", "a" * 40, " " * 30, "\t", "word", "'", "s", "你好"]
    out = ["", " ", "a", "   x", "'s's's"] + ["".join(r.choices(parts, k=r.randint(1, 200))) for _ in range(60)]
    return out + ["x" * 5000, " " * 5000 + "y", "".join(r.choices("ab '\n1", k=6000))]


def test_chunks_give_the_ids_of_one_scan():
    enc, c = plain(), bpe.codec(PATH, P.PATTERN)
    for t in texts():
        want = enc.encode_ordinary(t)
        assert c.encode(t) == want
        for chunk, overlap in ((7, 5), (50, 20), (400, 64)):
            assert bpe.encode_long(c, t, chunk, overlap) == want
        assert bpe.decode_ids(want, bpe.tokens_of(PATH)) == t.encode()


def test_operator_and_its_edges(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, None, None), (1, " ", "x"), (1, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(docs, PATH, P.PATTERN, chunk=300, overlap=40), PATH).collect()
    enc = plain()
    assert sorted((str(r.doc_id), r.text or "", r.ids, bytes(r.decoded)) for r in out) == sorted((str(i), t or "", enc.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    assert bpe.encode(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_equal_long_texts_and_clashing_columns(spark):
    long = "word 12 " * 400
    rows = [(i, long if i % 2 else long + str(i), i) for i in range(12)]
    docs = spark.createDataFrame(rows, "__row long, text string, k long").repartition(5)
    out = bpe.encode(docs.withColumnRenamed("__row", "cuts"), PATH, P.PATTERN, chunk=300, overlap=40).collect()
    enc = plain()
    assert sorted((r.cuts, r.k, r.ids) for r in out) == sorted((i, k, enc.encode_ordinary(t)) for i, t, k in rows)
