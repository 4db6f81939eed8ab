"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

1. toxicity: documents predicted toxic go; 2. near-duplicates: one document of each group stays, groups being linked by
an exact similarity of five-word shingles of 0.8 or more, with candidates from the SimHash operator and, for what its
bits cannot tell, from min-hash bands; 3. decontamination: documents that hold a benchmark window go; 4. PII: entities
are replaced by surrogates; 5. byte-level BPE: texts are encoded, and the texts returned are decoded from the ids.
All stages but the last return the columns of documents. Null and empty texts, null ids, repeated rows and further
columns pass as each operator defines; a column whose name clashes with one that an operator makes is kept by stages
that do not make it. Texts of any length and groups of any size pass whole; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segue.functions.tables import remove_folder, shared_folder
from segue.llm import bpe, decontaminate, pii, similar, toxicity
from segue.llm._common import table
from segue.llm.queries import PII_KEY, VOCABULARY


def _columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{n}`") for n in names])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    # Scored beside the row: the operator's columns may clash with the row's own.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return toxicity.score(own, model).filter(F.col("predicted") == 0).select("row.*")


#: Shingles of five words, and the similarity from which texts are near-copies.
WIDTH, SIMILARITY = 5, 0.8


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs, WIDTH, SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The text decides alone, so its hash is the key: ids may be null or repeated.
    keyed = docs.select(F.sha2("text", 256).alias("doc_id"), "text")
    hit = decontaminate.find(keyed, table(spark, sf_dir, "benchmark")).filter(F.size("spans") > 0).select(F.col("doc_id").alias("__sha")).distinct()
    return _columns(docs.withColumn("__sha", F.sha2("text", 256)).join(hit, "__sha", "left_anti"), docs.columns)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(docs, PII_KEY)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return _columns(done, docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path, pattern = P.path(VOCABULARY), P.PATTERN
    back = bpe.decode(bpe.encode(docs, path, pattern), path)
    names = [c for c in docs.columns if c not in ("ids", "decoded", "n_tokens")]
    text = F.when(F.col("text").isNotNull(), F.col("decoded").cast("string")).alias("text")
    return back.select(*[text if c == "text" else F.col(f"`{c}`") for c in names], F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_pii),
    ("byte-level bpe", encode),
]

#: Trained models and hashes of 64 bits keep SQL from expressing the stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}.parquet")
        docs = spark.read.parquet(f"{folder}/{k}.parquet")
        if k:  # what the stage before wrote has been read
            remove_folder(spark, f"{folder}/{k - 1}.parquet")
    return docs
