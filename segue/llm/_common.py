"""Helpers shared by the corpus operators: tables, batches, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import cut, shared_folder  # noqa: F401  used by the operators

#: Rows and bytes of one Arrow batch that a Python worker holds at a time.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts may be long, so rows alone bound nothing. These are settings of the session, read
    when a plan starts, so they stay; a smaller number of rows that is set already is left."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def crc_fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; rows of fold 0 are held out from training."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % 5


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(crc_fold(doc_id) == 0, F.lit(False))


def sample_key(*cols: str) -> Column:
    """A long that depends on the columns only, whatever their types; rows in its order are in random order."""
    return F.xxhash64(F.lit("segue-sample"), *[F.col(c).cast("string") for c in cols])


#: Folds of training rows; not those of crc32, which deals out the held-out rows.
FOLDS = 5


def training_fold(key: Column) -> Column:
    """The fold, 0 to FOLDS - 1, of a sample key: fold 0 calibrates."""
    return F.pmod(F.shiftright(key, 7), F.lit(FOLDS)).cast("int")


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """At most `bound` rows: the first in the order of the key's hash, so the same however the rows are dealt out."""
    n = df.count()
    if n <= bound:
        return df
    h = sample_key(key)
    # The first look keeps somewhat more than the bound, so that few rows are ordered.
    few = df.filter(F.pmod(h, F.lit(1 << 30)) < int(min(1.0, 1.2 * bound / n + 200 / n) * (1 << 30)))
    return few.orderBy(F.pmod(h, F.lit(1 << 30)), key, *[c for c in df.columns if c != key]).limit(bound)


#: Of keys with more rows than a share of 1 / HOT_KEYS of all (and than HOT_ROWS) there are at most HOT_KEYS: small enough to broadcast.
HOT_KEYS, HOT_ROWS = 10_000, 256


def spread_join(big: DataFrame, small: DataFrame, key: str, sizes: DataFrame, total: int, salt: str, how: str = "inner") -> DataFrame:
    """`big` joined with `small` (one row for each key), with the rows of a hot key dealt over several tasks by `salt`.

    sizes (key, c) says how many rows of big (of `total`) a key has; the row of a hot key is copied to each of its parts.
    """
    part = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = F.broadcast(sizes.filter(F.col("c") > part).select(key, F.ceil(F.col("c") / part).cast("int").alias("__parts")))
    n = F.coalesce("__parts", F.lit(1))
    left = big.join(hot, key, "left").withColumn("__part", F.pmod(F.xxhash64(salt), n).cast("int")).drop("__parts")
    right = small.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), n - 1))).drop("__parts")
    # Merged, not broadcast: a table of two keys takes a page of memory in every executor however few rows it has.
    return left.join(right.hint("merge"), [key, "__part"], how).drop("__part")


def sha_hex(c: Column) -> Column:
    return F.sha2(c, 256)
