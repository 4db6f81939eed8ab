"""Slice and challenge documents (JSON files), as interactions, playlists and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.corpus import Corpus, first_meta
from ..schema import CHALLENGE, META, SLICE


def list_slices(spark: SparkSession, folder: str, max_slices: int | None = None) -> list[str]:
    """Paths of mpd.slice.*.json, or else of *.json, by name; read through Hadoop, so any store works."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = [s.getPath() for s in path.getFileSystem(conf).listStatus(path) if s.isFile()]
    names = sorted((p.getName(), p.toString()) for p in found if p.getName().endswith(".json"))
    chosen = [p for n, p in names if n.startswith("mpd.slice.")] or [p for _, p in names]
    if not chosen:
        raise FileNotFoundError(f"no slice files in {folder}")
    return chosen[:max_slices]


def read_documents(spark: SparkSession, paths: list[str], schema=SLICE, multi_line: bool = True) -> DataFrame:
    """One document a file, or (not multi_line) one a line."""
    return spark.read.schema(schema).json(paths, multiLine=multi_line)


def lists_of(documents: DataFrame, max_playlists: int | None = None) -> DataFrame:
    """A row for each list: pid, name, tracks; the first max_playlists by pid."""
    lists = documents.select(F.explode("playlists").alias("p")).select("p.pid", F.coalesce("p.name", F.lit("")).alias("title"), "p.tracks")
    return lists.orderBy("pid").limit(max_playlists) if max_playlists is not None else lists


def corpus_of(lists: DataFrame) -> Corpus:
    """Missing strings become empty; a track's metadata is that of its first occurrence."""
    rows = lists.select("pid", F.posexplode("tracks").alias("pos", "t")).select("pid", F.col("pos").cast("long").alias("pos"), *[F.coalesce(f"t.{c}", F.lit("")).alias(c) for c in META])
    rows = rows.withColumnRenamed("track_uri", "track")
    meta = first_meta(rows, ["pid", "pos"], [c for c in META if c != "track_uri"]).withColumn("artist", F.col("artist_uri"))
    return Corpus(rows.select("pid", "pos", "track"), lists.select("pid", "title"), meta)


def load(spark: SparkSession, folder: str, max_slices: int | None = None, max_playlists: int | None = None, multi_line: bool = True) -> Corpus:
    return corpus_of(lists_of(read_documents(spark, list_slices(spark, folder, max_slices), multi_line=multi_line), max_playlists))


def read_challenge(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """pid, title (null if there is none), num_samples, num_holdouts, tracks (array of uri in order)."""
    p = read_documents(spark, [path], CHALLENGE, multi_line).select(F.explode("playlists").alias("p"))
    uris = F.coalesce(F.transform("p.tracks", lambda t: t["track_uri"]), F.array().cast("array<string>"))
    return p.select("p.pid", F.col("p.name").alias("title"), "p.num_samples", "p.num_holdouts", uris.alias("tracks"))


def write(corpus: Corpus, path: str) -> None:
    """The corpus as slice documents, a line and a document for each list (read with multi_line=False)."""
    meta = corpus.tracks
    has = lambda c: F.col(c).cast("string") if c in meta.columns else F.lit("")
    t = meta.select("track", *[has(c).alias(c) for c in META if c not in ("track_uri", "artist_uri")], (has("artist_uri") if "artist_uri" in meta.columns else F.col("artist").cast("string")).alias("artist_uri"))
    rows = corpus.interactions.join(t, "track")
    one = F.struct("pos", *[F.col(c) if c != "track_uri" else F.col("track").cast("string").alias("track_uri") for c in META])
    lists = rows.groupBy("pid").agg(F.array_sort(F.collect_list(one)).alias("tracks")).join(corpus.playlists, "pid", "left")
    doc = F.struct(F.col("title").alias("name"), "pid", F.size("tracks").alias("num_tracks"), "tracks")
    lists.select(F.array(doc).alias("playlists")).write.mode("overwrite").json(path)
