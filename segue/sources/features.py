"""Track features: axis CSV, audio parquet, and the mapping of audio columns to axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import AUDIO, AXES, NEUTRAL


def read_axis_csv(spark: SparkSession, path: str) -> DataFrame:
    """track, axes of a CSV with track_uri and any axis columns by name; blank or missing: the axis's neutral value.

    A header read gives the columns; of a uri's rows the last one counts, by its place in the file.
    """
    header = spark.read.option("header", True).csv(path).columns
    rows = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).option("header", True).csv(path)
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    values = [_number(a, header) for a in AXES]
    picked = rows.select(F.col("track_uri").alias("track"), F.array(*values).alias("axes"), at.alias("at"))
    return picked.groupBy("track").agg(F.max_by("axes", "at").alias("axes"))


def _number(axis: str, header: list[str]) -> Column:
    own = F.expr(f"try_cast(nullif(trim(`{axis}`), '') as double)") if axis in header else F.lit(None).cast("double")
    return F.coalesce(own, F.lit(NEUTRAL[axis]))


def read_audio(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(AUDIO).option("recursiveFileLookup", True).parquet(folder)


def needed_audio(audio: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the ids (id) asked for; of repeated ids the first in a total order."""
    w = W.partitionBy("id").orderBy("tempo", "energy", "valence", "acousticness", "instrumentalness")
    return audio.join(ids, "id", "left_semi").withColumn("__r", F.row_number().over(w)).filter(F.col("__r") == 1).drop("__r")


def _clipped(c: Column) -> Column:
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def axes_of_audio() -> Column:
    """15 axes: tempo over 30..250, others as they are, lyrical depth against instrumentalness; missing: 0.5; genres 0."""
    scalars = [_clipped((F.col("tempo") - 30) / 220), _clipped(F.col("energy")), _clipped(F.col("valence")), _clipped(F.col("acousticness")), _clipped(1 - F.col("instrumentalness"))]
    return F.array(*scalars, *[F.lit(0.0)] * (len(AXES) - 5))


def track_id(uri: Column) -> Column:
    return F.substring_index(uri, ":", -1)


def attach_audio(tracks: DataFrame, audio: DataFrame) -> DataFrame:
    """track, axes of tracks (track: uri) that the audio table has."""
    ids = tracks.select("track", track_id(F.col("track")).alias("id"))
    return ids.join(needed_audio(audio, ids.select("id").distinct()).select("id", axes_of_audio().alias("axes")), "id").select("track", "axes")


def matched(tracks: DataFrame, features: DataFrame) -> DataFrame:
    """n_tracks, n_matched, rate."""
    f = features.select("track").distinct().withColumn("__m", F.lit(1))
    return tracks.select("track").join(f, "track", "left").agg(F.count("*").alias("n_tracks"), F.count("__m").alias("n_matched"), F.round(F.coalesce(F.avg(F.coalesce("__m", F.lit(0))), F.lit(0.0)), 6).alias("rate"))
