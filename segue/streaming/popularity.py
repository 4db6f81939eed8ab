"""Beyond the batch corpus: track counts kept up to date as slices arrive in a folder.

Slices have no event time, so the counts have no watermark: the state is one row per track.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SLICE


def track_counts(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame (track, count) over slice documents, for output mode update or complete."""
    r = spark.readStream.schema(SLICE).option("multiLine", True)
    r = r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r
    lists = r.json(folder).select(F.explode("playlists").alias("p"))
    return lists.select(F.explode("p.tracks.track_uri").alias("track")).groupBy("track").agg(F.count("*").alias("count"))


def run_available(counts: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Works off what has arrived, and returns the in-memory table of that name."""
    q = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return counts.sparkSession.table(name)
