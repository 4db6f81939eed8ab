"""Slices straight from a zip archive: a Python data source with one partition for each member.

The driver lists the members; executors seek their own. The archive must be in a folder that the
driver and the executors share.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.corpus import Corpus
from ..schema import SLICE
from .slices import corpus_of, lists_of

_NUMBERS = re.compile(r"(\d+)-(\d+)\.json$")


def members(path: str, max_slices: int | None = None) -> list[str]:
    """JSON members by the first pid in their names, those without one last and by name."""
    with zipfile.ZipFile(path) as z:
        names = [n for n in z.namelist() if n.endswith(".json") and "challenge_set" not in n]
    sliced = [n for n in names if "mpd.slice." in n] or names
    start = lambda n: (0, int(m[1]), n) if (m := _NUMBERS.search(n)) else (1, 0, n)
    return sorted(sliced, key=start)[:max_slices]


class _Member(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.only = options["path"], options.get("member")
        self.most = int(options["max_slices"]) if options.get("max_slices") else None

    def partitions(self) -> list[_Member]:
        return [_Member(n) for n in ([self.only] if self.only else members(self.path, self.most))]

    def read(self, part: _Member) -> Iterator[tuple]:
        with zipfile.ZipFile(self.path) as z, z.open(part.name) as f:
            yield part.name, f.read().decode()


class ZipSlices(DataSource):
    """Rows (member, document) of `format("zip_slices").option("path", ..)`."""

    @classmethod
    def name(cls) -> str:
        return "zip_slices"

    def schema(self) -> str:
        return "member string, document string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_documents(spark: SparkSession, path: str, max_slices: int | None = None, schema=SLICE, member: str | None = None) -> DataFrame:
    spark.dataSource.register(ZipSlices)
    r = spark.read.format("zip_slices").option("path", path)
    r = r.option("max_slices", str(max_slices)) if max_slices else r
    r = r.option("member", member) if member else r
    return r.load().select(F.from_json("document", schema).alias("d")).select("d.*")


def load(spark: SparkSession, path: str, max_slices: int | None = None, max_playlists: int | None = None) -> Corpus:
    return corpus_of(lists_of(read_documents(spark, path, max_slices), max_playlists))


def read_challenge(spark: SparkSession, path: str) -> DataFrame:
    """The challenge member of an archive, as slices.read_challenge gives it."""
    from ..schema import CHALLENGE

    with zipfile.ZipFile(path) as z:
        name = next((n for n in z.namelist() if n.endswith("challenge_set.json")), None)
    if name is None:
        raise FileNotFoundError(f"no challenge_set.json in {path}")
    p = read_documents(spark, path, schema=CHALLENGE, member=name).select(F.explode("playlists").alias("p"))
    uris = F.coalesce(F.transform("p.tracks", lambda t: t["track_uri"]), F.array().cast("array<string>"))
    return p.select("p.pid", F.col("p.name").alias("title"), "p.num_samples", "p.num_holdouts", uris.alias("tracks"))


