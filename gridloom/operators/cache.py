"""A cache of transformed samples between runs, for one fingerprint of the pipeline.

A folder has ``header`` (JSON: format, fingerprint, schema), a folder of Parquet files for each write, and ``log``: a row for each chunk that a
write holds, with the write's folder and the chunk's number of samples. A write is listed after its files are published, so what is not in
the log does not count. Misses are found by an anti-join of wanted with listed chunks; only they are computed and written.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 2
_LOG = "chunk_id bigint, samples bigint, folder string"


class StaleCache(ValueError):
    pass


def bare_name(name: str | None) -> bool:
    """Whether a name is that of something in a folder itself: nothing read from a log may lead out of it."""
    return bool(name) and name not in (".", "..") and not set(name) & set("/\\\0")


def bare(name: Column) -> Column:
    """The same of a column of names; a null is no name."""
    return F.coalesce(name.rlike(r"^[^/\\\\\x00]+\z") & ~name.isin(".", ".."), F.lit(False))


def file_name(name: Column) -> Column:
    """A name that any store takes: what is no ASCII letter, digit, dot, underscore or hyphen becomes an underscore. Names that differ may
    become one, so a fingerprint goes with it where they must stay apart."""
    return F.regexp_replace(name, "[^A-Za-z0-9_.-]", "_")


class ChunkCache:
    """Samples (sample_index, value) by chunk below path. Counters: hits, misses, mismatches (listed chunks whose samples are not the listed
    number, or whose folder's name is no bare name) and missing (listed chunks whose folder is gone); both are computed again."""

    def __init__(self, spark: SparkSession, path: str, fingerprint: str, schema: str, *, reset_stale: bool = False):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), f"{schema}, chunk_id bigint"
        self.header = {"format": FORMAT, "pipeline": fingerprint, "schema": schema}
        self.hits = self.misses = self.mismatches = self.missing = 0
        old = self._header()
        if old not in (None, self.header):
            if not reset_stale:
                raise StaleCache(f"{path} belongs to another pipeline; reset it or choose another folder")
            self.clear()
            old = None
        self.found = old is not None
        if old is None:
            spark.createDataFrame([(json.dumps(self.header),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/header")

    def _at(self, name: str = ""):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, name: str) -> bool:
        fs, p = self._at(name)
        return fs.exists(p)

    def _header(self) -> dict | None:
        if not self._exists("header"):
            if self._exists("log"):
                raise StaleCache(f"{self.path} holds chunks but no header; nothing says of which pipeline")
            return None
        rows = self.spark.read.text(f"{self.path}/header").collect()
        try:
            return json.loads(rows[0].value)
        except (IndexError, ValueError) as e:
            raise StaleCache(f"{self.path} has no readable header") from e

    def log(self) -> DataFrame:
        return self.spark.read.schema(_LOG).parquet(f"{self.path}/log") if self._exists("log") else self.spark.createDataFrame([], _LOG)

    def folders(self) -> list[str]:
        """The folders that the log lists, a row a write."""
        return sorted(r.folder for r in self.log().select("folder").distinct().collect() if bare_name(r.folder))

    def stored(self) -> DataFrame:
        """Samples of chunks that are listed, present and whole, with chunk_id; of a chunk that two writes list, those of one."""
        log = self.log()
        present = [f for f in self.folders() if self._exists(f)]
        listed, there = log.count(), log.where(F.col("folder").isin(present))
        rows = None
        for f in present:
            own = self.spark.read.schema(self.schema).parquet(f"{self.path}/{f}").withColumn("folder", F.lit(f))
            rows = own if rows is None else rows.unionAll(own)
        fine = self.spark.createDataFrame([], _LOG) if rows is None else there.join(rows.groupBy("folder", "chunk_id").agg(F.count("*").alias("samples")), ["folder", "chunk_id", "samples"], "left_semi")
        here = there.count()
        self.missing, self.mismatches = listed - here, here - fine.count()
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        one = fine.groupBy("chunk_id").agg(F.min("folder").alias("folder"))
        return rows.join(one, ["chunk_id", "folder"], "left_semi").select("sample_index", "value", "chunk_id")

    def get(self, wanted: DataFrame, compute) -> DataFrame:
        """Samples of the wanted chunks (chunk_id): stored ones, and compute(misses) -> (sample_index, value, chunk_id), which are stored."""
        have = self.stored().select("chunk_id").distinct()
        miss = wanted.join(have, "chunk_id", "left_anti")
        self.misses = miss.count()
        self.hits = wanted.count() - self.misses
        if self.misses:
            folder = f"write-{uuid.uuid4().hex}"
            compute(miss).select("sample_index", "value", "chunk_id").write.parquet(f"{self.path}/{folder}")
            done = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").groupBy("chunk_id").agg(F.count("*").alias("samples"))
            done.withColumn("folder", F.lit(folder)).write.mode("append").parquet(f"{self.path}/log")
        seen = self.mismatches, self.missing
        out = self.stored().join(wanted.select("chunk_id"), "chunk_id", "left_semi")
        self.mismatches, self.missing = seen
        return out

    def clear(self) -> None:
        """Removes the header, the log and the folders that it lists, and nothing else that lies in the folder."""
        for name in (*self.folders(), "log", "header"):
            fs, p = self._at(name)
            fs.delete(p, True)


def coverage(planned: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """planned with hit: whether a chunk is stored."""
    own = stored.select(*keys).distinct().withColumn("hit", F.lit(True))
    return planned.join(own, keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
