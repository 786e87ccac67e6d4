"""Sinks that a stream can write twice without harm.

A table lies in Parquet by buckets of its key. A batch is merged with the rows of the
buckets that it touches, the outcome is staged, and only those buckets are overwritten
from there; then the batch's number is recorded. A batch that failed part of the way is
finished from its staged rows when it comes again, and one that is recorded is passed over.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

Merge = Callable[[DataFrame], DataFrame]


def latest(key: str, *order: str) -> Merge:
    """Of each key the row that is last by ``order``."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != key]
        last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
        return last.select(key, "_last.*").select(*rows.columns)

    return merge


@dataclass
class Table:
    """``merge``: old and new rows of some buckets to one row a key. The number of buckets
    is fixed when the table is first written."""

    spark: SparkSession
    path: str
    key: str
    merge: Merge
    schema: str
    buckets: int = 64

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _there(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def rows(self) -> DataFrame:
        if not self._there(f"{self.path}/rows"):
            return self.spark.createDataFrame([], self.schema)
        return self._held().drop("_bucket")

    def _held(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, _bucket int").parquet(f"{self.path}/rows")

    def upsert(self, batch: DataFrame, epoch: int) -> None:
        """For ``foreachBatch``. Touched buckets are as many as ``buckets`` at most."""
        done, staged = f"{self.path}/_epochs/{epoch}", f"{self.path}/_staged/{epoch}"
        if self._there(done):
            return
        if not self._there(f"{staged}/_SUCCESS"):
            new = batch.withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
            both = new
            if self._there(f"{self.path}/rows"):
                touched = [r[0] for r in new.select("_bucket").distinct().collect()]
                both = self._held().filter(F.col("_bucket").isin(touched)).unionByName(new)
            merged = self.merge(both.drop("_bucket")).withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
            merged.write.mode("overwrite").parquet(staged)
        rows = self.spark.read.schema(f"{self.schema}, _bucket int").parquet(staged)
        rows.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.path}/rows")
        fs, at = self._fs(done)
        fs.create(at).close()
        fs, at = self._fs(staged)
        fs.delete(at, True)


def appended(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows that are only added, by the number of their batch, which a
    repeat overwrites."""

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("epoch", F.lit(epoch))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)

    return write
