"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from beaconq.session import shared_path

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
HASHES = 1 << 32
#: Bound of what a training sample may bring to the driver, give or take few percent.
MOST_BYTES = 96 << 20


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a finished write are deleted at once, as what it
    wrote stands in for them."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that what follows
    does not depend on files that go with an executor, nor computes it twice."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with freed_shuffles(spark):
        df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.shared_path = path
    return written


def discard(*written: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing that is still to run reads it."""
    for df in written:
        delete_path(df.sparkSession, df.shared_path)


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def map_batches(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``rows.mapInArrow`` where ``run`` yields columns by name. Columns are passed on as
    Arrow arrays, so a long beside a null stays a long, which in pandas it does not."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(batches):
            yield pa.RecordBatch.from_pydict(columns, schema=kinds)

    return rows.mapInArrow(work, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: str | Column, parts: int) -> Column:
    """crc32 of an id written as text, modulo ``parts``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % parts, F.lit(0))


def hash_share(rows: DataFrame, most: int) -> DataFrame:
    """A bounded sample of rows with a doc_id: all of them, or where they are more than
    ``most`` those in a share of the hash range that holds ``most`` of them, give or
    take few percent. The same rows are taken however the table is partitioned, and
    nothing is sorted or brought together for it."""
    n = rows.count()
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)) < HASHES * most // n)


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: tuple[int, int]) -> DataFrame:
    """(doc_id, text, label): documents outside the held-out fold with label 0 or 1, at
    most about ``most`` of each. Null, other and held-out labels are left out; an id
    with both labels counts as 1, and of an id's texts the least is taken. At most that
    many ids are broadcast; the sample is written, so that texts are read once."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & (fold("doc_id", 3) != 1) & F.col("doc_id").isNotNull()
    )
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").alias("label"))
    picked = [hash_share(known.filter(F.col("label") == k), most[k]) for k in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    return materialize(found.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "labelled")


def within_bytes(sample: DataFrame, size: Column, most: int = MOST_BYTES) -> DataFrame:
    """A sample of rows with a doc_id, written, of at most about ``most`` bytes by ``size``:
    where there are more, the rows in a share of the hash range."""
    written = materialize(sample, "sample")
    total = written.agg(F.sum(size.cast("long"))).first()[0] or 0
    return written if total <= most else written.filter(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(HASHES)) < HASHES * most // total)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, most: int = 1000, total: int | None = None) -> DataFrame:
    """Inner-join ``rows`` to ``groups`` (one row for each key, with the key's
    number of rows in ``size``) without sending a hot key to one task.

    Keys with over 1/``most`` of all rows are fewer than ``most`` by counting, so
    their groups are broadcast whatever the input is; all other keys are shuffled.
    ``total``: the number of all rows, if it is known.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0 if total is None else total
    least = max(total // most, 1000)
    hot = groups.filter(F.col(size) > least).drop(size)
    cold = groups.filter(F.col(size) <= least).drop(size)
    marked = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return marked.unionByName(rest)
