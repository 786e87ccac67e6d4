"""Running a stream to its end: over files of a folder, as many batches as there are steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from beaconq.session import shared_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def laid_out(rows: DataFrame, part: str, parts: int, name: str) -> str:
    """Write rows to a folder in ``parts`` steps by the number in column ``part``, as a
    source would have received them; gives its path."""
    path = shared_path(rows.sparkSession, name)
    for k in range(parts):
        rows.filter(F.col(part) == k).drop(part).coalesce(1).write.mode("append").parquet(f"{path}/step={k}")
    return path


def stream_of(spark: SparkSession, path: str, schema, files: int | None = 1) -> DataFrame:
    """The folder as a stream that takes ``files`` a batch (None: all there are), the oldest first."""
    reader = spark.readStream.schema(schema).option("latestFirst", "false")
    reader = reader if files is None else reader.option("maxFilesPerTrigger", files)
    return reader.parquet(f"{path}/step=*")


def started(rows: DataFrame, at: str, mode: str = "append") -> StreamingQuery:
    """The stream's result as Parquet below ``at``, with its checkpoint beside; started
    again at the same place it goes on where it stopped."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/rows").format("parquet").trigger(availableNow=True).start()


def waiting(rows: DataFrame, part: str, name: str) -> tuple[str, Callable[[int], None]]:
    """Rows written once, by all tasks, beside an empty folder, and a function that moves a
    step of them into it, whole, as it would arrive; gives the folder and that."""
    spark = rows.sparkSession
    path, aside = shared_path(spark, name), shared_path(spark, f"{name}-aside")
    rows.write.partitionBy(part).parquet(aside)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.Path(path))

    def come(step: int) -> None:
        there, to = hadoop.Path(f"{aside}/{part}={step}"), hadoop.Path(f"{path}/step={step}")
        if not fs.exists(there):
            spark.createDataFrame([], rows.drop(part).schema).write.parquet(to.toString())
        elif not fs.rename(there, to):
            raise OSError(f"step {step} could not be moved to {path}")

    return path, come


def replayed(rows: DataFrame, part: str, parts: int, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What ``build`` makes of the rows as a stream, after all of them have come. A step
    comes when those before it are done and the stream has stopped, and is one batch: the
    order is that of the steps whatever times and names their files have."""
    spark = rows.sparkSession
    source, come = waiting(rows, part, name)
    at = shared_path(spark, f"{name}-out")
    out = build(stream_of(spark, source, rows.drop(part).schema, None))
    for step in range(parts):
        come(step)
        started(out, at).awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/rows")
