"""A table of stored responses as a data source of its own.

Captures lie in Parquet files below ``engine_id=<id>/page=<n>/``, as ``write`` leaves them.
The source makes a partition of the files of an engine and page, or of ``TASK_BYTES`` of them. Filters on engine and page are taken over, so
files of other engines and pages are never opened; filters on whether a body is there, on
status and on duration skip row groups by their statistics. Columns that are not asked for
are not read, as ``columns`` names those to read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, IsNotNull
from pyspark.sql.types import ArrayType, IntegerType, LongType, MapType, StringType, StructField, StructType

from beaconq.session import BATCH_BYTES, bound_batches

#: The fields of ``responses.RESPONSES``, as types, which workers without a session need.
FIELDS = StructType(
    [
        StructField("request_id", StringType()), StructField("engine_id", StringType()), StructField("page", IntegerType()), StructField("status", IntegerType()),
        StructField("headers", MapType(StringType(), StringType())), StructField("body", StringType()), StructField("final_url", StringType()),
        StructField("locations", ArrayType(StringType())), StructField("duration_ms", LongType()),
    ]
)
NAME = "stored-responses"
#: What a worker holds at a time, besides about ``BATCH_BYTES`` of rows: at most so many rows, and a read-ahead.
BATCH_ROWS, BUFFER_BYTES = 10_000, 1 << 20
#: Small files are read by one task up to so many bytes.
TASK_BYTES = 8 << 20
PLACE = re.compile(r"(?:^|/)engine_id=([^/]+)/page=(\d+)/[^/]+\.parquet$")


def write(responses: DataFrame, path: str) -> None:
    """Add responses to the table at ``path``, by engine and page. Bodies are long: a page of
    the file ends at its size, not at 100 rows, as a reader holds one whole, and none stands
    for many rows, so that sizes in the file are those of the rows."""
    writer = responses.write.mode("append").partitionBy("engine_id", "page")
    writer.option("parquet.page.size.row.check.min", 1).option("parquet.enable.dictionary#body", "false").parquet(path)


def load(spark: SparkSession, path: str, where: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """The rows of the table at ``path`` that ``where`` allows; what it says of engine_id
    and page is pushed to the source, as is what later filters say.

    Load the table anew for each use: Spark keeps what was pushed with the loaded table,
    so two differently filtered uses of one loaded table in one query see the same files.
    (A filter that holds for all rows makes Spark push anew for each query, at least.)
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    bound_batches(spark)
    spark.dataSource.register(StoredResponses)
    reader = spark.read.format(NAME)
    if columns:
        reader = reader.option("columns", ",".join(columns))
    rows = reader.load(path).filter("page IS NOT NULL")
    return rows.filter(where) if where else rows


@dataclass
class Files(InputPartition):
    """Files of one engine and page, read one after another by a task."""

    paths: list[str]
    engine_id: str
    page: int


class StoredResponses(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        asked = self.options.get("columns")
        return StructType([f for f in FIELDS if not asked or f.name in (*asked.split(","), "engine_id", "page")])

    def reader(self, schema: StructType) -> "Reader":
        return Reader(self.options["path"], [f.name for f in schema.fields])


class Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns = path, columns
        self.engines: set[str] | None = None
        self.pages: set[int] | None = None
        self.within: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take over what says which engines and pages; use the rest to skip row groups."""
        for f in filters:
            if not isinstance(f, (EqualTo, In, GreaterThanOrEqual, IsNotNull)) or len(f.attribute) != 1:
                yield f
                continue
            name = f.attribute[0]
            if isinstance(f, IsNotNull):
                if name not in ("engine_id", "page"):
                    yield f
            elif isinstance(f, (EqualTo, In)) and name in ("engine_id", "page"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                held = self.engines if name == "engine_id" else self.pages
                values = values if held is None else held & values
                if name == "engine_id":
                    self.engines = values
                else:
                    self.pages = values
            else:
                if name in ("status", "duration_ms") and isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    self.within.append((name, "=" if isinstance(f, EqualTo) else ">=", f.value))
                yield f

    def partitions(self) -> list[Files]:
        """The files of the engines and pages that are asked for; other folders are not listed."""
        from pyarrow import fs

        at, root = fs.FileSystem.from_uri(self.path)
        folders = at.get_file_info(fs.FileSelector(root, allow_not_found=True))
        found = []
        for engine in sorted(folders, key=lambda x: x.path):
            name = engine.base_name.removeprefix("engine_id=")
            if engine.type != fs.FileType.Directory or not engine.base_name.startswith("engine_id=") or self.engines is not None and name not in self.engines:
                continue
            size = 0
            for f in sorted(at.get_file_info(fs.FileSelector(engine.path, recursive=True)), key=lambda x: x.path):
                m = PLACE.search(f.path)
                if m and (self.pages is None or int(m[2]) in self.pages):
                    same = found and (found[-1].engine_id, found[-1].page) == (name, int(m[2]))
                    if not same or size + f.size > TASK_BYTES:
                        found.append(Files([], name, int(m[2])))
                        size = 0
                    found[-1].paths.append(f.path)
                    size += f.size
        return found or [Files([], "", 0)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        at, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            yield from self._read(at, path, partition)

    def _read(self, at, path: str, partition: Files) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        given = {"engine_id": pa.scalar(partition.engine_id, pa.string()), "page": pa.scalar(partition.page, pa.int32())}
        file = pq.ParquetFile(at.open_input_file(path), buffer_size=BUFFER_BYTES)
        groups = [k for k in range(file.num_row_groups) if not self._missed(file.metadata.row_group(k))]
        size = sum(file.metadata.row_group(k).total_byte_size for k in groups) / max(1, sum(file.metadata.row_group(k).num_rows for k in groups))
        rows = int(max(1, min(BATCH_ROWS, BATCH_BYTES // max(1, size))))
        for batch in file.iter_batches(rows, row_groups=groups, columns=[c for c in self.columns if c not in given]):
            columns = [pa.repeat(given[c], batch.num_rows) if c in given else batch[c] for c in self.columns]
            yield pa.RecordBatch.from_arrays(columns, names=self.columns)

    def _missed(self, group) -> bool:
        """Whether statistics say that no row of the group is wanted."""
        for k in range(group.num_columns):
            column = group.column(k)
            for name, sign, value in self.within:
                if column.path_in_schema == name and column.statistics is not None and column.statistics.has_min_max:
                    low, high = column.statistics.min, column.statistics.max
                    if high < value or sign == "=" and low > value:
                        return True
        return False
