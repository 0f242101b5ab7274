"""Shared helpers of the corpus operators: tables, shared scratch tables, Arrow batch output."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Output batches of the Arrow operators are cut at this many payload bytes, so that one batch
#: stays small however long single texts are.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local session (tests) gets a temporary folder; on a cluster, whose
    executors would write where nobody else reads, that is an error.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="ctxspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/ctxspark-{name}-{uuid.uuid4().hex}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, where the session has not asked for other ones.

    Whole texts go to Python workers; the default of 10,000 rows makes batches of many MB in the
    executor and in the worker at once.
    """
    key, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, str(rows))


def one_of_each(rows: DataFrame, *keys: str, text_col: str = "t") -> DataFrame:
    """Of the rows of each key the text of the lowest hash, so that keys that occur often bring no more than one."""
    t = F.col(text_col)
    return rows.groupBy(*keys).agg(F.min_by(t, F.struct(F.xxhash64(t), t)).alias(text_col))


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Row tuples of the named columns, one batch converted in slices so that few texts are held twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            yield from zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


class Batcher:
    """Collects output rows and hands out Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, max_bytes: int = BATCH_BYTES, max_rows: int = 2000):
        self.schema, self.max_bytes, self.max_rows = schema, max_bytes, max_rows
        self.columns: list[list] = [[] for _ in schema]
        self.size = 0

    def add(self, row: tuple, size: int = 64) -> bool:
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)
        self.size += size
        return self.size >= self.max_bytes or len(self.columns[0]) >= self.max_rows

    def flush(self) -> pa.RecordBatch:
        arrays = [pa.array(c, type=f.type) for c, f in zip(self.columns, self.schema, strict=True)]
        self.columns, self.size = [[] for _ in self.schema], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)

    def __bool__(self) -> bool:
        return bool(self.columns[0])
