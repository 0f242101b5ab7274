"""Tables in the folder that driver and executors share: where iterations cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session without one gets a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="ctxspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables of one computation, each written once and read back; ``drop`` deletes those that are not read any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def _at(self, path: str):
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jpath

    def path(self) -> str:
        """A fresh path, deleted when the driver's JVM ends."""
        path = f"{shared_dir(self.spark)}/ctxspark-{self.name}-{uuid.uuid4().hex}"
        files, jpath = self._at(path)
        files.deleteOnExit(jpath)
        return path

    def written(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path, out
        return out

    def dealt(self, df: DataFrame, *by: str) -> DataFrame:
        """Like ``written``, in buckets of the values of ``by``: joins and groups by these don't shuffle its rows again."""
        path, name = self.path(), f"ctxspark_{self.name}_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(n, *by).write.format("parquet").bucketBy(n, *by).sortBy(*by).option("path", path).option("compression", "zstd").saveAsTable(name)
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # its name alone, the files are outside of the warehouse
        self.paths[id(out)] = path, out
        return out

    def drop(self, df: DataFrame | None) -> None:
        path, _ = self.paths.pop(id(df), (None, None))
        if path:
            files, jpath = self._at(path)
            files.delete(jpath, True)


def group_key(column: Column) -> Column:
    """A key that is never null, for joins."""
    return F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), column.cast("string")))
