"""SQLite tables as a Spark data source: read by ranges of row ids, one range a task."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, parts: int):
        self.path, self.table, self.schema, self.parts = path, table, schema, parts

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, -1)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(k, min(k + step - 1, high)) for k in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        low, high = partition.value
        with self._open() as db:
            known = {r[1] for r in db.execute(f'PRAGMA table_info("{self.table}")')}
            # columns that a table of an older version lacks are null
            names = ", ".join(f'"{f.name}"' if f.name in known else f'NULL AS "{f.name}"' for f in self.schema)
            yield from db.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (low, high))


class SqliteSource(DataSource):
    """Options: path, table, partitions."""

    @classmethod
    def name(cls) -> str:
        return "ctxspark_sqlite"

    def schema(self) -> StructType:
        kinds = {"INT": LongType(), "REA": DoubleType(), "DOU": DoubleType(), "FLO": DoubleType()}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            rows = db.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        return StructType([StructField(r[1], kinds.get((r[2] or "")[:3].upper(), StringType())) for r in rows])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options["path"], self.options["table"], schema, int(self.options.get("partitions", 8)))


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str | StructType | None = None, partitions: int = 8):
    """A table's rows; with a schema, its columns only, null where the table lacks them."""
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("ctxspark_sqlite").option("path", path).option("table", table).option("partitions", partitions)
    return (reader.schema(schema) if schema is not None else reader).load()


SESSIONS = "id string, source string, started_at double, ended_at double, message_count bigint, tool_call_count bigint, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, reasoning_tokens bigint, estimated_cost_usd double, api_call_count bigint, archived bigint, system_prompt string"
MESSAGES = "id bigint, session_id string, role string, content string, tool_name string, reasoning string, timestamp double, active bigint"
