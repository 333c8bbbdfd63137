"""A Spark data source that reads SQLite tables in row ranges."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class RowRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.name, self.columns = options["path"], options["table"], columns
        self.parts = int(options.get("partitions", "8"))

    def _quoted(self, name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    def partitions(self) -> list[RowRange]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self._quoted(self.name)}").fetchone()
        if low is None:
            return [RowRange(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [RowRange(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        wanted = ", ".join(map(self._quoted, self.columns))
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f"SELECT {wanted} FROM {self._quoted(self.name)} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))


class SqliteSource(DataSource):
    """format("sqlite"): options path, table, partitions; the schema has to be given."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self):
        raise ValueError("give the schema of the table")

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options, schema.fieldNames())


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, partitions: int = 8):
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").schema(schema).option("table", table).option("partitions", partitions).load(path)
