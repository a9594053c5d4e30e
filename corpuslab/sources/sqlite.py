"""SQLite files as a data source: a partition for each table, and lookups that read the one table a key lies in."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Words of so many syllables or more share the tables of an initial.
LONG = 8


class Table(InputPartition):
    def __init__(self, name: str) -> None:
        super().__init__(name)
        self.name = name


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.tables, self.key = options["path"], options.get("tables", "*"), options.get("key")
        self.columns = schema.names

    def _open(self) -> closing[sqlite3.Connection]:
        return closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True))

    def partitions(self) -> list[Table]:
        with self._open() as c:
            found = c.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name GLOB ? ORDER BY name", (self.tables,)).fetchall()
        return [Table(n) for (n,) in found] or [Table("")]

    def read(self, partition: Table) -> Iterator[tuple]:
        if not partition.name:
            return
        sql, of = f"SELECT {', '.join(map(_quoted, self.columns))} FROM {_quoted(partition.name)}", ()
        if self.key is not None:
            sql, of = sql + " WHERE key = ? OR key LIKE ? || '%'", (self.key, self.key)
        with self._open() as c:
            yield from c.execute(sql, of)


class SqliteTables(DataSource):
    """``spark.read.format("sqlite_tables").schema(...).option("path", file)``, with ``tables`` a glob of names and
    ``key`` a key to look up. The file lies where driver and executors see it; columns are those of the schema."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_tables"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


def sqlite_tables(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    spark.dataSource.register(SqliteTables)
    return spark.read.format("sqlite_tables").schema(schema).options(path=path, **options).load()


def table_of(key: str) -> str:
    """The table of a key of two letters a syllable: by number of syllables and initial."""
    n = len(key) // 2
    return f"tbl_{n if n < LONG else 'others'}_{key[0]}"


def look_up_in_sqlite(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, jp, value, weight) of a key and of those in its table that begin with it; none without the table."""
    return sqlite_tables(spark, path, "key string, jp string, value string, weight long", tables=table_of(key), key=key)
