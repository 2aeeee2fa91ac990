"""A Python data source over SQLite files: spark.read.format("sqlite").option("path", ...).option("table", ...).

Each table is split by rowid ranges, so a large one is read by many tasks."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = 100_000
KINDS = {"INTEGER": "bigint", "REAL": "double", "BLOB": "binary"}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with _open(self.options["path"]) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{c[1]}` {KINDS.get((c[2] or '').upper(), 'string')}" for c in columns)

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options["path"], self.options["table"], [f.name for f in schema.fields], [f.dataType.simpleString() for f in schema.fields])


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, names: list[str], kinds: list[str]):
        self.path, self.table, self.names, self.kinds = path, table, names, kinds

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        return [InputPartition(a) for a in range(low, high + 1, ROWS)] if low is not None else []

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        cast = {"bigint": int, "double": float, "binary": lambda v: v if isinstance(v, bytes) else str(v).encode(), "string": str}
        into = [cast[k] for k in self.kinds]
        sql = f"SELECT {', '.join(map(_quoted, self.names))} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?"
        with _open(self.path) as db:
            for row in db.execute(sql, (partition.value, partition.value + ROWS)):
                yield tuple(None if v is None else f(v) for f, v in zip(into, row, strict=True))


def register(spark) -> None:
    spark.dataSource.register(SqliteSource)
