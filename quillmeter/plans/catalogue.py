"""The registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archive, money, more, records, tasks, usage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (usage, money, tasks, archive, more, records):
    QUERIES |= _part.Q
    ORACLE_SQL |= _part.SQL
