"""Deduplication where null is a wildcard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def wildcard(rows: DataFrame, keys: list[str], arrival: str, value: str) -> DataFrame:
    """rows reduced to those kept, in arrival order: a row that matches a kept row of its keys (equal values, or
    one of them null) is merged into the first such row, which takes over a value it lacked.

    Equality with wildcards isn't transitive, but its outcome needs no walk over the rows: until the first
    known value everything merges into the first row, which then has that value; after that each further value
    has its own first row, and nulls merge into the first row of all. So two window columns decide."""
    w = Window.partitionBy(*keys)
    first = F.min(arrival).over(w)
    known = F.min(F.when(F.col(value).isNotNull(), F.struct(arrival, value))).over(w)[value]
    of_value = F.min(arrival).over(Window.partitionBy(*keys, value))
    marked = rows.select(*keys, arrival, value, first.alias("_first"), known.alias("_known"), of_value.alias("_own"))
    target = F.when(F.col(value).isNull() | (F.col(value) == F.col("_known")), F.col("_first")).otherwise(F.col("_own"))
    kept = marked.withColumn("_target", target).groupBy(*keys, "_target").agg(F.max(F.when(F.col(value).isNotNull(), F.col(value))).alias(value), F.count("*").alias("n_merged"))
    return kept.withColumnRenamed("_target", arrival)
