"""Operators over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hour_gap(earlier: Column, later: Column) -> Column:
    """Whole hours between two times, truncated toward zero."""
    return F.timestamp_diff("HOUR", earlier, later)


def gap_sessions(rows: DataFrame, key: str, ts: str, tiebreak: str, hours: int) -> DataFrame:
    """rows with session: a new one where the truncated gap to the row before exceeds hours."""
    w = Window.partitionBy(key).orderBy(ts, tiebreak)
    new = F.coalesce((hour_gap(F.lag(ts).over(w), F.col(ts)) > hours).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def adjacent_pairs(rows: DataFrame, key: str, order: list[str], column: str) -> DataFrame:
    following = F.lead(column).over(Window.partitionBy(key).orderBy(*order))
    return rows.select(key, F.col(column).alias("first"), following.alias("second")).filter("second is not null")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, ties broken by the last of order; aggregates map-side."""
    rest = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rows.columns if c != key])


def unanimous(x: str) -> Column:
    """The one value that all rows share, else null."""
    return F.when(F.count_distinct(x) == 1, F.min(x))


def reduce_coverage(x: str) -> Column:
    """complete, partial or unavailable; mixed is partial."""
    return F.when(F.min(x) == F.max(x), F.min(x)).otherwise("partial")


def weighted_jaccard(left: Column, right: Column) -> Column:
    """Sum of least over sum of greatest counts of two token arrays; 0 if either is empty."""
    def n(tokens: Column, t: Column) -> Column:
        return F.size(F.filter(tokens, lambda x: x == t))

    every = F.array_union(left, right)
    low = F.aggregate(every, F.lit(0), lambda a, t: a + F.least(n(left, t), n(right, t)))
    high = F.aggregate(every, F.lit(0), lambda a, t: a + F.greatest(n(left, t), n(right, t)))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(low / high)


def ordered_overlap(needle: Column, haystack: Column) -> Column:
    """Share of needle found in haystack in order, by a greedy walk; 1 for an empty needle."""
    walked = F.aggregate(haystack, F.lit(0), lambda i, x: F.when(F.get(needle, i).eqNullSafe(x) & (i < F.size(needle)), i + 1).otherwise(i))
    return F.when(F.size(needle) == 0, F.lit(1.0)).otherwise(walked / F.size(needle))
