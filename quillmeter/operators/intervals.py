"""Validity intervals: half-open [start, end), a null end is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains(ts: Column, start: Column, end: Column) -> Column:
    return (ts >= start) & (end.isNull() | (ts < end))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (b_end.isNull() | (a_start < b_end)) & (a_end.isNull() | (b_start < a_end))


def running_sums(rows: DataFrame, key: str, order: list[str], bucket: Column, values: dict[str, str]) -> DataFrame:
    """rows with running sums (values: new name -> column) by key in the given order, in two levels.

    Buckets (a day, say, that the order never leaves and returns to) are summed apart and their totals
    carried forward, so that a hot key is as many tasks as it has buckets. A null key is a key, a null bucket the
    first one of its key."""
    rows = rows.withColumn("_bucket", bucket)
    totals = rows.groupBy(key, "_bucket").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in values.items()])
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in values]
    totals = totals.select(F.col(key).alias("_of"), F.col("_bucket").alias("_in"), *carried)
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(totals, rows[key].eqNullSafe(totals["_of"]) & rows["_bucket"].eqNullSafe(totals["_in"]))
    for n, c in values.items():
        out = out.withColumn(n, F.col(f"_b_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("_bucket", "_of", "_in", *[f"_b_{n}" for n in values])


def range_totals(intervals: DataFrame, events: DataFrame, key: str, values: list[str]) -> DataFrame:
    """For each interval (key, id, start, end) the number of events (key, ts, values...) in [start, end) and the
    values' sums: differences of running sums at its two ends, so no pair of interval and event is ever made.
    Intervals without a key or start hold nothing; events without a key or time lie in none. Ids are not null."""
    kept = F.col(key).isNotNull() & F.col("start").isNotNull()
    nothing = intervals.filter(~kept).select("id", F.lit(0).cast("long").alias("n"), *[F.lit(0).cast("long").alias(v) for v in values])
    intervals, events = intervals.filter(kept), events.filter(F.col(key).isNotNull() & F.col("ts").isNotNull())
    far = F.to_timestamp_ntz(F.lit("9999-12-31 00:00:00"))
    zero = [F.lit(0).cast("long").alias(v) for v in values]
    points = intervals.select(key, F.explode(F.array(F.struct(F.col("start").alias("ts"), F.lit(-1).alias("sign")), F.struct(F.coalesce("end", far).alias("ts"), F.lit(1).alias("sign")))).alias("p"), "id")
    ends = points.select(key, F.col("p.ts").alias("ts"), F.lit(0).alias("kind"), "id", F.col("p.sign").alias("sign"), *zero, F.lit(0).cast("long").alias("one"))
    own = events.select(key, "ts", F.lit(1).alias("kind"), F.lit(None).cast(intervals.schema["id"].dataType).alias("id"), F.lit(0).alias("sign"), *[F.coalesce(F.col(v), F.lit(0)).cast("long").alias(v) for v in values], F.lit(1).cast("long").alias("one"))
    summed = running_sums(ends.unionByName(own), key, ["ts", "kind"], F.to_date("ts"), {"n_run": "one", **{f"{v}_run": v for v in values}})
    at_ends = summed.filter("kind = 0")
    differences = [F.sum(F.col(f"{v}_run") * F.col("sign")).alias(v) for v in values]
    found = at_ends.groupBy("id").agg(F.sum(F.col("n_run") * F.col("sign")).alias("n"), *differences)
    return found.unionByName(nothing)


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, start: str, carried: list[str]) -> DataFrame:
    """left with the columns carried of the latest right row of its key that starts at or before ts.

    One pass over both in time order, by key and day, with the last value of earlier days carried in.
    Rows of left without key or time come back with nulls; rows of right without them are never met."""
    known = F.col(key).isNotNull() & F.col(ts).isNotNull()
    apart = left.filter(~known).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in [start, *carried]])
    left, right = left.filter(known), right.filter(F.col(key).isNotNull() & F.col(start).isNotNull())
    last = [F.struct(start, *carried).alias("_r"), F.lit(0).alias("_kind")]
    r = right.select(key, F.col(start).alias("_ts"), *last)
    names = left.columns
    l = left.select(key, F.col(ts).alias("_ts"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.lit(1).alias("_kind"), F.struct(*names).alias("_l"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_day", F.to_date("_ts"))
    days = both.groupBy(key, "_day").agg(F.max(F.when(F.col("_kind") == 0, F.struct("_ts", "_r"))).alias("_m"))
    before = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(key, "_day", F.last("_m", ignorenulls=True).over(before).alias("_before"))
    inside = Window.partitionBy(key, "_day").orderBy("_ts", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    out = both.join(days, [key, "_day"]).withColumn("_at", F.coalesce(F.last("_r", ignorenulls=True).over(inside), F.col("_before._r")))
    met = out.filter("_kind = 1").select("_l.*", *[F.col(f"_at.{c}").alias(c) for c in [start, *carried]])
    return met.unionByName(apart)


def merge_overlapping(ranges: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key, start, end of the unions of touching or overlapping ranges (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = ranges.withColumn("_new", (reach.isNull() | (F.col(start) > reach)).cast("int"))
    numbered = flagged.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_ranges")).drop("_island")


def covered_days(intervals: DataFrame, start: str, end: str) -> DataFrame:
    return intervals.select(F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias("day")).distinct()
