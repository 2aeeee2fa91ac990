"""Which commit an edit went into."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequences import ordered_overlap

MIN_LINES, MAX_DAYS, HIGH_DAYS, MEDIUM = 3, 30, 7, 0.8


def match(edits: DataFrame, changes: DataFrame) -> DataFrame:
    """edit_id, commit_id, confidence of edits (edit_id, path, at, lines) and changes (commit_id, path, at, lines).

    An edit of MIN_LINES distinct lines or more goes to the commit of its path within MAX_DAYS after it with the
    highest confidence and overlap; if two commits tie, to none."""
    usable = edits.filter(F.size(F.array_distinct("lines")) >= MIN_LINES)
    a, b = usable.withColumnRenamed("lines", "needle").withColumnRenamed("at", "edited"), changes.withColumnRenamed("lines", "hay").withColumnRenamed("at", "committed")
    met = a.join(b, "path").filter(F.col("committed").between(F.col("edited"), F.col("edited") + F.expr(f"INTERVAL {MAX_DAYS} DAY")))
    met = met.withColumn("overlap", F.round(ordered_overlap(F.col("needle"), F.col("hay")), 9))
    high = (F.col("overlap") >= 1.0) & (F.col("committed") <= F.col("edited") + F.expr(f"INTERVAL {HIGH_DAYS} DAY"))
    ranked = met.withColumn("rank", F.when(high, 2).when(F.col("overlap") >= MEDIUM, 1).otherwise(0)).filter("rank > 0")
    w = Window.partitionBy("edit_id")
    best = ranked.withColumn("top", F.max(F.struct("rank", "overlap")).over(w)).filter(F.struct("rank", "overlap") == F.col("top"))
    one = best.groupBy("edit_id", "rank", "overlap").agg(F.count_distinct("commit_id").alias("n"), F.min("commit_id").alias("commit_id")).filter("n = 1")
    return one.select("edit_id", "commit_id", "overlap", F.when(F.col("rank") == 2, "high").otherwise("medium").alias("confidence"))
