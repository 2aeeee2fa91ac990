"""Titles from prompts: clean lines, a score, the best one of a bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.functions import text

WIDTH = 96
#: Words that say nothing about a task by themselves.
GENERIC = ["continue", "go on", "ok", "okay", "yes", "no", "thanks", "thank you", "done", "next", "please", "test", "hi", "hello"]


def candidates(rows: DataFrame) -> DataFrame:
    """bucket, ordinal, line, title of the first six clean lines of each text outside code fences."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?s)```.*?(```|$)", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^[#>*\-\s]+", ""), r"\s+", " "))), lambda x: x != "")
    shown = rows.select("bucket", "ordinal", F.posexplode(F.slice(lines, 1, 6)).alias("line", "title"))
    return shown.withColumn("title", text.truncated(F.col("title"), WIDTH))


def score(title: Column) -> Column:
    """Integer rubric: length bands, word count, issue keys and code marks add; generic or opaque lines lose."""
    words = F.size(F.split(title, " "))
    length = F.char_length(title)
    out = F.when((words >= 3) & (words <= 12), 6).when(words >= 2, 3).otherwise(0)
    out = out + F.when((length >= 12) & (length <= 72), 4).when(length < 6, -4).otherwise(0)
    out = out + F.when(F.size(text.issue_keys(title)) > 0, 3).otherwise(0) + F.when(title.rlike(r"[A-Za-z_]+\(\)|\w+\.\w{1,4}\b"), 1).otherwise(0)
    return out - F.when(F.lower(F.regexp_replace(title, r"[\p{P}\s]+$", "")).isin(GENERIC), 12).otherwise(0) - F.when(title.rlike(r"^\S{24,}$"), 6).otherwise(0)


def best_titles(rows: DataFrame) -> DataFrame:
    """bucket, title, score: the best candidate, the first of equals; 'Unresolved work item' without a positive one."""
    scored = candidates(rows).withColumn("score", score(F.col("title")))
    best = scored.groupBy("bucket").agg(F.max(F.struct("score", (-F.col("ordinal")).alias("o"), (-F.col("line")).alias("l"), "title")).alias("b"))
    every = rows.select("bucket").distinct().join(best, "bucket", "left")
    good = F.col("b.score") > 0
    return every.select("bucket", F.when(good, F.col("b.title")).otherwise("Unresolved work item").alias("title"), F.coalesce("b.score", F.lit(0)).alias("score"))
