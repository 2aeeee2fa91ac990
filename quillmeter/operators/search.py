"""Full-text search: postings, boolean match and BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.functions.text import tokens

K1, B = 1.2, 0.75


def postings(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, token, tf, length."""
    t = rows.select(key, tokens(F.coalesce(F.col(column), F.lit(""))).alias("t"))
    return t.select(key, F.size("t").alias("length"), F.explode("t").alias("token")).groupBy(key, "token", "length").agg(F.count("*").alias("tf"))


def all_terms(rows: DataFrame, key: str, column: str, terms: list[str]) -> DataFrame:
    """key of rows that have every term, and the number of times: decided in the scan."""
    t = rows.select(key, tokens(F.coalesce(F.col(column), F.lit(""))).alias("t"))
    wanted = F.array(*map(F.lit, terms))
    return t.filter(F.size(F.array_except(wanted, F.col("t"))) == 0).select(key, F.size(F.filter("t", lambda x: x.isin(terms))).alias("n_hits"))


def matches(rows: DataFrame, key: str, column: str, every: list[str] = (), some: list[str] = (), none: list[str] = (), phrase: list[str] = (), prefix: str = "") -> DataFrame:
    """key of rows that have every term, one of some, none of none, the phrase and a token with the prefix."""
    t = rows.select(key, tokens(F.coalesce(F.col(column), F.lit(""))).alias("t"))
    if every:
        t = t.filter(F.size(F.array_except(F.array(*map(F.lit, every)), F.col("t"))) == 0)
    if some:
        t = t.filter(F.arrays_overlap("t", F.array(*map(F.lit, some))))
    if none:
        t = t.filter(~F.arrays_overlap("t", F.array(*map(F.lit, none))))
    if phrase:
        t = t.filter(F.array_join(F.concat(F.array(F.lit("")), "t", F.array(F.lit(""))), " ").contains(f" {' '.join(phrase)} "))
    if prefix:
        t = t.filter(F.exists("t", lambda x: x.startswith(prefix)))
    return t.select(key)


def bm25(rows: DataFrame, key: str, column: str, terms: list[str]) -> DataFrame:
    """key, score of rows with any of the terms. Only counts of terms are aggregated, and a single row of
    statistics goes back to the matching rows. The corpus is read and cut into tokens twice, for the statistics and for the hits."""
    t = rows.select(key, tokens(F.coalesce(F.col(column), F.lit(""))).alias("t"))
    counted = t.select(key, F.size("t").alias("length"), *[(F.size("t") - F.size(F.array_remove("t", w))).alias(f"tf{i}") for i, w in enumerate(terms)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))])
    hit = counted.filter(" OR ".join(f"tf{i} > 0" for i in range(len(terms)))).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        score = score + idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return hit.select(key, score.alias("score"))
