"""Connected components of an edge table, in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of edges (u, v: long).

    Alternates large-star and small-star steps until no edge changes; every round is written to the
    shared folder. Steps aggregate by node with map-side combining and join the minimum back, so a hub
    with very many edges is split like any skewed join."""
    now = materialize(spark, edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _digest(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        now = materialize(spark, small, "edges")
        if (new := _digest(now)) == seen:
            break
        seen = new
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())


def _digest(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.coalesce(F.sum((h % 1_000_003).cast("decimal(38,0)")), F.lit(0))).first())
