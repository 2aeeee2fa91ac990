"""Joins on prefixes, ancestors and several keys, all as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _heads(text: Column, separator: str) -> Column:
    """Everything before each separator of a text."""
    parts = F.split(text, separator)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), separator))


def by_prefix(rows: DataFrame, column: str, prefixes: DataFrame, prefix: str, separator: str = ":") -> DataFrame:
    """rows with every prefix that they begin with, up to a separator: rows offer their few heads, so no pair is compared in vain."""
    offered = rows.withColumn("_head", F.explode(_heads(F.col(column), separator))).filter(F.col("_head") != F.col(column))
    return offered.join(prefixes, offered["_head"] == prefixes[prefix]).drop("_head")


def deepest_root(paths: DataFrame, key: str, path: str, roots: DataFrame, root: str) -> DataFrame:
    """key and the deepest root that contains the path (a root contains itself)."""
    offered = paths.select(key, F.explode(F.array_distinct(F.concat(_heads(F.col(path), "/"), F.array(path)))).alias("_head"))
    met = offered.join(roots.select(F.col(root).alias("_head")).distinct(), "_head")
    return met.groupBy(key).agg(F.max_by("_head", F.length("_head")).alias("root"))


def resolve_identity(wanted: DataFrame, accounts: DataFrame, key: str, by: list[str]) -> DataFrame:
    """key, account of every row of wanted: the one account that any of the columns by leads to; null if they lead to
    none, null and ambiguous True if they lead to several."""
    found = None
    for c in by:
        one = wanted.filter(F.col(c).isNotNull()).select(key, c).join(accounts.select(c, "account").filter(F.col(c).isNotNull()), c).select(key, "account")
        found = one if found is None else found.unionByName(one)
    n = F.count_distinct("account")
    every = found.unionByName(wanted.select(key).withColumn("account", F.lit(None).cast(found.schema["account"].dataType)))
    return every.groupBy(key).agg(F.when(n == 1, F.min("account")).alias("account"), (n > 1).alias("ambiguous"))
