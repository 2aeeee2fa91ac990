"""The usage-event model over the given tables, in Spark and in DuckDB SQL.

events become usage events: provider = event_type, account = user_id, input tokens = props.k, total
tokens = floor(100 * value), estimated micro-dollars = floor(10000 * value + 0.5). Orders are the
accounts' subscriptions: one begins with an order and ends with the account's next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U_SQL = """u AS (SELECT event_id, event_type AS provider, user_id AS account, ts AS started_at, CAST(ts AS DATE) AS day,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_tokens, CAST(floor(value * 100) AS BIGINT) AS total_tokens,
 CAST(floor(value * 10000 + 0.5) AS BIGINT) AS cost_micro, value FROM events)"""

S_SQL = """s AS (SELECT o_orderkey AS id, o_custkey AS account, o_orderdate AS start,
 lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS "end",
 CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS price_cents, o_orderstatus AS status, o_orderpriority AS plan FROM orders)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("provider"),
        F.col("user_id").alias("account"),
        F.col("ts").alias("started_at"),
        F.to_date("ts").alias("day"),
        F.get_json_object("props", "$.k").cast("bigint").alias("input_tokens"),
        F.floor(F.col("value") * 100).cast("bigint").alias("total_tokens"),
        F.floor(F.col("value") * 10000 + 0.5).cast("bigint").alias("cost_micro"),
        "value",
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    following = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("account"),
        F.col("o_orderdate").alias("start"),
        following.alias("end"),
        F.floor(F.col("o_totalprice") * 100 + 0.5).cast("bigint").alias("price_cents"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("plan"),
    )
