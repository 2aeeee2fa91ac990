"""Lookups, state and small statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmeter.functions import numbers, text
from quillmeter.operators import lookups, state

from . import tasks
from .model import U_SQL, read, usage

Q, SQL = {}, {}


def add(sql: str):
    def put(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


@add(f"""WITH s AS ({tasks.SQL["work_item_segments"]}), i AS (SELECT account, item, count(*) AS n FROM s GROUP BY ALL)
SELECT count(*) AS items, CAST(sum(n) AS BIGINT) AS members, round(avg(n), 9) AS mean_members, round(100.0 * sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / count(*), 6) AS single_percent FROM i""")
def task_stats(spark: SparkSession, d: str) -> DataFrame:
    i = tasks.work_item_segments(spark, d).groupBy("account", "item").agg(F.count("*").alias("n"))
    single = F.sum(F.when(F.col("n") == 1, 1).otherwise(0))
    return i.agg(F.count("*").alias("items"), F.sum("n").alias("members"), F.round(F.avg("n"), 9).alias("mean_members"), F.round(numbers.ratio(100 * single, F.count("*")), 6).alias("single_percent"))


@add("SELECT a.s_suppkey, count(c.c_custkey) AS n FROM supplier a LEFT JOIN customer c ON nullif(a.s_nationkey, 0) IS NOT DISTINCT FROM nullif(c.c_nationkey, 0) GROUP BY a.s_suppkey")
def null_aware_keys(spark: SparkSession, d: str) -> DataFrame:
    """Counts by a key whose null is a value of its own; customers are counted before the join."""
    c = read(spark, d, "customer").groupBy(F.nullif("c_nationkey", F.lit(0)).alias("k")).agg(F.count("*").alias("n"))
    s = read(spark, d, "supplier").select("s_suppkey", F.nullif("s_nationkey", F.lit(0)).alias("j"))
    return s.join(c, F.col("j").eqNullSafe(F.col("k")), "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n"))


@add("SELECT e.event_id FROM events e WHERE EXISTS (SELECT 1 FROM events o WHERE o.event_type = e.event_type AND o.user_id = e.user_id AND date_trunc('hour', o.ts) = date_trunc('hour', e.ts) AND o.value > 100)")
def conflict_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Events whose three-part key is among the keys of conflicts: a semi-join."""
    e = read(spark, d, "events").withColumn("hour", F.date_trunc("hour", F.col("ts")))
    keys = ["event_type", "user_id", "hour"]
    return e.join(e.filter("value > 100").select(*keys).distinct(), keys, "left_semi").select("event_id")


@add("""WITH p AS (SELECT p_partkey, p_brand || ':' || p_type || ':' || p_name AS path FROM part), r AS (SELECT DISTINCT p_brand AS prefix FROM part UNION SELECT DISTINCT p_brand || ':' || p_type FROM part WHERE p_size > 25)
SELECT p.p_partkey, r.prefix FROM p JOIN r ON starts_with(p.path, r.prefix || ':')""")
def prefix_join(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    rows = part.select("p_partkey", F.concat_ws(":", "p_brand", "p_type", "p_name").alias("path"))
    prefixes = part.select(F.col("p_brand").alias("prefix")).union(part.filter("p_size > 25").select(F.concat_ws(":", "p_brand", "p_type"))).distinct()
    return lookups.by_prefix(rows, "path", prefixes, "prefix").select("p_partkey", "prefix")


@add("""WITH p AS (SELECT p_partkey, '/' || p_brand || '/' || p_size || '/' || replace(p_name, ' ', '/') AS path FROM part), r AS (SELECT DISTINCT '/' || p_brand AS root FROM part UNION SELECT DISTINCT '/' || p_brand || '/' || p_size FROM part WHERE p_retailprice > 1200)
SELECT p.p_partkey, max_by(r.root, length(r.root)) AS root FROM p JOIN r ON p.path = r.root OR starts_with(p.path, r.root || '/') GROUP BY p.p_partkey""")
def deepest_repository(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    top = F.concat(F.lit("/"), "p_brand")
    deep = F.concat(F.lit("/"), "p_brand", F.lit("/"), F.col("p_size").cast("string"))
    paths = part.select("p_partkey", F.concat(deep, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/"))).alias("path"))
    roots = part.select(top.alias("root")).union(part.filter("p_retailprice > 1200").select(deep)).distinct()
    return lookups.deepest_root(paths, "p_partkey", "path", roots, "root")


@add("""WITH a AS (SELECT c_custkey AS account, lower(c_name) AS email, CAST(c_custkey // 2 AS VARCHAR) AS uid FROM customer), w AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 > 0 THEN lower(c_name) END AS email, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey // 2 AS VARCHAR) END AS uid FROM customer),
f AS (SELECT w.k, a.account FROM w JOIN a USING (email) UNION ALL SELECT w.k, a.account FROM w JOIN a USING (uid) UNION ALL SELECT k, NULL FROM w) SELECT k, CASE WHEN count(DISTINCT account) = 1 THEN min(account) END AS account, count(DISTINCT account) > 1 AS ambiguous FROM f GROUP BY k""")
def identity_resolution(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    uid = F.floor(F.col("c_custkey") / 2).cast("string")
    accounts = c.select(F.col("c_custkey").alias("account"), F.lower("c_name").alias("email"), uid.alias("uid"))
    wanted = c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 5 > 0, F.lower("c_name")).alias("email"), F.when(F.col("c_custkey") % 3 == 0, uid).alias("uid"))
    return lookups.resolve_identity(wanted, accounts, "k", ["email", "uid"])


@add("SELECT CAST(max(ts) AS TIMESTAMP) AS ts, max_by(event_id, (ts, event_id)) AS event_id FROM events")
def cursor_position(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").agg(F.max(F.struct("ts", "event_id")).alias("c")).select("c.ts", "c.event_id")


@add("""WITH cur AS (SELECT o_orderkey AS key, o_orderstatus AS signature FROM orders), st AS (SELECT o_orderkey AS key, CASE WHEN o_totalprice > 400000 THEN 'old' ELSE o_orderstatus END AS signature FROM orders WHERE o_orderpriority <> '1-URGENT')
SELECT cur.key, cur.signature FROM cur LEFT JOIN st USING (key) WHERE st.key IS NULL OR cur.signature IS DISTINCT FROM st.signature""")
def scan_selection(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    listing = o.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("signature"))
    known = o.filter("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_totalprice") > 400000, "old").otherwise(F.col("o_orderstatus")).alias("signature"))
    return state.changed_files(listing, known)


@add("""WITH s AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate AS a, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate + INTERVAL 100 DAY END AS b FROM orders)
SELECT id, CASE WHEN status <> 'F' THEN least(coalesce(b, TIMESTAMP '1998-01-01'), TIMESTAMP '1998-01-01') ELSE b END AS "end" FROM s WHERE status = 'F' OR a < least(coalesce(b, TIMESTAMP '1998-01-01'), TIMESTAMP '1998-01-01')""")
def close_intervals(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", F.col("o_orderdate").alias("start"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.expr("INTERVAL 100 DAY")).alias("end"))
    return state.close_intervals(o, F.col("o_orderstatus") != "F", F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00"))).select("id", "end")


@add(f"""WITH {U_SQL}, m AS (SELECT provider, CASE WHEN input_tokens + total_tokens > 0 THEN round(total_tokens / (input_tokens + total_tokens), 9) END AS r, value, input_tokens FROM u)
SELECT provider, count(r) AS n, round(avg(r), 6) AS mean, quantile_disc(r, 0.5) AS p50, quantile_disc(r, 0.95) AS p95, round(sum(input_tokens) / nullif(sum(floor(value)), 0), 6) AS per_second FROM m GROUP BY provider""")
def ratio_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Cache-hit ratios of rows with a denominator, and the overall rate."""
    whole = F.col("input_tokens") + F.col("total_tokens")
    m = usage(spark, d).withColumn("r", F.when(whole > 0, F.round(F.col("total_tokens") / whole, 9)))
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY r)")
    return m.groupBy("provider").agg(F.count("r").alias("n"), F.round(F.avg("r"), 6).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.round(F.sum("input_tokens") / F.nullif(F.sum(F.floor("value")), F.lit(0)), 6).alias("per_second"))


@add("SELECT conv_id, turn, CASE WHEN length(text) > 40 THEN rtrim(substr(text, 1, 37)) || '...' ELSE text END AS short, CAST(strlen(text) AS INTEGER) AS n_bytes FROM conversations")
def truncated_titles(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", text.truncated(F.col("text"), 40).alias("short"), F.octet_length("text").alias("n_bytes"))
