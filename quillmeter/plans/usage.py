"""Usage reports, totals and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmeter.functions import identity, numbers
from quillmeter.operators import intervals, sequences

from .model import S_SQL, U_SQL, read, subscriptions, usage

SINCE, UNTIL = "2024-01-08 00:00:00", "2024-01-15 12:00:00"
CURSOR = ("2024-01-20 00:00:00", 500)
NOT_REPORTABLE = ["daily_rollup.v1", "claude_stats_cache"]

Q, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def ntz(text: str) -> Column:
    return F.to_timestamp_ntz(F.lit(text))


def usage_report(u: DataFrame, *by: str) -> DataFrame:
    """Totals, and first and last time, by the given columns."""
    return u.groupBy(*by).agg(
        F.count("*").alias("n_events"),
        numbers.saturating_sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        numbers.saturating_sum(numbers.total_tokens(F.col("total_tokens"), F.col("input_tokens"))).alias("total_tokens"),
        numbers.saturating_sum(F.col("cost_micro")).alias("cost_micro"),
        numbers.cents(F.sum("cost_micro")).alias("cost_cents"),
        F.min("started_at").alias("first_at"),
        F.max("started_at").alias("last_at"),
    )


_REPORT = """count(*) AS n_events, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(total_tokens, input_tokens, 0)) AS BIGINT) AS total_tokens,
 CAST(sum(cost_micro) AS BIGINT) AS cost_micro, CAST(sign(sum(cost_micro)) * ((abs(sum(cost_micro)) + 5000) // 10000) AS BIGINT) AS cost_cents, min(started_at) AS first_at, max(started_at) AS last_at"""


@query(f"WITH {U_SQL} SELECT provider, account, {_REPORT} FROM u GROUP BY provider, account")
def usage_report_all_time(spark: SparkSession, d: str) -> DataFrame:
    return usage_report(usage(spark, d), "provider", "account")


@query(f"WITH {U_SQL} SELECT provider, account, {_REPORT} FROM u WHERE started_at BETWEEN TIMESTAMP '{SINCE}' AND TIMESTAMP '{UNTIL}' GROUP BY provider, account")
def usage_report_range(spark: SparkSession, d: str) -> DataFrame:
    return usage_report(usage(spark, d).filter(F.col("started_at").between(ntz(SINCE), ntz(UNTIL))), "provider", "account")


@query(f"""WITH {U_SQL}, l AS (SELECT u.*, coalesce(nullif(trim(c.c_name), ''), CAST(u.account AS VARCHAR), 'unassigned') AS label FROM u LEFT JOIN customer c ON u.account = c.c_custkey)
SELECT provider, label, {_REPORT} FROM l GROUP BY provider, label""")
def usage_report_dims(spark: SparkSession, d: str) -> DataFrame:
    """Events are summed by account before the labels are joined: a hot account is a few rows by then."""
    own = usage_report(usage(spark, d), "provider", "account")
    names = read(spark, d, "customer").select(F.col("c_custkey").alias("account"), F.nullif(F.trim("c_name"), F.lit("")).alias("name"))
    labelled = own.join(names, "account", "left").withColumn("label", F.coalesce("name", F.col("account").cast("string"), F.lit("unassigned")))
    sums = [numbers.saturating_sum(F.col(c)).alias(c) for c in ("n_events", "input_tokens", "total_tokens", "cost_micro")]
    return labelled.groupBy("provider", "label").agg(*sums, numbers.cents(F.sum("cost_micro")).alias("cost_cents"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


@query(f"WITH {U_SQL}, r AS (SELECT provider, account, {_REPORT} FROM u GROUP BY provider, account) SELECT count(*) AS n_rows, CAST(sum(n_events) AS BIGINT) AS n_events, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(cost_micro) AS BIGINT) AS cost_micro FROM r")
def report_totals(spark: SparkSession, d: str) -> DataFrame:
    r = usage_report(usage(spark, d), "provider", "account")
    return r.agg(F.count("*").alias("n_rows"), *[numbers.saturating_sum(F.col(c)).alias(c) for c in ("n_events", "total_tokens", "cost_micro")])


@query("SELECT event_type AS source, count(*) AS n FROM events GROUP BY event_type")
def event_counts_by_source(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("n"))


_SUMMARIES = "m AS (SELECT o_custkey AS account, count(*) AS requests, CAST(sum(floor(o_totalprice)) AS BIGINT) AS tokens FROM orders GROUP BY o_custkey)"


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("account")).agg(F.count("*").alias("requests"), F.sum(F.floor("o_totalprice")).cast("bigint").alias("tokens"))


def _event_totals(spark: SparkSession, d: str) -> DataFrame:
    return usage(spark, d).groupBy("account").agg(F.count("*").alias("requests"), F.sum("total_tokens").alias("tokens"))


@query(f"""WITH {U_SQL}, e AS (SELECT account, count(*) AS requests, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM u GROUP BY account), {_SUMMARIES}
SELECT coalesce(e.account, m.account) AS account, CASE WHEN m.tokens > coalesce(e.tokens, -1) THEN m.requests ELSE e.requests END AS requests,
 CASE WHEN m.tokens > coalesce(e.tokens, -1) THEN m.tokens ELSE e.tokens END AS tokens FROM e FULL JOIN m ON e.account = m.account""")
def totals_by_source_max_merge(spark: SparkSession, d: str) -> DataFrame:
    """The larger token total wins as a whole row: the greatest of two structs, without a full join."""
    both = _event_totals(spark, d).withColumn("first", F.lit(1)).unionByName(_summaries(spark, d).withColumn("first", F.lit(0)))
    return both.groupBy("account").agg(F.max(F.struct("tokens", "first", "requests")).alias("r")).select("account", F.col("r.requests").alias("requests"), F.col("r.tokens").alias("tokens"))


@query(f"""WITH {U_SQL}, {_SUMMARIES}, a AS (SELECT account, 1 AS requests, total_tokens AS tokens FROM u UNION ALL SELECT * FROM m)
SELECT account, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM a GROUP BY account""")
def totals_by_provider_additive(spark: SparkSession, d: str) -> DataFrame:
    both = _event_totals(spark, d).unionByName(_summaries(spark, d))
    return both.groupBy("account").agg(F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens"))


@query(f"WITH {U_SQL} SELECT count(*) AS n, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens FROM u WHERE started_at >= TIMESTAMP '{SINCE}'")
def period_stats_since(spark: SparkSession, d: str) -> DataFrame:
    return usage(spark, d).filter(F.col("started_at") >= ntz(SINCE)).agg(F.count("*").alias("n"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"))


@query(f"WITH {U_SQL} SELECT event_id, started_at, total_tokens FROM u WHERE started_at > TIMESTAMP '{CURSOR[0]}' OR (started_at = TIMESTAMP '{CURSOR[0]}' AND event_id > {CURSOR[1]}) ORDER BY started_at, event_id LIMIT 100")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    t, i = F.col("started_at"), F.col("event_id")
    return usage(spark, d).filter((t > ntz(CURSOR[0])) | ((t == ntz(CURSOR[0])) & (i > CURSOR[1]))).orderBy("started_at", "event_id").limit(100).select("event_id", "started_at", "total_tokens")


@query(f"SELECT count(*) AS n FROM events WHERE ts > TIMESTAMP '{CURSOR[0]}' OR (ts = TIMESTAMP '{CURSOR[0]}' AND event_id > {CURSOR[1]})")
def unsynced_count(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("ts")
    return read(spark, d, "events").filter((t > ntz(CURSOR[0])) | ((t == ntz(CURSOR[0])) & (F.col("event_id") > CURSOR[1]))).agg(F.count("*").alias("n"))


@query("""SELECT event_type AS provider, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS requests,
 CAST(sum(coalesce(CAST(json_extract_string(props, '$.reported_micro') AS BIGINT), CAST(json_extract_string(props, '$.reported_cents') AS BIGINT) * 10000, CAST(json_extract_string(props, '$.k') AS BIGINT) * 10000)) AS BIGINT) AS cost_micro FROM events GROUP BY event_type""")
def json_extract_totals(spark: SparkSession, d: str) -> DataFrame:
    x = lambda path: F.get_json_object("props", f"$.{path}").cast("bigint")
    cost = numbers.effective_cost(x("reported_micro"), x("reported_cents"), F.lit(None).cast("bigint"), x("k"))
    return read(spark, d, "events").groupBy(F.col("event_type").alias("provider")).agg(F.sum(x("k")).alias("requests"), F.sum(cost).alias("cost_micro"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE coalesce(CASE o_orderstatus WHEN 'F' THEN 'daily_rollup.v1' WHEN 'P' THEN 'claude_stats_cache' END, '') NOT IN ('daily_rollup.v1', 'claude_stats_cache') AND CAST(o_orderdate AS DATE) >= DATE '1998-01-01'")
def reportable_filter(spark: SparkSession, d: str) -> DataFrame:
    """Summaries that reports show: not rollups of events, not the stats cache; a null format is reportable."""
    fmt = F.when(F.col("o_orderstatus") == "F", NOT_REPORTABLE[0]).when(F.col("o_orderstatus") == "P", NOT_REPORTABLE[1])
    return read(spark, d, "orders").filter(~F.coalesce(fmt, F.lit("")).isin(NOT_REPORTABLE) & (F.to_date("o_orderdate") >= F.lit("1998-01-01").cast("date"))).select("o_orderkey", F.to_date("o_orderdate").alias("day"))


def daily_totals(u: DataFrame) -> DataFrame:
    """The daily rollup: exact nearest-rank percentiles, null accounts a bucket of their own."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY total_tokens)")
    return u.groupBy("provider", "account", "day").agg(
        F.count("*").alias("requests"),
        numbers.saturating_sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        numbers.saturating_sum(F.coalesce("total_tokens", F.lit(0))).alias("total_tokens"),
        numbers.saturating_sum(F.col("cost_micro")).alias("cost_micro"),
        F.count_distinct(F.date_trunc("hour", F.col("started_at"))).alias("sessions"),
        p(0.5).alias("p50"),
        p(0.95).alias("p95"),
    )


@query(f"""WITH {U_SQL} SELECT provider, account, day, count(*) AS requests, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
 CAST(sum(cost_micro) AS BIGINT) AS cost_micro, count(DISTINCT date_trunc('hour', started_at)) AS sessions, quantile_disc(total_tokens, 0.5) AS p50, quantile_disc(total_tokens, 0.95) AS p95 FROM u GROUP BY provider, account, day""")
def daily_rollup(spark: SparkSession, d: str) -> DataFrame:
    return daily_totals(usage(spark, d))


@query(f"""WITH {U_SQL} SELECT provider, count(*) AS n, round(avg(total_tokens), 6) AS mean, min(total_tokens) AS least, max(total_tokens) AS most,
 quantile_disc(total_tokens, 0.5) AS p50, quantile_disc(total_tokens, 0.95) AS p95, CAST(sum(total_tokens) AS BIGINT) AS total FROM u GROUP BY provider""")
def rollup_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles from value counts, which combine map-side: a provider's values never meet in one task."""
    values = usage(spark, d).filter("total_tokens is not null").groupBy("provider", "total_tokens").agg(F.count("*").alias("k"))
    from pyspark.sql import Window

    upto = Window.partitionBy("provider").orderBy("total_tokens").rowsBetween(Window.unboundedPreceding, 0)
    cum = values.withColumn("upto", F.sum("k").over(upto)).withColumn("n", F.sum("k").over(Window.partitionBy("provider")))
    rank = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * q), F.col("total_tokens")))
    return cum.groupBy("provider").agg(F.max("n").alias("n"), F.round(F.sum(F.col("total_tokens") * F.col("k")) / F.max("n"), 6).alias("mean"), F.min("total_tokens").alias("least"), F.max("total_tokens").alias("most"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), F.sum(F.col("total_tokens") * F.col("k")).alias("total"))


@query(f"""WITH {U_SQL}, g AS (SELECT account, day, provider AS model, count(*) AS requests, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM u GROUP BY account, day, provider)
SELECT account, day, string_agg(model || '=' || requests || '/' || tokens, ';' ORDER BY model) AS models FROM g GROUP BY account, day""")
def rollup_models_array(spark: SparkSession, d: str) -> DataFrame:
    g = usage(spark, d).groupBy("account", "day", F.col("provider").alias("model")).agg(F.count("*").alias("requests"), F.sum("total_tokens").alias("tokens"))
    models = F.array_sort(F.collect_list(F.struct("model", "requests", "tokens")))
    text = F.transform(models, lambda m: F.concat(m["model"], F.lit("="), m["requests"].cast("string"), F.lit("/"), m["tokens"].cast("string")))
    return g.groupBy("account", "day").agg(F.array_join(text, ";").alias("models"))


@query(f"""WITH {U_SQL}, p AS (SELECT day, provider, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens, CAST(sum(cost_micro) AS BIGINT) AS cost FROM u GROUP BY day, provider)
SELECT day, CAST(sum(n) AS BIGINT) AS n_events, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost) AS BIGINT) AS cost_micro, string_agg(provider || ':' || tokens, ',' ORDER BY provider) AS by_provider,
 max((SELECT count(DISTINCT account) FROM u x WHERE x.day = p.day)) AS n_accounts FROM p GROUP BY day""")
def device_day_rollup(spark: SparkSession, d: str) -> DataFrame:
    u = usage(spark, d)
    p = u.groupBy("day", "provider").agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"), F.sum("cost_micro").alias("cost"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("provider", "tokens"))), lambda x: F.concat(x["provider"], F.lit(":"), x["tokens"].cast("string")))
    days = p.groupBy("day").agg(F.sum("n").alias("n_events"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost_micro"), F.array_join(text, ",").alias("by_provider"))
    return days.join(u.groupBy("day").agg(F.count_distinct("account").alias("n_accounts")), "day")


_SUBS = f"""{U_SQL}, {S_SQL}, w AS (SELECT s.id, s.account, s.plan, s.price_cents, s.start + INTERVAL 25 YEAR AS start, s."end" + INTERVAL 25 YEAR AS "end" FROM s)"""


def _windows(spark: SparkSession, d: str) -> DataFrame:
    """Subscriptions moved into the events' time."""
    s = subscriptions(spark, d)
    later = lambda c: F.col(c) + F.expr("INTERVAL 25 YEAR")
    return s.select("id", "account", "plan", "price_cents", later("start").alias("start"), later("end").alias("end"))


@query(f"""WITH {_SUBS}, x AS (SELECT w.id, count(u.event_id) AS n, CAST(coalesce(sum(u.total_tokens), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(u.cost_micro), 0) AS BIGINT) AS cost_micro
 FROM w LEFT JOIN u ON u.account = w.account AND u.started_at >= w.start AND (w."end" IS NULL OR u.started_at < w."end") GROUP BY w.id)
SELECT w.id, w.account, w.plan, w.price_cents, x.n, x.tokens, x.cost_micro, (x.cost_micro + 5000) // 10000 - w.price_cents AS value_cents FROM w JOIN x USING (id)""")
def subscription_report(spark: SparkSession, d: str) -> DataFrame:
    w = _windows(spark, d)
    events = usage(spark, d).select("account", F.col("started_at").alias("ts"), F.col("total_tokens").alias("tokens"), "cost_micro")
    totals = intervals.range_totals(w.select("account", "id", "start", "end"), events, "account", ["tokens", "cost_micro"])
    difference, _ = numbers.value_over_price(F.col("price_cents"), F.lit("USD"), numbers.cents(F.col("cost_micro")))
    return w.join(totals, "id").select("id", "account", "plan", "price_cents", "n", "tokens", "cost_micro", difference.alias("value_cents"))


@query(f"""WITH {_SUBS}, m AS (SELECT w.id, w.account, w.start, w.start + INTERVAL 90 DAY AS "end", w.price_cents % 4000 AS reported FROM w),
x AS (SELECT m.id, count(u.event_id) AS n, CAST(coalesce(sum(u.total_tokens), 0) AS BIGINT) AS tokens FROM m LEFT JOIN u ON u.account = m.account AND u.started_at >= m.start AND u.started_at < m."end" GROUP BY m.id)
SELECT m.id, x.n, x.tokens, m.reported, x.tokens > 0 AND x.tokens = m.reported AS exact FROM m JOIN x USING (id)""")
def summary_overlap_exact(spark: SparkSession, d: str) -> DataFrame:
    """Reported summaries with the direct usage of their period, and whether the two are equal."""
    m = _windows(spark, d).select("id", "account", "start", (F.col("start") + F.expr("INTERVAL 90 DAY")).alias("end"), (F.col("price_cents") % 4000).alias("reported"))
    events = usage(spark, d).select("account", F.col("started_at").alias("ts"), F.col("total_tokens").alias("tokens"))
    totals = intervals.range_totals(m.select("account", "id", "start", "end"), events, "account", ["tokens"])
    return m.select("id", "reported").join(totals, "id").select("id", "n", "tokens", "reported", ((F.col("tokens") > 0) & (F.col("tokens") == F.col("reported"))).alias("exact"))


@query(f"""WITH {_SUBS} SELECT u.event_id, u.account, (SELECT max_by(w.id, (w.start, w.id)) FROM w WHERE w.account = u.account AND w.start <= u.started_at) AS assignment FROM u""")
def account_attribution_asof(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the account's assignment at its time (the latest that has begun; each ends with the next)."""
    from pyspark.sql import Window

    w = _windows(spark, d)
    same_start = Window.partitionBy("account", "start").orderBy(F.desc("id"))
    w = w.withColumn("k", F.row_number().over(same_start)).filter("k = 1")
    out = intervals.as_of(usage(spark, d).select("event_id", "account", "started_at"), w.select("account", "start", "id"), "account", "started_at", "start", ["id"])
    return out.select("event_id", "account", F.col("id").alias("assignment"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey AS account, o_orderdate AS start, o_orderdate + INTERVAL 30 DAY AS "end" FROM orders)
SELECT a.id AS left_id, b.id AS right_id FROM o a JOIN o b ON a.account = b.account AND a.id < b.id AND a.start < b."end" AND b.start < a."end" """)
def interval_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping intervals of one account, joined on account and 30-day cell (an interval lies in two cells at most)."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("end"))
    cell = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / 30)
    cells = o.withColumn("cell", F.explode(F.array_distinct(F.array(cell("start"), cell("end")))))
    a, b = (cells.toDF(*[f"{p}_{c}" for c in cells.columns]) for p in "ab")
    met = a.join(b, (F.col("a_account") == F.col("b_account")) & (F.col("a_cell") == F.col("b_cell")) & (F.col("a_id") < F.col("b_id")))
    met = met.filter(intervals.overlaps(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")))
    return met.select(F.col("a_id").alias("left_id"), F.col("b_id").alias("right_id")).distinct()


@query("""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate + INTERVAL 3 DAY AS DATE) AS b FROM orders)
SELECT DISTINCT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM o""")
def day_coverage(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_orderdate").alias("a"), (F.col("o_orderdate") + F.expr("INTERVAL 3 DAY")).alias("b"))
    return intervals.covered_days(o.distinct(), "a", "b")


@query(f"""WITH {U_SQL}, h AS (SELECT provider, account, CAST(9223372036854775000 AS HUGEINT) + total_tokens AS t FROM u WHERE total_tokens > 0)
SELECT provider, CAST(least(sum(least(t, 9223372036854775807)), 9223372036854775807) AS BIGINT) AS saturated FROM h GROUP BY provider""")
def saturating_sum(spark: SparkSession, d: str) -> DataFrame:
    big = numbers.saturating_add(F.lit(9223372036854775000), F.col("total_tokens"))
    return usage(spark, d).filter("total_tokens > 0").groupBy("provider").agg(numbers.saturating_sum(big).alias("saturated"))


@query(f"WITH {U_SQL} SELECT event_id, CAST(sum(total_tokens) OVER (PARTITION BY account ORDER BY started_at NULLS FIRST, event_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM u")
def prefix_sums(spark: SparkSession, d: str) -> DataFrame:
    u = usage(spark, d).select("event_id", "account", "started_at", "total_tokens", "day")
    return intervals.running_sums(u, "account", ["started_at", "event_id"], F.col("day"), {"upto": "total_tokens"}).select("event_id", "upto")


@query("SELECT event_id, 'evt_' || substr(sha256(concat_ws(':', coalesce(event_type, ''), coalesce(CAST(user_id AS VARCHAR), ''), coalesce(CAST(event_id AS VARCHAR), ''))), 1, 32) AS id, sha256(coalesce(event_type, '') || ':' || coalesce(CAST(user_id AS VARCHAR), '') || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' WHEN microsecond(ts) % 1000 = 0 THEN '.' || strftime(ts, '%g') ELSE '.' || strftime(ts, '%f') END || '+00:00') AS fingerprint FROM events")
def event_ids(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select("event_id", identity.hashed_id("evt_", 32, F.col("event_type"), F.col("user_id"), F.col("event_id")).alias("id"), identity.semantic_fingerprint(F.col("event_type"), F.col("user_id"), identity.rfc3339(F.col("ts"))).alias("fingerprint"))


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return sequences.latest(read(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"])


@query("SELECT o_custkey AS repository, year(o_orderdate) AS y, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS project FROM orders GROUP BY o_custkey, year(o_orderdate)")
def unanimous_project(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("repository"), F.year("o_orderdate").cast("long").alias("y")).agg(sequences.unanimous("o_orderstatus").alias("project"))
