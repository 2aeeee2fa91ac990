"""Scans, listings, resolution and totals of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmeter.functions import records as fn
from quillmeter.operators import intervals
from quillmeter.operators import records as ops

from .model import S_SQL, U_SQL, read, subscriptions, usage

Q, SQL = {}, {}


def add(sql: str):
    def put(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


@add(f"WITH {U_SQL} SELECT event_id, provider, account, started_at, total_tokens FROM u WHERE event_id = 42")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return usage(spark, d).filter("event_id = 42").select("event_id", "provider", "account", "started_at", "total_tokens")


@add(f"WITH {U_SQL} SELECT event_id, started_at, input_tokens FROM u ORDER BY started_at, event_id")
def ordered_scan(spark: SparkSession, d: str) -> DataFrame:
    """All events in time order, with a field decoded from their JSON: a range-partitioned sort."""
    return usage(spark, d).select("event_id", "started_at", "input_tokens").orderBy("started_at", "event_id")


@add(f"WITH {U_SQL} SELECT event_id, account, started_at, total_tokens FROM u WHERE provider = 'click'")
def source_scan(spark: SparkSession, d: str) -> DataFrame:
    return usage(spark, d).filter("provider = 'click'").select("event_id", "account", "started_at", "total_tokens")


@add("""SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1996-03-01' OR (o_orderdate = TIMESTAMP '1996-03-01' AND o_orderkey > 500)""")
def summaries_after(spark: SparkSession, d: str) -> DataFrame:
    """Keyset scan of summaries (orders) after a cursor."""
    at = F.to_timestamp_ntz(F.lit("1996-03-01 00:00:00"))
    after = (F.col("o_orderdate") > at) | ((F.col("o_orderdate") == at) & (F.col("o_orderkey") > 500))
    return read(spark, d, "orders").filter(after).select("o_orderkey", "o_orderdate")


_ROLLUP = f"{U_SQL}, r AS (SELECT provider, account, day, count(*) AS n_events, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(cost_micro) AS BIGINT) AS cost_micro FROM u GROUP BY ALL)"


def _rollups(spark: SparkSession, d: str) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("total_tokens", "cost_micro")]
    return usage(spark, d).groupBy("provider", "account", "day").agg(F.count("*").alias("n_events"), *sums)


@add(f"WITH {_ROLLUP} SELECT * FROM r WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'")
def rollups_between(spark: SparkSession, d: str) -> DataFrame:
    """Rollups of a range of days; the filter reaches the events before they are grouped."""
    return _rollups(spark, d).filter(F.col("day").between("2024-01-05", "2024-01-09"))


@add(f"WITH {_ROLLUP} SELECT count(*) AS n_rollups, CAST(sum(n_events) AS BIGINT) AS n_events, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(cost_micro) AS BIGINT) AS cost_micro FROM r WHERE day >= DATE '2024-01-10'")
def rollup_stats_since(spark: SparkSession, d: str) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("n_events", "total_tokens", "cost_micro")]
    return _rollups(spark, d).filter(F.col("day") >= "2024-01-10").agg(F.count("*").alias("n_rollups"), *sums)


_DECODED = f"""{_ROLLUP}, p AS (SELECT day, to_json({{'requests': n_events, 'tokens': total_tokens}}) AS payload FROM r)"""


@add(f"""WITH {_DECODED} SELECT count(*) AS n_rollups, CAST(sum(CAST(json_extract(payload, '$.requests') AS BIGINT)) AS BIGINT) AS requests, CAST(sum(CAST(json_extract(payload, '$.tokens') AS BIGINT)) AS BIGINT) AS tokens FROM p""")
def rollup_stats_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The same over payloads stored as JSON."""
    payload = F.to_json(F.struct(F.col("n_events").alias("requests"), F.col("total_tokens").alias("tokens")))
    field = lambda x: F.sum(F.get_json_object("payload", f"$.{x}").cast("bigint")).alias(x)
    return _rollups(spark, d).select(payload.alias("payload")).agg(F.count("*").alias("n_rollups"), field("requests"), field("tokens"))


_FORMS = ["daily_rollup.v1", "claude_stats_cache", "manual_daily", "ccusage_daily", "manual_period_summary", "custom_period_summary", "other"]
_KINDS = ["local_summary", "local_adapter", "manual_import", "external_tool"]


@add(f"""WITH m AS (SELECT o_orderkey AS id, {_FORMS}[o_orderkey % 7 + 1] AS form, {_KINDS}[o_orderkey // 7 % 4 + 1] AS kind, o_orderdate + INTERVAL 5 HOUR AS a, o_orderdate + INTERVAL 5 HOUR + to_hours(CAST(o_custkey % 40 AS INTEGER)) AS b FROM orders)
SELECT id FROM m WHERE form NOT IN ('daily_rollup.v1', 'claude_stats_cache') AND kind <> 'local_summary' AND (kind = 'local_adapter'
 OR (form IN ('manual_daily', 'ccusage_daily') AND (CAST(a AS DATE) = CAST(b AS DATE) OR b - a BETWEEN INTERVAL 0 HOUR AND INTERVAL 25 HOUR)) OR (form LIKE '%period_summary' AND CAST(a AS DATE) <> CAST(b AS DATE)))""")
def passthrough_summaries(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i.cast("int") + 1)
    key, start = F.col("o_orderkey"), F.col("o_orderdate") + F.expr("INTERVAL 5 HOUR")
    end = start + F.make_dt_interval(hours=(F.col("o_custkey") % 40).cast("int"))
    passes = fn.passes_through(pick(_FORMS, key % 7), pick(_KINDS, F.floor(key / 7) % 4), start, end)
    return read(spark, d, "orders").filter(passes).select(key.alias("id"))


@add(f"""WITH {S_SQL} SELECT id FROM s WHERE start <= TIMESTAMP '1997-06-30' AND ("end" IS NULL OR TIMESTAMP '1997-01-01' < "end")""")
def subscriptions_in_window(spark: SparkSession, d: str) -> DataFrame:
    window = fn.in_report_window(F.col("start"), F.col("end"), F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00")), F.to_timestamp_ntz(F.lit("1997-06-30 00:00:00")))
    return subscriptions(spark, d).filter(window).select("id")


_IDENTITIES = ["provider_api", "source_config", "manual_hint", "unresolved"]


@add(f"""WITH u AS (SELECT event_id, ts, user_id, CASE event_id % 3 WHEN 0 THEN 'd' || user_id WHEN 1 THEN ' ' END AS detected, CASE WHEN event_id % 5 > 0 THEN {_IDENTITIES}[event_id % 4 + 1] END AS identity FROM events),
a AS (SELECT DISTINCT user_id, date_trunc('month', ts) + INTERVAL 12 DAY AS start, 'a' || user_id || '-' || month(ts) AS assigned FROM events WHERE user_id % 2 = 0),
j AS (SELECT u.*, (SELECT max_by(a.assigned, a.start) FROM a WHERE a.user_id = u.user_id AND a.start <= u.ts) AS assigned FROM u),
k AS (SELECT *, coalesce(trim(detected) <> '', false) AS present, coalesce(identity = 'provider_api', false) AS own FROM j)
SELECT event_id, CASE WHEN present AND own THEN detected WHEN assigned IS NOT NULL THEN assigned WHEN NOT present THEN detected END AS account,
 CASE WHEN identity IS NULL OR (present AND own) THEN identity WHEN assigned IS NOT NULL THEN 'source_config' WHEN present THEN 'unresolved' ELSE identity END AS identity FROM k""")
def account_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Detected accounts kept, others assigned as of their time, the rest cleared."""
    e, key, user = read(spark, d, "events"), F.col("event_id"), F.col("user_id").cast("string")
    detected = F.when(key % 3 == 0, F.concat(F.lit("d"), user)).when(key % 3 == 1, " ")
    identity = F.when(key % 5 > 0, F.element_at(F.array(*map(F.lit, _IDENTITIES)), (key % 4 + 1).cast("int")))
    starts = (F.date_trunc("month", "ts").cast("timestamp_ntz") + F.expr("INTERVAL 12 DAY")).alias("start")
    assigned = F.concat(F.lit("a"), user, F.lit("-"), F.month("ts").cast("string")).alias("assigned")
    assignments = e.filter("user_id % 2 = 0").select("user_id", starts, assigned).distinct()
    rows = e.select("event_id", "ts", "user_id", detected.alias("detected"), identity.alias("identity"))
    met = intervals.as_of(rows, assignments, "user_id", "ts", "start", ["assigned"])
    account, source = ops.resolve_account(F.col("detected"), F.col("identity"), F.col("assigned"))
    return met.select("event_id", account.alias("account"), source.alias("identity"))


_LISTING = """c AS (SELECT DISTINCT conv_id AS conversation, CASE WHEN conv_id % 3 = 0 THEN 'x' ELSE 'y' END AS provider FROM conversations),
i AS (SELECT DISTINCT conv_id AS conversation, turn AS item FROM conversations WHERE role <> 'user'), p AS (SELECT conv_id AS conversation, turn AS item, unnest(string_split(text, chr(10))) AS line FROM conversations),
l AS (SELECT c.conversation, c.provider, count(DISTINCT i.item) AS n_items, count(p.line) AS n_parts, CAST(coalesce(sum(strlen(p.line)), 0) AS BIGINT) AS n_bytes, max(i.item) AS last_at FROM c LEFT JOIN i USING (conversation) LEFT JOIN p ON p.conversation = i.conversation AND p.item = i.item GROUP BY ALL)"""


def _listing(spark: SparkSession, d: str, provider: str | None, limit: int | None) -> DataFrame:
    c = read(spark, d, "conversations")
    name = F.col("conv_id").alias("conversation")
    heads = c.select(name, F.when(F.col("conv_id") % 3 == 0, "x").otherwise("y").alias("provider")).distinct()
    items = c.filter("role <> 'user'").select(name, F.col("turn").alias("item"), F.col("turn").alias("at")).distinct()
    parts = c.select(name, F.col("turn").alias("item"), F.explode(F.split("text", "\n")).alias("line"))
    return ops.list_conversations(heads, items, parts.select("conversation", "item", F.octet_length("line").cast("long").alias("n_bytes")), provider, limit)


@add(f"WITH {_LISTING} SELECT * FROM l")
def conversation_listing(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with their items and parts; those without items stay."""
    return _listing(spark, d, None, None)


@add(f"WITH {_LISTING} SELECT * FROM l WHERE provider = 'x' ORDER BY last_at DESC NULLS LAST, conversation LIMIT 20")
def recent_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The same of one provider, the 20 latest: a top-k report."""
    return _listing(spark, d, "x", 20)


@add("""SELECT (SELECT count(*) FROM documents) AS archived, (SELECT count(*) FROM documents WHERE lang IS NOT NULL) AS filtered, (SELECT count(*) FROM documents WHERE lang = 'en') AS current,
 (SELECT count(*) FROM documents WHERE lang <> 'en') AS stale, (SELECT count(DISTINCT doc_id) FROM labels WHERE toxic = 1) AS failed""")
def filter_status(spark: SparkSession, d: str) -> DataFrame:
    """Archived, filtered, current, stale and failed counts: two single rows, each of one pass."""
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    lang = F.col("lang")
    docs = read(spark, d, "documents").agg(F.count("*").alias("archived"), n(lang.isNotNull(), "filtered"), n(lang == "en", "current"), n(lang != "en", "stale"))
    return docs.join(read(spark, d, "labels").filter("toxic = 1").agg(F.count_distinct("doc_id").alias("failed")))


@add("""WITH g AS (SELECT l_orderkey AS item, l_linenumber AS n, CASE WHEN l_partkey % 3 = 0 THEN l_partkey END AS tokens, CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey END AS model, l_returnflag AS flag FROM lineitem)
SELECT item, count(*) AS n_spans, CAST(sum(tokens) AS BIGINT) AS tokens, min_by(model, (n, model)) FILTER (WHERE model IS NOT NULL) AS model, list_aggregate(list_sort(list(DISTINCT flag)), 'string_agg', ',') AS flags FROM g GROUP BY item""")
def work_item_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of work items: an order is one, its lines are the spans."""
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    g = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("n"), F.when(part % 3 == 0, part).alias("tokens"), F.when(supplier % 2 == 0, supplier).alias("model"), F.col("l_returnflag").alias("flag"))
    out = ops.work_item_totals(g, ["item"], ["n"], ["tokens"], ["model"], ["flag"])
    return out.select("item", "n_spans", "tokens", "model", F.array_join("flag_set", ",").alias("flags"))


@add("""WITH m AS (SELECT o_orderkey AS item, o_custkey AS bucket FROM orders WHERE o_orderstatus = 'O') SELECT m.bucket, m.item, l.l_linenumber AS span, l.l_partkey AS project FROM lineitem l JOIN m ON l.l_orderkey = m.item""")
def work_item_spans(spark: SparkSession, d: str) -> DataFrame:
    """Members of work items with their spans."""
    m = read(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("bucket"))
    spans = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("span"), F.col("l_partkey").alias("project"))
    return m.join(spans, "item").select("bucket", "item", "span", "project")


@add("""SELECT CAST(l_shipdate AS DATE) AS day, l_returnflag AS kind, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS added, CAST(sum(l_linenumber) AS BIGINT) AS deleted FROM lineitem GROUP BY ALL""")
def code_totals_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Line counts by day and kind."""
    by = F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("kind")
    return read(spark, d, "lineitem").groupBy(*by).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("added"), F.sum("l_linenumber").alias("deleted"))


@add("""WITH r AS (SELECT l_orderkey AS bucket, min(l_linenumber) AS a, max(l_linenumber) - 1 AS b, 6 AS n FROM lineitem GROUP BY l_orderkey) SELECT bucket, CAST(greatest(a - 2, 0) AS INTEGER) AS a, CAST(least(b + 2, n - 1) AS INTEGER) AS b FROM r""")
def expanded_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of changed spans grown by their context."""
    r = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("bucket")).agg(F.min("l_linenumber").alias("a"), (F.max("l_linenumber") - 1).alias("b"))
    return ops.expand_ranges(r, "a", "b", F.lit(6), 2)


_SPANS = "s AS (SELECT l_orderkey AS k, l_returnflag AS d, l_linenumber * 10 AS a, CAST(l_linenumber * 10 + l_quantity AS INTEGER) AS b FROM lineitem)"


@add(f"""WITH {_SPANS} SELECT x.d AS first, y.d AS second, count(*) AS n FROM s x JOIN s y ON x.k = y.k AND x.d < y.d AND x.a < y.b AND y.a < x.b GROUP BY ALL""")
def detector_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Spans of one text that two detectors both found, by pair of detectors."""
    a = F.col("l_linenumber") * 10
    s = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("d"), a.alias("a"), (a + F.col("l_quantity")).cast("int").alias("b"))
    return ops.detector_overlaps(s, "k", "d", "a", "b")


@add(f"""WITH {U_SQL} SELECT (SELECT count(*) FROM u WHERE started_at > TIMESTAMP '2024-01-20') AS events, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS summaries, (SELECT count(*) FROM customer) AS projects,
 (SELECT count(*) FROM u WHERE started_at > TIMESTAMP '2024-01-20') + (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') + (SELECT count(*) FROM customer) AS total""")
def pending_totals(spark: SparkSession, d: str) -> DataFrame:
    """Pending records by kind and in all: three single rows."""
    n = lambda rows, name: rows.agg(F.count("*").alias(name))
    events = n(usage(spark, d).filter(F.col("started_at") > F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))), "events")
    one = events.join(n(read(spark, d, "orders").filter("o_orderstatus = 'P'"), "summaries")).join(n(read(spark, d, "customer"), "projects"))
    return one.withColumn("total", F.col("events") + F.col("summaries") + F.col("projects"))


@add("""WITH c AS (SELECT source, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS hit, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE toxic = 0) AS t FROM documents JOIN labels USING (doc_id) GROUP BY source),
r AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE hit / p END AS pr, CASE WHEN t = 0 THEN 0 ELSE hit / t END AS re FROM c) SELECT source, hit, round(pr, 9) AS precision, round(re, 9) AS recall, round(CASE WHEN pr = 0 AND re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 9) AS f1 FROM r""")
def f1_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two labels by source; 0 where a ratio has no denominator."""
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    good, calm = F.col("quality") == 1, F.col("toxic") == 0
    both = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels"), "doc_id")
    hit, p, t = F.col("hit"), F.col("p"), F.col("t")
    out = both.groupBy("source").agg(n(good & calm, "hit"), n(good, "p"), n(calm, "t"))
    return out.select("source", "hit", F.round(fn.ratio(hit, p), 9).alias("precision"), F.round(fn.ratio(hit, t), 9).alias("recall"), F.round(fn.f1(hit, p, t), 9).alias("f1"))


@add("""WITH full_set AS (SELECT DISTINCT o_custkey AS bucket FROM orders), changed AS (SELECT DISTINCT o_custkey AS bucket FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
SELECT bucket, 'send' AS state FROM changed UNION ALL SELECT bucket, 'keep' FROM (SELECT bucket FROM full_set EXCEPT SELECT bucket FROM changed)""")
def bucket_states(spark: SparkSession, d: str) -> DataFrame:
    """Union and difference of sets of buckets: those to send again, those to keep."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("bucket"), "o_orderdate", "o_orderstatus")
    changed = F.max((F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00"))) | (F.col("o_orderstatus") == "P"))
    return o.groupBy("bucket").agg(F.when(changed, "send").otherwise("keep").alias("state"))


@add("SELECT EXISTS (SELECT 1 FROM events WHERE value > 1000000 UNION ALL SELECT 1 FROM orders WHERE o_orderstatus = 'P') AS found, EXISTS (SELECT 1 FROM documents WHERE coalesce(lang, '') = '') AS missing")
def state_exists(spark: SparkSession, d: str) -> DataFrame:
    """Whether any of several tables has a row of a kind, and whether any evidence is missing."""
    one = F.lit(1).alias("x")
    rows = read(spark, d, "events").filter("value > 1000000").select(one).union(read(spark, d, "orders").filter("o_orderstatus = 'P'").select(one)).limit(1)
    missing = read(spark, d, "documents").filter("coalesce(lang, '') = ''").select(one).limit(1)
    return rows.agg((F.count("*") > 0).alias("found")).join(missing.agg((F.count("*") > 0).alias("missing")))


@add(f"""WITH {U_SQL}, g AS (SELECT provider, account, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM u GROUP BY ALL) SELECT provider, account, total_tokens, row_number() OVER (ORDER BY total_tokens DESC, account, provider) AS place FROM g ORDER BY place LIMIT 50""")
def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """The 50 first report rows: most tokens first, then account and provider. Only these 50 are numbered."""
    g = usage(spark, d).groupBy("provider", "account").agg(F.sum("total_tokens").alias("total_tokens"))
    order = [F.col("total_tokens").desc(), F.col("account").asc_nulls_last(), F.col("provider").asc_nulls_last()]
    top = g.orderBy(*order).limit(50).agg(F.sort_array(F.collect_list(F.struct((-F.col("total_tokens")).alias("t"), "account", "provider"))).alias("rows"))
    return top.select(F.posexplode("rows").alias("i", "r")).select("r.provider", "r.account", (-F.col("r.t")).alias("total_tokens"), (F.col("i") + 1).cast("long").alias("place"))
