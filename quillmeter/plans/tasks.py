"""Sessions, segments, titles and quality of grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmeter.functions import numbers, text
from quillmeter.operators import dedupe, intervals, sequences, titles

from .model import U_SQL, read, usage

Q, SQL = {}, {}
STOP_WORDS = ["the", "and", "for", "with", "that", "this", "from"]


def _gap(hours: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return sequences.gap_sessions(usage(spark, d), "account", "started_at", "event_id", hours).select("event_id", "account", "session")

    return run, f"""WITH {U_SQL}, g AS (SELECT *, CASE WHEN date_sub('hour', lag(started_at) OVER w, started_at) > {hours} THEN 1 ELSE 0 END AS new FROM u WINDOW w AS (PARTITION BY account ORDER BY started_at, event_id))
SELECT event_id, account, CAST(sum(new) OVER (PARTITION BY account ORDER BY started_at, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g"""


for _h in (2, 6, 12, 24):
    Q[f"gap_sessions_{_h}h"], SQL[f"gap_sessions_{_h}h"] = _gap(_h)


def adjacent_pairs(spark: SparkSession, d: str) -> DataFrame:
    return sequences.adjacent_pairs(usage(spark, d), "account", ["started_at", "event_id"], "event_id")


SQL["adjacent_pairs"] = f"WITH {U_SQL}, p AS (SELECT account, event_id AS first, lead(event_id) OVER (PARTITION BY account ORDER BY started_at, event_id) AS second FROM u) SELECT * FROM p WHERE second IS NOT NULL"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """User turns as spans: bucket = conversation, topic tokens of the text."""
    c = read(spark, d, "conversations").filter("role = 'user'")
    return c.select(F.col("conv_id").alias("bucket"), "turn", text.topic_tokens(F.coalesce("text", F.lit("")), STOP_WORDS).alias("topics"), F.octet_length(F.coalesce("text", F.lit(""))).alias("n_bytes"))


_TOPICS = f"""list_sort(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) >= 3 AND NOT list_contains({STOP_WORDS}, t))))"""
_SPANS = f"c AS (SELECT conv_id AS bucket, turn, {_TOPICS} AS topics, strlen(coalesce(text, '')) AS n_bytes FROM conversations WHERE role = 'user')"


def topic_window_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Weighted Jaccard of the topics of two spans before and two after each boundary."""
    w = Window.partitionBy("bucket").orderBy("turn")
    left = F.flatten(F.collect_list("topics").over(w.rowsBetween(-1, 0)))
    right = F.flatten(F.collect_list("topics").over(w.rowsBetween(1, 2)))
    sides = _spans(spark, d).select("bucket", "turn", left.alias("l"), right.alias("r"), F.lead("turn").over(w).alias("following"))
    return sides.filter("following is not null").select("bucket", "turn", F.round(sequences.weighted_jaccard(F.col("l"), F.col("r")), 9).alias("similarity"))


_SIMILARITY = f"""{_SPANS}, f AS (SELECT bucket, turn, flatten(list(topics) OVER (PARTITION BY bucket ORDER BY turn ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) AS l,
 flatten(list(topics) OVER (PARTITION BY bucket ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) AS r, lead(turn) OVER (PARTITION BY bucket ORDER BY turn) AS following FROM c),
t AS (SELECT bucket, turn, 0 AS side, unnest(l) AS tok FROM f WHERE following IS NOT NULL UNION ALL SELECT bucket, turn, 1, unnest(r) FROM f WHERE following IS NOT NULL),
k AS (SELECT bucket, turn, tok, sum(1 - side) AS a, sum(side) AS b FROM t GROUP BY ALL), j AS (SELECT bucket, turn, sum(least(a, b)) / sum(greatest(a, b)) AS s FROM k GROUP BY ALL),
sim AS (SELECT f.bucket, f.turn, round(coalesce(CASE WHEN len(l) > 0 AND len(r) > 0 THEN j.s END, 0), 9) AS similarity FROM f LEFT JOIN j USING (bucket, turn) WHERE following IS NOT NULL)"""
SQL["topic_window_similarity"] = f"WITH {_SIMILARITY} SELECT bucket, turn, similarity FROM sim"


def boundary_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Boundaries of low similarity and great depth within their bucket."""
    w = Window.partitionBy("bucket").orderBy("turn")
    of_bucket = Window.partitionBy("bucket")
    s = topic_window_similarity(spark, d)
    peaks = F.max("similarity").over(w.rowsBetween(-2, 0)) + F.max("similarity").over(w.rowsBetween(0, 2))
    s = s.withColumn("depth", F.round(peaks - 2 * F.col("similarity"), 9))
    for c in ("similarity", "depth"):
        s = s.withColumn(f"m_{c}", F.round(F.avg(c).over(of_bucket), 9)).withColumn(f"d_{c}", F.round(F.stddev_pop(c).over(of_bucket), 9))
    low = F.col("similarity") <= F.greatest(F.lit(0.0), F.round(F.col("m_similarity") - 0.5 * F.col("d_similarity"), 6))
    deep = F.col("depth") >= F.round(F.col("m_depth") + 0.5 * F.col("d_depth"), 6)
    return s.select("bucket", "turn", "depth", (low & deep & (F.col("d_similarity") > 0) & (F.col("d_depth") > 0)).alias("outlier"))


SQL["boundary_outliers"] = f"""WITH {_SIMILARITY}, dd AS (SELECT *, round(max(similarity) OVER (PARTITION BY bucket ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) + max(similarity) OVER (PARTITION BY bucket ORDER BY turn ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) - 2 * similarity, 9) AS depth FROM sim),
st AS (SELECT *, round(avg(similarity) OVER b, 9) AS ms, round(stddev_pop(similarity) OVER b, 9) AS ds, round(avg(depth) OVER b, 9) AS md, round(stddev_pop(depth) OVER b, 9) AS sd FROM dd WINDOW b AS (PARTITION BY bucket))
SELECT bucket, turn, depth, similarity <= greatest(0.0, round(ms - 0.5 * ds, 6)) AND depth >= round(md + 0.5 * sd, 6) AND ds > 0 AND sd > 0 AS outlier FROM st"""


def work_item_segments(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive events of an account are one work item while the pair's score stays at 4 or above, or at
    2 or above with a shared session (day) and a gap of at most 24 h."""
    w = Window.partitionBy("account").orderBy("started_at", "event_id")
    u = usage(spark, d).select("event_id", "account", "provider", "day", "started_at")
    gap = sequences.hour_gap(F.lag("started_at").over(w), F.col("started_at"))
    p = u.withColumn("gap", gap).withColumn("same_session", F.lag("day").over(w) == F.col("day")).withColumn("same_title", F.lag("provider").over(w) == F.col("provider"))
    near = F.when(F.col("gap") <= 1, 2).when(F.col("gap") <= 6, 1).when(F.col("gap") > 72, -3).when(F.col("gap") > 24, -1).otherwise(0)
    score = F.when(F.col("same_session"), 5).otherwise(0) + F.when(F.col("same_title"), 4).otherwise(-2) + near
    goes_on = (score >= 4) | ((score >= 2) & (F.col("same_session") | F.col("same_title")) & (F.col("gap") <= 24))
    new = F.when(F.col("gap").isNull(), 0).otherwise((~goes_on).cast("int"))
    return p.withColumn("new", new).withColumn("item", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("event_id", "account", "item")


SQL["work_item_segments"] = f"""WITH {U_SQL}, p AS (SELECT event_id, account, started_at, date_sub('hour', lag(started_at) OVER w, started_at) AS gap, lag(day) OVER w = day AS ss, lag(provider) OVER w = provider AS st FROM u WINDOW w AS (PARTITION BY account ORDER BY started_at, event_id)),
q AS (SELECT *, CASE WHEN ss THEN 5 ELSE 0 END + CASE WHEN st THEN 4 ELSE -2 END + CASE WHEN gap <= 1 THEN 2 WHEN gap <= 6 THEN 1 WHEN gap > 72 THEN -3 WHEN gap > 24 THEN -1 ELSE 0 END AS score FROM p),
r AS (SELECT *, CASE WHEN gap IS NULL THEN 0 WHEN score >= 4 OR (score >= 2 AND (ss OR st) AND gap <= 24) THEN 0 ELSE 1 END AS new FROM q)
SELECT event_id, account, CAST(sum(new) OVER (PARTITION BY account ORDER BY started_at, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS item FROM r"""


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred orders to review: open before partial before final, urgent first, dear first."""
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return read(spark, d, "orders").select("o_orderkey", rank.alias("rank"), "o_orderpriority", "o_totalprice").orderBy("rank", "o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(100)


SQL["review_queue"] = "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS rank, o_orderpriority, o_totalprice FROM orders ORDER BY rank, o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 100"


def merge_ranges(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("account"), F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), 60).alias("b"))
    return intervals.merge_overlapping(o, "account", "a", "b")


SQL["merge_ranges"] = """WITH o AS (SELECT o_custkey AS account, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 60 AS b FROM orders),
f AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY account ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM o),
i AS (SELECT *, sum(new) OVER (PARTITION BY account ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT account, min(a) AS a, max(b) AS b, count(*) AS n_ranges FROM i GROUP BY account, island"""


def issue_keys(spark: SparkSession, d: str) -> DataFrame:
    """Issue keys of a title made of an order's priority, status and key."""
    title = F.concat(F.lit("fix "), F.col("o_orderpriority"), F.lit(" ORD-"), F.col("o_orderkey").cast("string"), F.lit(", #"), F.col("o_custkey").cast("string"), F.lit(" X-1 AB-2x CD-3-tail #4a"))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(text.issue_keys(title), " ").alias("keys"))


SQL["issue_keys"] = r"""WITH t AS (SELECT o_orderkey, string_split_regex('fix ' || o_orderpriority || ' ORD-' || o_orderkey || ', #' || o_custkey || ' X-1 AB-2x CD-3-tail #4a', '[^A-Za-z0-9#-]+') AS p FROM orders),
k AS (SELECT DISTINCT o_orderkey, CASE WHEN regexp_full_match(x, '#[0-9]+') THEN x WHEN regexp_full_match(x, '[A-Z][A-Z0-9]+-[0-9]+(-.*)?') THEN regexp_extract(x, '^([A-Z][A-Z0-9]+-[0-9]+)', 1) END AS key FROM (SELECT o_orderkey, unnest(p) AS x FROM t))
SELECT o_orderkey, string_agg(key, ' ' ORDER BY key) AS keys FROM k WHERE key IS NOT NULL GROUP BY o_orderkey"""


def benchmark_f1(spark: SparkSession, d: str) -> DataFrame:
    """Pairwise precision and recall of day sessions against 6 h gap sessions, from contingency counts: no pair is made."""
    s = sequences.gap_sessions(usage(spark, d), "account", "started_at", "event_id", 6)
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    cells = s.groupBy("account", "day", "session").agg(F.count("*").alias("n"))
    tp = cells.agg(pairs("n").alias("tp"))
    predicted = cells.groupBy("account", "session").agg(F.sum("n").alias("n")).agg(pairs("n").alias("predicted"))
    truth = cells.groupBy("account", "day").agg(F.sum("n").alias("n")).agg(pairs("n").alias("truth"))
    one = tp.join(predicted).join(truth)  # three single rows
    p, r = numbers.ratio(F.col("tp"), F.col("predicted")), numbers.ratio(F.col("tp"), F.col("truth"))
    return one.select(F.col("tp").cast("long").alias("tp"), F.col("predicted").cast("long").alias("predicted"), F.col("truth").cast("long").alias("truth"), F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(numbers.ratio(2 * p * r, p + r), 9).alias("f1"))


SQL["benchmark_f1"] = f"""WITH s AS ({SQL["gap_sessions_6h"]}), j AS (SELECT s.account, s.session, CAST(e.ts AS DATE) AS day FROM s JOIN events e USING (event_id)),
c AS (SELECT account, day, session, count(*) AS n FROM j GROUP BY ALL), tp AS (SELECT sum(n * (n - 1) // 2) AS v FROM c),
pr AS (SELECT sum(n * (n - 1) // 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY account, session)), tr AS (SELECT sum(n * (n - 1) // 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY account, day))
SELECT CAST(tp.v AS BIGINT) AS tp, CAST(pr.v AS BIGINT) AS predicted, CAST(tr.v AS BIGINT) AS truth, round(tp.v / pr.v, 9) AS precision, round(tp.v / tr.v, 9) AS recall, round(2 * (tp.v / pr.v) * (tp.v / tr.v) / (tp.v / pr.v + tp.v / tr.v), 9) AS f1 FROM tp, pr, tr"""


def dedupe_exact(spark: SparkSession, d: str) -> DataFrame:
    """One event of each fingerprint, the first by arrival: an aggregate, so that copies combine map-side."""
    keys = {"provider": "event_type", "account": "user_id", "minute": "m"}
    e = read(spark, d, "events").withColumn("m", F.date_trunc("hour", F.col("ts")))
    return e.groupBy(*[F.col(c).alias(n) for n, c in keys.items()]).agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))


SQL["dedupe_exact"] = "SELECT event_type AS provider, user_id AS account, date_trunc('hour', ts) AS minute, min(event_id) AS event_id, count(*) AS n FROM events GROUP BY event_type, user_id, date_trunc('hour', ts)"


def dedupe_wildcard(spark: SparkSession, d: str) -> DataFrame:
    """Events of a provider, account and hour that are equal where both know the reasoning level (props.k over 90: unknown)."""
    e = read(spark, d, "events")
    level = (F.get_json_object("props", "$.k").cast("int") / 30).cast("int").cast("string")
    rows = e.select(F.col("event_type").alias("provider"), F.col("user_id").alias("account"), F.date_trunc("hour", F.col("ts")).alias("hour"), F.col("event_id").alias("arrival"), F.when(level == "3", F.lit(None)).otherwise(level).alias("level"))
    return dedupe.wildcard(rows, ["provider", "account", "hour"], "arrival", "level")


def title_selection(spark: SparkSession, d: str) -> DataFrame:
    """The best title of each conversation, from its user turns."""
    c = read(spark, d, "conversations").filter("role = 'user'")
    return titles.best_titles(c.select(F.col("conv_id").alias("bucket"), F.col("turn").alias("ordinal"), "text"))


for _f in (adjacent_pairs, topic_window_similarity, boundary_outliers, work_item_segments, review_queue, merge_ranges, issue_keys, benchmark_f1, dedupe_exact, dedupe_wildcard, title_selection):
    Q[_f.__name__] = _f
