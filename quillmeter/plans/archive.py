"""Conversation archive, search, code changes, privacy and export."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmeter.functions import numbers, paths
from quillmeter.operators import attribution, exchange, privacy, search
from quillmeter.streaming.rollups import incremental_rollup

from .model import U_SQL, read, usage

Q, SQL = {}, {}
TERMS = ["the", "and", "thing"]


def add(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


@add("SELECT conv_id, count(*) AS n_items, count(text) AS n_parts, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS n_bytes, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def archive_listing(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_items"), F.count("text").alias("n_parts"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("n_bytes"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@add("""SELECT count(DISTINCT conv_id) AS conversations, count(*) AS items, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS user_items, CAST(sum(CASE WHEN role = 'assistant' THEN strlen(text) ELSE 0 END) AS BIGINT) AS assistant_bytes, max(strlen(text)) AS longest FROM conversations""")
def archive_stats(spark: SparkSession, d: str) -> DataFrame:
    n = F.octet_length("text")
    return read(spark, d, "conversations").agg(F.count_distinct("conv_id").alias("conversations"), F.count("*").alias("items"), F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).alias("user_items"), F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).cast("long").alias("assistant_bytes"), F.max(n).cast("long").alias("longest"))


_OLD = "old AS (SELECT conv_id, min(turn) AS started, max(turn) AS updated, min(text) AS title, count(*) AS items FROM conversations WHERE role <> 'assistant' GROUP BY conv_id)"
_NEW = "new AS (SELECT conv_id, min(turn) AS started, max(turn) AS updated, CASE WHEN count(*) > 2 THEN max(text) END AS title, count(*) AS items FROM conversations WHERE role = 'assistant' GROUP BY conv_id)"


def merge_archives(old: DataFrame, new: DataFrame) -> DataFrame:
    """Additive merge of conversation headers: the new title if there is one, the earlier start, the later update,
    the richer item count. One aggregation over both, new before old, instead of a full join."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    pick = F.max(F.when(F.col("title").isNotNull(), F.struct("_new", "title")))["title"]
    return both.groupBy("conv_id").agg(pick.alias("title"), F.min("started").alias("started"), F.max("updated").alias("updated"), F.max("items").alias("items")).withColumn("completeness", F.when(F.col("items") > 0, "complete").otherwise("metadata_only"))


@add(f"""WITH {_OLD}, {_NEW} SELECT coalesce(o.conv_id, n.conv_id) AS conv_id, coalesce(n.title, o.title) AS title, least(o.started, n.started) AS started, greatest(o.updated, n.updated) AS updated, greatest(o.items, n.items) AS items,
 CASE WHEN greatest(o.items, n.items) > 0 THEN 'complete' ELSE 'metadata_only' END AS completeness FROM old o FULL JOIN new n ON o.conv_id = n.conv_id""")
def archive_merge(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    head = lambda rows, title: rows.groupBy("conv_id").agg(F.min("turn").alias("started"), F.max("turn").alias("updated"), title.alias("title"), F.count("*").alias("items"))
    return merge_archives(head(c.filter("role <> 'assistant'"), F.min("text")), head(c.filter("role = 'assistant'"), F.when(F.count("*") > 2, F.max("text"))))


_TOKENS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


@add(f"""WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents) SELECT doc_id, CAST(len(list_filter(t, lambda x: x IN ('the', 'and'))) AS INTEGER) AS n_hits FROM t WHERE list_contains(t, 'the') AND list_contains(t, 'and')""")
def fts_and_search(spark: SparkSession, d: str) -> DataFrame:
    return search.all_terms(read(spark, d, "documents"), "doc_id", "text", ["the", "and"])


_tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(TERMS))
_df = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS df{i}" for i in range(len(TERMS)))
_score = " + ".join(f"ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(TERMS)))


@add(f"""WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents), c AS (SELECT doc_id, len(t) AS length, {_tf} FROM t), s AS (SELECT count(*) AS n, avg(length) AS mean, {_df} FROM c)
SELECT doc_id, round({_score}, 6) AS score FROM c, s WHERE tf0 + tf1 + tf2 > 0 ORDER BY round({_score}, 6) DESC, doc_id LIMIT 50""")
def fts_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(read(spark, d, "documents"), "doc_id", "text", TERMS).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(50)


@add(f"""WITH t AS (SELECT doc_id, list_distinct({_TOKENS}) AS t FROM documents), n AS (SELECT count(*) AS n FROM documents), f AS (SELECT tok AS token, count(*) AS df FROM (SELECT unnest(t) AS tok FROM t) GROUP BY tok)
SELECT token, df, round(ln((n + 1) / (df + 1)), 9) AS idf FROM f, n""")
def doc_frequency_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    from quillmeter.functions.text import tokens

    f = docs.select(F.explode(F.array_distinct(tokens(F.coalesce("text", F.lit(""))))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    return f.join(F.broadcast(n)).select("token", "df", F.round(numbers.smoothed_idf(F.col("n"), F.col("df")), 9).alias("idf"))  # one row


_PATHS = """'src/' || p_brand || '/' || CASE p_size % 5 WHEN 0 THEN 'tests/' WHEN 1 THEN 'vendor/' WHEN 2 THEN 'lib\\' ELSE '' END || replace(p_name, ' ', '_') || CASE p_partkey % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.test.ts' WHEN 2 THEN '.min.js' WHEN 3 THEN '.md' WHEN 4 THEN '_test.go' WHEN 5 THEN '.RS' ELSE '' END"""
_lists = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@add(f"""WITH p AS (SELECT p_partkey, {_PATHS} AS path FROM part), q AS (SELECT p_partkey, path, string_split(replace(lower(path), chr(92), '/'), '/') AS parts FROM p), r AS (SELECT *, parts[-1] AS name FROM q),
s AS (SELECT *, CASE WHEN regexp_full_match(name, '.+\\.[^.]*') THEN string_split(name, '.')[-1] END AS ext,
 len(list_intersect(parts, {_lists(paths.EXCLUDED_DIRECTORIES)})) > 0 OR list_contains({_lists(paths.LOCK_FILES)}, name) OR regexp_matches(name, '(\\.min\\.js|\\.min\\.css|\\.map)$') AS excluded,
 len(list_intersect(parts, {_lists(paths.TEST_DIRECTORIES)})) > 0 OR contains(name, '.test.') OR contains(name, '.spec.') OR starts_with(name, 'test_') OR regexp_matches(name, '(_test\\.rs|_tests\\.rs|_test\\.go|tests\\.swift|_test\\.py)$') AS test FROM r)
SELECT p_partkey, path, CASE WHEN NOT excluded AND list_contains({_lists(paths.CODE_EXTENSIONS)}, ext) THEN CASE WHEN test THEN 'test' ELSE 'source' END END AS category FROM s""")
def path_classify(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    folder = F.when(F.col("p_size") % 5 == 0, "tests/").when(F.col("p_size") % 5 == 1, "vendor/").when(F.col("p_size") % 5 == 2, "lib\\").otherwise("")
    ending = F.lit("")
    k = F.col("p_partkey") % 7
    ending = F.when(k == 0, ".py").when(k == 1, ".test.ts").when(k == 2, ".min.js").when(k == 3, ".md").when(k == 4, "_test.go").when(k == 5, ".RS").otherwise("")
    path = F.concat(F.lit("src/"), "p_brand", F.lit("/"), folder, F.replace("p_name", F.lit(" "), F.lit("_")), ending)
    return part.select("p_partkey", path.alias("path")).withColumn("category", paths.category(F.col("path")))


@add("""SELECT CAST(l_shipdate AS DATE) AS day, CASE l_returnflag WHEN 'A' THEN 'written' WHEN 'N' THEN 'committed' ELSE 'attributed' END AS kind, l_suppkey AS project, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS additions, CAST(sum(CAST(l_linenumber AS BIGINT)) AS BIGINT) AS deletions FROM lineitem GROUP BY ALL""")
def code_metrics_daily(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "written").when(F.col("l_returnflag") == "N", "committed").otherwise("attributed")
    return read(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"), kind.alias("kind"), F.col("l_suppkey").alias("project")).agg(F.sum(F.col("l_quantity").cast("long")).alias("additions"), F.sum(F.col("l_linenumber").cast("long")).alias("deletions"))


def trace_match_topk(spark: SparkSession, d: str) -> DataFrame:
    """Documents as edits, matched to the documents of the same source and first line as commits: lines in order."""
    docs = read(spark, d, "documents").filter("text is not null")
    lines = F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x))
    path = F.concat("source", F.lit("/"), F.sha2(F.split("text", "\n")[0], 256))
    at = F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(F.col("n_chars") % 40)
    edits = docs.select(F.col("doc_id").alias("edit_id"), path.alias("path"), F.to_timestamp(F.lit("2024-01-01")).alias("at"), lines.alias("lines"))
    changes = docs.select(F.col("doc_id").alias("commit_id"), path.alias("path"), at.alias("at"), lines.alias("lines"))
    return attribution.match(edits, changes)


Q["trace_match_topk"] = trace_match_topk


@add()
def pii_regex_spans(spark: SparkSession, d: str) -> DataFrame:
    return privacy.find_spans(read(spark, d, "documents"), "doc_id", "text").drop("value")


@add("""WITH v AS (SELECT DISTINCT c_mktsegment AS category, c_name AS value FROM customer), k AS (SELECT category, value, row_number() OVER (PARTITION BY category ORDER BY value) AS alias FROM v WHERE value < 'Customer#000000100'),
n AS (SELECT category, value FROM v WHERE NOT (value < 'Customer#000000100')), m AS (SELECT category, max(alias) AS last FROM k GROUP BY category)
SELECT category, value, alias FROM k UNION ALL SELECT n.category, n.value, coalesce(m.last, 0) + row_number() OVER (PARTITION BY n.category ORDER BY n.value) FROM n LEFT JOIN m USING (category)""")
def pseudonym_alias(spark: SparkSession, d: str) -> DataFrame:
    """Aliases of customers by segment: those before the hundredth are known already."""
    v = read(spark, d, "customer").select(F.col("c_mktsegment").alias("category"), F.col("c_name").alias("value")).distinct()
    known = v.filter("value < 'Customer#000000100'").withColumn("alias", F.row_number().over(Window.partitionBy("category").orderBy("value")).cast("long"))
    return privacy.allocate_aliases(v, known)


_SENT = "sent AS (SELECT c_custkey AS id, sha256(c_mktsegment || c_nationkey) AS hash FROM customer WHERE c_acctbal > 0 UNION ALL SELECT -s_suppkey - 1, sha256(s_name) FROM supplier)"


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, d, "customer")
    h = lambda *x: F.sha2(F.concat(*x), 256)
    current = c.select(F.col("c_custkey").alias("id"), h("c_mktsegment", F.when(F.col("c_acctbal") > 9000, F.lit("x")).otherwise(F.col("c_nationkey").cast("string"))).alias("hash"))
    sent = c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), h("c_mktsegment", F.col("c_nationkey").cast("string")).alias("hash"))
    return current, sent.unionByName(read(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("id"), h("s_name").alias("hash")))


@add(f"""WITH cur AS (SELECT c_custkey AS id, sha256(c_mktsegment || CASE WHEN c_acctbal > 9000 THEN 'x' ELSE CAST(c_nationkey AS VARCHAR) END) AS hash FROM customer), {_SENT}
SELECT cur.id, cur.hash FROM cur LEFT JOIN sent USING (id) WHERE cur.hash IS DISTINCT FROM sent.hash""")
def sync_pending(spark: SparkSession, d: str) -> DataFrame:
    return exchange.pending(*_states(spark, d), "id")


@add(f"WITH {_SENT} SELECT id FROM sent WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = sent.id)")
def sync_retired(spark: SparkSession, d: str) -> DataFrame:
    return exchange.retired(*_states(spark, d), "id")


@add("""SELECT 'lineitem' AS kind, count(*) AS n FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderkey IS NULL
UNION ALL SELECT 'orders', count(*) FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_custkey IS NULL UNION ALL SELECT 'events', count(*) FROM events LEFT JOIN customer ON user_id = c_custkey WHERE c_custkey IS NULL
UNION ALL SELECT 'labels', count(*) FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id WHERE d.doc_id IS NULL""")
def orphan_check(spark: SparkSession, d: str) -> DataFrame:
    links = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("events", "user_id", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id")]
    out = None
    for child, key, parent, of in links:
        lone = read(spark, d, child).select(F.col(key).alias("k")).join(read(spark, d, parent).select(F.col(of).alias("k")), "k", "left_anti")
        one = lone.agg(F.lit(child).alias("kind"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@add("SELECT c_nationkey AS repository, CASE WHEN min(c) = max(c) THEN min(c) ELSE 'partial' END AS coverage FROM (SELECT c_nationkey, CASE WHEN c_acctbal > 9900 THEN 'partial' ELSE 'complete' END AS c FROM customer) GROUP BY c_nationkey")
def coverage_reduce(spark: SparkSession, d: str) -> DataFrame:
    from quillmeter.operators.sequences import reduce_coverage

    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("repository"), F.when(F.col("c_acctbal") > 9900, "partial").otherwise("complete").alias("c"))
    return c.groupBy("repository").agg(reduce_coverage("c").alias("coverage"))


@add(f"WITH {U_SQL} SELECT provider, account, day, count(*) AS requests, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM u GROUP BY ALL")
def stream_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    """The daily rollup, built from the events as a stream of files."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"file://{os.path.join(tempfile.gettempdir(), 'quillmeter-checkpoints')}"

    def rollup(rows: DataFrame) -> DataFrame:
        u = rows.select(F.col("event_type").alias("provider"), F.col("user_id").alias("account"), "day", F.floor(F.col("value") * 100).cast("long").alias("t"))
        return u.groupBy("provider", "account", "day").agg(F.count("*").alias("requests"), F.sum("t").alias("total_tokens"))

    events = read(spark, d, "events")
    out = incremental_rollup(spark, f"{d}/events.parquet*", events.schema, f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}", rollup)
    return out.select("provider", "account", F.to_date("day").alias("day"), "requests", "total_tokens")


__all__ = ["Q", "SQL", "usage"]
