"""Assistants' logs on disk: JSON lines to conversation items and usage events.

Files are read as text, a line a row; records beyond MAX_RECORD bytes and malformed ones are counted, not
fatal. Everything that depends on the order of lines is a window over (file, line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value: the ceiling of one record, in bytes.
MAX_RECORD = 16 * 1024 * 1024


def _at(path: str) -> Column:
    return F.get_json_object("value", f"$.{path}")


def json_lines(spark: SparkSession, paths: str | list[str], glob: str = "*.jsonl") -> DataFrame:
    """file, line (increasing within a file), value, problem ('oversized', 'malformed' or null) of nonblank lines."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(paths)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value").filter(F.trim("value") != "")
    problem = F.when(F.octet_length("value") > MAX_RECORD, "oversized").when(F.try_parse_json("value").isNull() | ~F.ltrim("value").startswith("{"), "malformed")
    return rows.withColumn("problem", problem)


def diagnostics(lines: DataFrame) -> DataFrame:
    return lines.filter("problem is not null").groupBy("file", "problem").agg(F.count("*").alias("n"))


def _text(content: str) -> Column:
    """The text of a message whose content is a string or an array of parts with text."""
    parts = F.from_json(content, "array<struct<type string, text string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: p["text"]), "\n")
    return F.when(F.col(content).startswith("["), joined).otherwise(F.col(content))


def codex_items(lines: DataFrame) -> DataFrame:
    """file, conversation_id, ordinal, role, text, model, created_at; the model is carried on from the latest turn_context."""
    good = lines.filter("problem is null").select("file", "line", _at("type").alias("type"), _at("payload.type").alias("kind"), _at("payload.id").alias("id"), _at("payload.model").alias("own_model"), _at("payload.role").alias("role"), _at("payload.content").alias("content"), _at("timestamp").alias("created_at"))
    w = Window.partitionBy("file").orderBy("line")
    model = F.last(F.when(F.col("type") == "turn_context", F.col("own_model")), ignorenulls=True).over(w)
    session = F.max_by(F.when(F.col("type") == "session_meta", F.col("id")), F.when((F.col("type") == "session_meta") & F.col("id").isNotNull(), F.col("line"))).over(Window.partitionBy("file"))
    items = good.withColumn("model", model).withColumn("conversation_id", F.coalesce(session, F.regexp_extract("file", r"([^/]+)\.jsonl$", 1))).filter("type = 'response_item' and kind = 'message'")
    return items.select("file", "conversation_id", (F.row_number().over(w) - 1).alias("ordinal"), "role", _text("content").alias("text"), "model", F.to_timestamp("created_at").alias("created_at"))


def codex_usage(lines: DataFrame) -> DataFrame:
    """One usage event a token_count record: input net of cached tokens, output net of reasoning tokens."""
    n = lambda p: F.coalesce(_at(f"payload.info.last_token_usage.{p}").cast("long"), F.lit(0))
    good = lines.filter("problem is null").filter((_at("type") == "event_msg") & (_at("payload.type") == "token_count") & _at("payload.info.last_token_usage").isNotNull())
    return good.select(
        F.lit("codex").alias("provider"), "file", "line", F.to_timestamp(_at("timestamp")).alias("started_at"),
        (n("input_tokens") - n("cached_input_tokens")).alias("input_tokens"), n("cached_input_tokens").alias("cache_read_tokens"), F.lit(0).cast("long").alias("cache_creation_tokens"),
        (n("output_tokens") - n("reasoning_output_tokens")).alias("output_tokens"), n("reasoning_output_tokens").alias("reasoning_tokens"), n("total_tokens").alias("total_tokens"),
    )


def claude_items(lines: DataFrame) -> DataFrame:
    good = lines.filter("problem is null").filter(_at("type").isin("user", "assistant"))
    rows = good.select("file", "line", F.coalesce(_at("sessionId"), F.regexp_extract("file", r"([^/]+)\.jsonl$", 1)).alias("conversation_id"), _at("message.role").alias("role"), _at("message.content").alias("content"), _at("message.model").alias("model"), _at("timestamp").alias("created_at"))
    w = Window.partitionBy("file", "conversation_id").orderBy("line")
    return rows.select("file", "conversation_id", (F.row_number().over(w) - 1).alias("ordinal"), "role", _text("content").alias("text"), "model", F.to_timestamp("created_at").alias("created_at"))


def claude_usage(lines: DataFrame) -> DataFrame:
    """One usage event a request: the lines of one request repeat its usage, and the last one counts."""
    n = lambda p: F.coalesce(_at(f"message.usage.{p}").cast("long"), F.lit(0))
    good = lines.filter("problem is null").filter((_at("type") == "assistant") & _at("message.usage").isNotNull())
    request = F.coalesce(_at("requestId"), _at("message.id"), F.concat_ws(":", "file", "line"))
    kinds = {"input_tokens": n("input_tokens"), "cache_read_tokens": n("cache_read_input_tokens"), "cache_creation_tokens": n("cache_creation_input_tokens"), "output_tokens": n("output_tokens") - n("output_tokens_details.thinking_tokens"), "reasoning_tokens": n("output_tokens_details.thinking_tokens")}
    rows = good.select(request.alias("request"), F.struct("line", "file", F.to_timestamp(_at("timestamp")).alias("started_at"), *[v.alias(k) for k, v in kinds.items()]).alias("r"))
    total = sum((F.col(f"r.{k}") for k in kinds), F.lit(0))
    return rows.groupBy("request").agg(F.max("r").alias("r")).select(F.lit("claude").alias("provider"), "r.file", "r.line", "r.started_at", *[F.col(f"r.{k}").alias(k) for k in kinds], total.cast("long").alias("total_tokens"))


def grok_items(lines: DataFrame) -> DataFrame:
    good = lines.filter("problem is null")
    rows = good.select("file", "line", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("conversation_id"), _at("type").alias("role"), _at("content").alias("content"), _at("model_id").alias("model"))
    w = Window.partitionBy("file").orderBy("line")
    return rows.select("file", "conversation_id", (F.row_number().over(w) - 1).alias("ordinal"), "role", _text("content").alias("text"), "model", F.lit(None).cast("timestamp").alias("created_at"))


#: Item readers by provider; an unknown provider has no items.
READERS = {"codex": codex_items, "claude": claude_items, "grok": grok_items}


def provider_items(spark: SparkSession, provider: str, paths: str | list[str]) -> DataFrame:
    if provider not in READERS:
        return spark.createDataFrame([], "file string, conversation_id string, ordinal int, role string, text string, model string, created_at timestamp")
    return READERS[provider](json_lines(spark, paths, "chat_history.jsonl" if provider == "grok" else "*.jsonl"))


def stats_cache(spark: SparkSession, path: str) -> DataFrame:
    """model and token counts of a stats cache file."""
    usage = "struct<inputTokens: bigint, outputTokens: bigint, cacheReadInputTokens: bigint, cacheCreationInputTokens: bigint>"
    rows = spark.read.schema(f"lastComputedDate string, modelUsage map<string, {usage}>").json(path, multiLine=True)
    return rows.select(F.to_date("lastComputedDate").alias("day"), F.explode("modelUsage").alias("model", "u")).select("day", "model", "u.*")
