"""Calls of tools and their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States of a failed call.
FAILED = ["failed", "error", "rejected", "cancelled", "canceled"]


def result_failed(result: Column, status: Column) -> Column:
    """Whether a result (JSON) tells of failure: by its status, an error mark, success = false or an exit code that
    isn't 0, which may lie in JSON text inside `output`. Results without any of these haven't failed."""
    at = lambda c, p: F.get_json_object(c, p)
    error = F.coalesce(at(result, "$.is_error"), at(result, "$.isError")) == "true"
    unsuccessful = at(result, "$.success") == "false"
    inner = at(result, "$.output")
    code = F.coalesce(at(result, "$.metadata.exit_code"), at(inner, "$.metadata.exit_code")).try_cast("bigint")
    no = F.lit(False)
    return F.coalesce(F.lower(status).isin(FAILED), no) | F.coalesce(error, no) | F.coalesce(unsuccessful, no) | F.coalesce(code != 0, no)


def paired_calls(items: DataFrame) -> DataFrame:
    """items (conversation, ordinal, call_id, kind 'call' or 'result', tool, status, body) as one row a call: conversation,
    call_id, ordinal, tool, body, result and state: 'done', 'failed' or 'truncated' (no result after the call).

    One group by conversation and call, whose latest call and first later result count. Items without a call_id are
    in no call; results without a call are dropped from the list, as there is nothing to apply."""
    known = items.filter(F.col("call_id").isNotNull())
    call = F.max(F.when(F.col("kind") == "call", F.struct("ordinal", "tool", "body"))).alias("c")
    results = F.array_sort(F.collect_list(F.when(F.col("kind") == "result", F.struct("ordinal", "status", "body")))).alias("r")
    grouped = known.groupBy("conversation", "call_id").agg(call, results).filter("c is not null")
    first = F.get(F.filter("r", lambda r: r["ordinal"] > F.col("c.ordinal")), F.lit(0))
    rows = grouped.withColumn("_r", first)
    failed = result_failed(F.col("_r.body"), F.col("_r.status"))
    state = F.when(F.col("_r").isNull(), "truncated").when(failed, "failed").otherwise("done")
    return rows.select("conversation", "call_id", "c.ordinal", "c.tool", "c.body", F.col("_r.body").alias("result"), state.alias("state"))
