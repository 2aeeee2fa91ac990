"""Reported usage summaries from JSON, and commits from Git repositories."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmeter.functions import identity
from quillmeter.functions.records import committer_hash

# The schema of a report, its kinds, and the window of commits.
REPORT_SCHEMA = "reported_usage_summary_input.v1"
REPORT_KINDS = ["external_report", "manual"]
LOOKBACK_DAYS, SKEW_DAYS = 90, 1
_COUNTS = ["input_tokens", "cache_creation_tokens", "cache_read_tokens", "output_tokens"]
_REPORT = f"""schema_version string, provider string, source_kind string, source_name string, report_format string, evidence_path string, evidence_id string,
 period_start timestamp, period_end timestamp, observed_at timestamp, usage struct<{", ".join(f"{c}: bigint" for c in _COUNTS)}, total_tokens: bigint>"""


def reported_summaries(spark: SparkSession, path: str, schema_version: str = REPORT_SCHEMA) -> DataFrame:
    """Reports of a folder of JSON files (an object each), with summary_id, total_tokens and problem: 'schema', 'kind',
    'zero' (no tokens) or null for those to import. Malformed files are 'schema'. Equal reports share a summary_id."""
    r = spark.read.schema(_REPORT).json(path, multiLine=True)
    counts = [F.coalesce(f"usage.{c}", F.lit(0)) for c in _COUNTS]
    total = F.coalesce("usage.total_tokens", sum(counts, F.lit(0)))
    evidence = F.coalesce("evidence_path", "evidence_id", F.concat_ws(":", "provider", "source_name", "report_format"))
    source = identity.source_id(F.col("provider"), F.col("source_kind"), evidence)
    times = [F.coalesce(identity.rfc3339(F.col(c)), F.lit(f"unknown_{c.removeprefix('period_')}")) for c in ("period_start", "period_end")]
    key = identity.hashed_id("sum_", 32, F.lit("reported_summary.v1"), source, F.col("report_format"), *times, *counts, total)
    problem = F.when(~F.col("schema_version").eqNullSafe(F.lit(schema_version)), "schema").when(~F.coalesce(F.col("source_kind").isin(REPORT_KINDS), F.lit(False)), "kind").when(total == 0, "zero")
    observed = F.coalesce("observed_at", "period_end", "period_start")
    return r.select(key.alias("summary_id"), source.alias("source_id"), "provider", "source_kind", "report_format", "period_start", "period_end", observed.alias("observed_at"), total.alias("total_tokens"), problem.alias("problem"))


def git_commits(spark: SparkSession, roots: list[str], identities: DataFrame, now: datetime) -> DataFrame:
    """root, commit_hash, committed_at, committer_hash of the commits on HEAD and branches of the last 90 days, without
    merges and those over a day ahead of now, by the committers in identities (committer_hash).

    A task a repository, which runs git: roots are folders that the executors see. A root without a repository has none."""
    since = (now - timedelta(days=LOOKBACK_DAYS)).isoformat()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for root in batch.column(0).to_pylist():
                log = subprocess.run(["git", "-C", root, "log", "HEAD", "--branches", f"--since={since}", "--format=%H%x09%cI%x09%P%x09%ce"], capture_output=True, text=True, check=False)
                out += [(root, *line.split("\t")) for line in log.stdout.splitlines()]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["root", "commit_hash", "committed_at", "parents", "email"])

    tasks = spark.createDataFrame([(r,) for r in roots], "root string").repartition(max(len(roots), 1), "root")
    commits = tasks.mapInArrow(run, "root string, commit_hash string, committed_at string, parents string, email string")
    commits = commits.filter(~F.col("parents").contains(" ")).select("root", "commit_hash", F.to_timestamp("committed_at").alias("committed_at"), committer_hash(F.col("email")).alias("committer_hash"))
    ahead = F.lit((now + timedelta(days=SKEW_DAYS)).isoformat()).cast("timestamp")
    return commits.filter(F.col("committed_at") <= ahead).join(identities.select("committer_hash").distinct(), "committer_hash", "left_semi").distinct()
