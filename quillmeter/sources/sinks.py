"""Sinks: JSON lines in order, and export that fails closed."""

from __future__ import annotations

import sys
from typing import TextIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the schema of a manifest.
MANIFEST = "filtered_export.v1"


def write_ordered_json(rows: DataFrame, path: str, *order: str) -> None:
    """JSON lines in part files that are in order one after another; the commit is the writer's."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def print_json(rows: DataFrame, *order: str, out: TextIO | None = None) -> int:
    """Rows as JSON lines on standard output, in order; partitions come to the driver one after another. Returns their number."""
    lines = rows.orderBy(*order) if order else rows
    n = 0
    for n, (line,) in enumerate(lines.select(F.to_json(F.struct("*"))).toLocalIterator(), 1):
        print(line, file=out or sys.stdout)
    return n


def export_spans(spans: DataFrame, path: str, form: str = "jsonl") -> None:
    """Spans or work items in part files: 'jsonl', an object a line, or 'json', an array a file."""
    if form not in ("json", "jsonl"):
        raise ValueError(f"unknown format {form}")
    if form == "jsonl":
        spans.write.json(path, ignoreNullFields=False)
        return

    def run(batches):
        lead = "["
        for batch in batches:
            out = []
            for line in batch.column(0).to_pylist():
                out.append(lead + line)
                lead = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if lead == "[" else "]"])], names=["value"])

    spans.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(run, "value string").write.text(path)


def export_filtered(conversations: DataFrame, filtered: DataFrame, failures: DataFrame, path: str) -> int:
    """Export filtered conversations (id, day, hash of the source, payload), or raise if any conversation is unfiltered,
    stale (its hash has changed) or has failed after it was filtered. A manifest is written
    beside it last, so an export without one is unfinished. Returns the number of rows."""
    current = conversations.join(filtered.select("id", F.col("hash").alias("seen"), "filtered_at"), "id", "left")
    current = current.join(failures.groupBy("id").agg(F.max("failed_at").alias("failed_at")), "id", "left")
    bad = current.filter(F.col("seen").isNull() | (F.col("seen") != F.col("hash")) | (F.col("failed_at") > F.col("filtered_at")))
    if n := bad.count():
        raise ValueError(f"{n} conversations are unfiltered, stale or failed")
    rows = filtered.join(conversations.select("id"), "id", "left_semi")
    write_ordered_json(rows.select("day", "id", "payload"), path, "day", "id")
    days = rows.agg(F.lit(MANIFEST).alias("schema"), F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    days.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path.rstrip('/')}.manifest")
    return days.first()["n"]
