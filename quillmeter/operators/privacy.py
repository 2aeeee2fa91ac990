"""Private values in text: detection in UTF-8 byte spans, merging, masking."""

from __future__ import annotations

import ipaddress
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPAN = "start int, end int, category string, value string"
#: Categories by priority: of overlapping spans the higher names the union, the earlier detector breaks ties.
PRIORITY = {"secret": 3, "email": 2, "url": 2, "ip": 2, "phone": 1}
PATTERNS = {
    "secret": re.compile(r"\b(?:sk|pk|ghp|gho|xox[abp]|AKIA)[-_A-Za-z0-9]{12,}\b|-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    "email": re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b"),
    "url": re.compile(r"\bhttps?://[^\s<>\"')\]]+"),
    "ip": re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w.])"),
    "phone": re.compile(r"(?<![\w+])\+?\d{1,3}[ -]?\(?\d{2,4}\)?(?:[ -]\d{2,4}){2,3}(?!\w)"),
}


def detect(text: str) -> list[tuple[int, int, str]]:
    """Spans in characters; four parts up to 255 make an address."""
    out = []
    for category, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            if category == "ip":
                try:
                    ipaddress.ip_address(m[0])
                except ValueError:
                    continue
            out.append((m.start(), m.end(), category))
    return out


def merge(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Unions of overlapping spans, named by the highest priority."""
    out: list[tuple[int, int, str]] = []
    for start, end, category in sorted(spans, key=lambda s: (s[0], -s[1], -PRIORITY[s[2]], s[2])):
        if out and start < out[-1][1]:
            a, b, c = out[-1]
            out[-1] = (a, max(b, end), category if PRIORITY[category] > PRIORITY[c] else c)
        else:
            out.append((start, end, category))
    return out


def find_spans(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, start, end (UTF-8 bytes), category, value of the merged spans of each text."""

    def run(batches):
        for batch in batches:
            out = []
            for k, x in zip(batch.column(0), batch.column(1), strict=True):
                t = x.as_py() or ""
                for a, b, c in merge(detect(t)):
                    start = len(t[:a].encode())
                    out.append((k.as_py(), start, start + len(t[a:b].encode()), c, t[a:b]))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema[0].type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3]), pa.array(cols[4])], names=[key, "start", "end", "category", "value"])

    source = rows.select(key, column)
    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"{key} {kind}, {SPAN}")


def allocate_aliases(values: DataFrame, known: DataFrame) -> DataFrame:
    """category, value, alias: known ones keep theirs, new ones are numbered after the category's last in order of value.

    Numbers are two-level: hash ranges of values are counted apart, so that no category is numbered in one task."""
    new = values.select("category", "value").distinct().join(known, ["category", "value"], "left_anti")
    cells = new.withColumn("cell", F.substring("value", 1, 2))
    sizes = cells.groupBy("category", "cell").agg(F.count("*").alias("k"))
    before = Window.partitionBy("category").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("category", "cell", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    last = known.groupBy("category").agg(F.max("alias").alias("last"))
    rank = F.row_number().over(Window.partitionBy("category", "cell").orderBy("value"))
    numbered = cells.withColumn("rank", rank).join(sizes, ["category", "cell"]).join(last, "category", "left")
    return known.select("category", "value", "alias").unionByName(numbered.select("category", "value", (F.coalesce("last", F.lit(0)) + F.col("base") + F.col("rank")).cast("long").alias("alias")))
