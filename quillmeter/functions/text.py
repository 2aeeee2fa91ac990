"""Tokens, issue keys and titles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric tokens, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def issue_keys(text: Column) -> Column:
    """Sorted distinct issue keys: ABC-12 (the first two parts of a dashed token) and #7."""
    parts = F.split(text, r"[^A-Za-z0-9#-]+")
    keys = F.transform(parts, lambda p: F.when(p.rlike(r"^#[0-9]+$"), p).when(p.rlike(r"^[A-Z][A-Z0-9]+-[0-9]+(-.*)?$"), F.regexp_extract(p, r"^([A-Z][A-Z0-9]+-[0-9]+)", 1)))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: k.isNotNull())))


def topic_tokens(text: Column, stop_words: list[str]) -> Column:
    """Sorted distinct tokens of three bytes or more that aren't stop words."""
    return F.array_sort(F.array_distinct(F.filter(tokens(text), lambda t: (F.octet_length(t) >= 3) & ~t.isin(stop_words))))


def truncated(text: Column, width: int) -> Column:
    """At most width characters, the last three dots if something was cut."""
    return F.when(F.char_length(text) > width, F.concat(F.rtrim(F.substring(text, 1, width - 3)), F.lit("..."))).otherwise(text)


def base64_bytes(encoded: Column) -> Column:
    """Decoded length of base64 text."""
    bare = F.rtrim(encoded, F.lit("="))
    return F.floor(F.length(bare) * 3 / 4).cast("long")


def epoch_timestamp(value: Column) -> Column:
    """Epoch seconds below ten thousand million, else milliseconds."""
    return F.timestamp_millis(F.when(F.abs(value) < 10_000_000_000, value * 1000).otherwise(value))


def human_tokens(n: Column) -> Column:
    return F.when(n >= 1_000_000_000, F.format_string("%.1fB", n / 1e9)).when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1000, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("string"))
