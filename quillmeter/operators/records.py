"""Account resolution, conversation listings, work-item totals, retired and pending records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Identity sources that an assignment may replace.
REPLACEABLE = ["source_config", "user_configured", "manual_hint", "unknown", "unresolved"]


def resolve_account(detected: Column, identity: Column, assigned: Column) -> tuple[Column, Column]:
    """(account, identity source): a detected account with its own evidence stays; else the assigned one; else an
    account that only came from an assignment or hint is cleared. Blank accounts are absent ones and left as they are."""
    present = F.coalesce(F.trim(detected) != "", F.lit(False))
    own = present & identity.isNotNull() & ~F.coalesce(identity.isin(REPLACEABLE), F.lit(False))
    account = F.when(own, detected).when(assigned.isNotNull(), assigned).when(~present, detected)
    # Rows without evidence get none.
    source = F.when(own | identity.isNull(), identity).when(assigned.isNotNull(), "source_config").when(present, "unresolved").otherwise(identity)
    return account, source


def list_conversations(conversations: DataFrame, items: DataFrame, parts: DataFrame, provider: str | None = None, limit: int | None = None) -> DataFrame:
    """conversations (conversation, provider, ...) with n_items, n_parts, n_bytes of items (conversation, item, at)
    and parts (conversation, item, n_bytes), latest item first, those without a time last. Both sides are counted before
    they are joined, so nothing fans out. Without a provider all are listed; a limit is a top-k."""
    if provider is not None:
        conversations = conversations.filter(F.col("provider") == provider)
    by_part = parts.groupBy("conversation", "item").agg(F.count("*").alias("_p"), F.sum("n_bytes").alias("_b"))
    found = items.join(by_part, ["conversation", "item"], "left").groupBy("conversation")
    counted = found.agg(F.count("*").alias("n_items"), F.sum(F.coalesce("_p", F.lit(0))).alias("n_parts"), F.sum(F.coalesce("_b", F.lit(0))).alias("n_bytes"), F.max("at").alias("last_at"))
    out = conversations.join(counted, "conversation", "left").fillna(0, ["n_items", "n_parts", "n_bytes"])
    out = out.orderBy(F.col("last_at").desc_nulls_last(), "conversation")
    return out if limit is None else out.limit(limit)


def work_item_totals(spans: DataFrame, key: list[str], order: list[str], sums: list[str], firsts: list[str], sets: list[str]) -> DataFrame:
    """One row a work item: sums that stay null if all are null, the first value in order that isn't null (of ties the least), and
    sorted sets of distinct values. Aggregates map-side, no window."""
    at = F.struct(*order)
    out = [F.sum(c).alias(c) for c in sums]
    out += [F.min(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v"))))["v"].alias(c) for c in firsts]
    out += [F.array_sort(F.collect_set(c)).alias(f"{c}_set") for c in sets]
    return spans.groupBy(*key).agg(F.count("*").alias("n_spans"), *out)


def expand_ranges(ranges: DataFrame, start: str, end: str, length: Column, window: int) -> DataFrame:
    """Ranges of positions grown by window at both ends within [0, length); none in an empty context."""
    grown = F.greatest(F.col(start) - window, F.lit(0)), F.least(F.col(end) + window, length - 1)
    return ranges.filter(length > 0).withColumn(start, grown[0]).withColumn(end, grown[1])


def detector_overlaps(spans: DataFrame, key: str, detector: str, start: str, end: str) -> DataFrame:
    """Overlapping spans of one text found by different detectors, counted by pair of detectors (first < second).

    Spans count as open at their starts in one pass over the ends, by text and pair, so no pair of spans is made:
    of two overlapping spans, one is open when the other starts. Empty spans overlap nothing. The detectors' names, a
    handful, are read first."""
    spans = spans.filter(F.col(start) < F.col(end))
    points = spans.select(key, detector, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")))).alias("p"))
    # Ends come before starts at one position; starts there meet each other once, in the order of the detectors.
    names = [r[0] for r in spans.select(detector).distinct().sort(detector).collect()]
    w = Window.partitionBy(key).orderBy("p.at", "p.step", detector).rowsBetween(Window.unboundedPreceding, -1)
    opened = points.select(key, detector, "p", *[F.coalesce(F.sum(F.when(F.col(detector) == n, F.col("p.step"))).over(w), F.lit(0)).alias(f"_{i}") for i, n in enumerate(names)])
    open_now = F.explode(F.array(*[F.struct(F.lit(n).alias("other"), F.col(f"_{i}").alias("n")) for i, n in enumerate(names)] or [F.struct(F.lit("").alias("other"), F.lit(0).cast("long").alias("n"))])).alias("o")
    pairs = opened.filter("p.step = 1").select(detector, open_now).filter(F.col("o.other") != F.col(detector))
    low, high = F.least(detector, "o.other").alias("first"), F.greatest(detector, "o.other").alias("second")
    return pairs.groupBy(low, high).agg(F.sum("o.n").alias("n")).filter("n > 0")
