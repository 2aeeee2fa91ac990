"""Money, saturation and statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX = 9223372036854775807


def saturating_add(a: Column, b: Column) -> Column:
    """a + b, or the largest long where that overflows."""
    return F.coalesce(F.try_add(a, b), F.lit(LONG_MAX))


def saturating_sum(x: Column) -> Column:
    """Sum in exact decimals, capped at the largest long; 0 without rows."""
    return F.least(F.coalesce(F.sum(x.cast("decimal(38,0)")), F.lit(0)), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")


def cents(micro: Column) -> Column:
    """Micro-dollars to cents, half away from zero."""
    return F.round(micro.cast("decimal(38,4)") / F.lit(10000).cast("decimal(38,0)"), 0).cast("long")


def total_tokens(total: Column, *parts: Column) -> Column:
    """The stated total, else the sum of its parts (null parts count 0)."""
    filled = [F.coalesce(p, F.lit(0)) for p in parts]
    out = filled[0]
    for p in filled[1:]:
        out = saturating_add(out, p)
    return F.coalesce(total, out)


def effective_cost(reported_micro: Column, reported_cents: Column, estimated_micro: Column, estimated_cents: Column) -> Column:
    """Reported before estimated, micro-dollars before cents."""
    return F.coalesce(reported_micro, reported_cents * 10000, estimated_micro, estimated_cents * 10000)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def smoothed_idf(documents: Column, frequency: Column) -> Column:
    return F.log((documents + 1) / (frequency + 1))


def value_over_price(price_cents: Column, currency: Column, estimated_cents: Column) -> tuple[Column, Column]:
    """Difference and multiple of a subscription's price; null unless priced in USD above 0."""
    usable = (currency == "USD") & (price_cents > 0) & estimated_cents.isNotNull()
    return F.when(usable, estimated_cents - price_cents), F.when(usable, estimated_cents / price_cents)
