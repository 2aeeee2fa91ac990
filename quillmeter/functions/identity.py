"""Deterministic identifiers: a prefix and the beginning of a SHA-256 over a joined string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(*parts: Column) -> Column:
    """Parts joined by ':'; null is the empty string, not left out."""
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def hashed_id(prefix: str, size: int, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined(*parts), 256), 1, size))


def rfc3339(ts: Column) -> Column:
    """UTC timestamp text: +00:00, a fraction (3 or 6 digits) only if there is one."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    fraction = F.when(micros == "000000", "").when(micros.endswith("000"), F.concat(F.lit("."), F.substring(micros, 1, 3))).otherwise(F.concat(F.lit("."), micros))
    return F.concat(base, fraction, F.lit("+00:00"))


def source_id(provider: Column, kind: Column, key: Column) -> Column:
    return hashed_id("src_", 24, provider, kind, key)


def account_id(provider: Column, key: Column) -> Column:
    return hashed_id("acct_", 24, provider, key)


def event_id(provider: Column, source: Column, record: Column, session: Column, ts: Column) -> Column:
    return hashed_id("evt_", 32, provider, source, record, session, rfc3339(ts))


def semantic_fingerprint(*parts: Column) -> Column:
    return F.sha2(joined(*parts), 256)


def account_key(user: Column, email: Column) -> Column:
    """The stable key of an account: user id, else e-mail in lower case; blank counts as absent."""
    clean = [F.nullif(F.trim(user), F.lit("")), F.nullif(F.lower(F.trim(email)), F.lit(""))]
    return F.coalesce(*clean)


def hmac_sha256(key_hex: str, message: Column) -> Column:
    """HMAC-SHA256 (hex) of a binary column, composed from sha2: no Python on the way."""
    key = bytes.fromhex(key_hex).ljust(64, b"\0")
    inner = F.unhex(F.lit(bytes(b ^ 0x36 for b in key).hex()))
    outer = F.unhex(F.lit(bytes(b ^ 0x5C for b in key).hex()))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)
