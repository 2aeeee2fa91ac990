"""Change-data export: what is new, what is gone, whether an acknowledgement adds up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def payload_hash(*columns: str):
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def pending(current: DataFrame, sent: DataFrame, key: str) -> DataFrame:
    """Rows of current whose hash is not what was sent (or that were never sent)."""
    before = sent.select(key, F.col("hash").alias("_sent"))
    return current.join(before, key, "left").filter(~F.col("hash").eqNullSafe(F.col("_sent"))).drop("_sent")


def retired(current: DataFrame, sent: DataFrame, key: str) -> DataFrame:
    return sent.join(current.select(key), key, "left_anti").select(key)


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """changes replace rows of base by key."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


def check_ack(sent: dict[str, int], ack: dict) -> None:
    """Raise unless nothing was rejected and accepted and duplicates add up to what was sent, for each kind."""
    if ack.get("rejected"):
        raise ValueError(f"{len(ack['rejected'])} entities were rejected")
    for kind, n in sent.items():
        got = ack.get("accepted", {}).get(kind, 0) + ack.get("duplicates", {}).get(kind, 0)
        if got != n:
            raise ValueError(f"{kind}: sent {n}, acknowledged {got}")
