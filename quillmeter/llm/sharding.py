"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots (thousands). Bytes are
aggregated per slot, and a versioned slot-to-shard map, small whatever the data,
says which shard owns a slot. Rebalancing edits the map and never rehashes rows.

Defined cases: a null text has size 16 and crc32 0; a null doc_id hashes as null
beside the text; repeated rows share a slot and get consecutive positions; an
empty table gives no rows; only doc_id and text are read, so clashing extra
columns don't matter.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

N_SLOTS = 4096
ROW_OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """Version of the slot-to-shard map. shards[s] is the shard of virtual slot s."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    @staticmethod
    def build(loads: list[int], n_shards: int) -> SlotMap:
        """First version: heaviest slot first, each to the lightest shard (ties: lower shard)."""
        heap = [(0, 0, s) for s in range(n_shards)]
        owner = [0] * len(loads)
        for slot in sorted(range(len(loads)), key=lambda s: (-loads[s], s)):
            load, count, shard = heapq.heappop(heap)
            owner[slot] = shard
            heapq.heappush(heap, (load + loads[slot], count + 1, shard))
        return SlotMap(1, n_shards, tuple(owner))

    def rebalance(self, loads: list[int], n_shards: int) -> SlotMap:
        """Next version for changed loads or shard count. Slots of removed shards move; beyond
        that, slots leave only shards above the mean, and only while the move narrows the gap."""
        owner = list(self.shards)
        totals = [0] * n_shards
        homeless = []
        owned: list[list[int]] = [[] for _ in range(n_shards)]
        for slot, shard in enumerate(owner):
            if shard < n_shards:
                totals[shard] += loads[slot]
                owned[shard].append(slot)
            else:
                homeless.append(slot)
        for slot in sorted(homeless, key=lambda s: (-loads[s], s)):
            to = min(range(n_shards), key=lambda s: (totals[s], s))
            owner[slot] = to
            totals[to] += loads[slot]
            owned[to].append(slot)
        mean = sum(totals) / n_shards
        for shard in sorted(range(n_shards), key=lambda s: (-totals[s], s)):
            for slot in sorted(owned[shard], key=lambda s: (-loads[s], s)):
                if totals[shard] <= mean:
                    break
                to = min(range(n_shards), key=lambda s: (totals[s], s))
                if loads[slot] and to != shard and totals[to] + loads[slot] < totals[shard]:
                    owner[slot] = to
                    totals[shard] -= loads[slot]
                    totals[to] += loads[slot]
        return SlotMap(self.version + 1, n_shards, tuple(owner))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.n_shards, slot, shard) for slot, shard in enumerate(self.shards)]
        return spark.createDataFrame(rows, "version int, n_shards int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version below path; older versions stay readable."""
        self.frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/v{self.version:08d}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{path}/v{version:08d}").orderBy("virtual_slot").collect()  # N_SLOTS rows
        return SlotMap(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows))


def measure(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of each record; the slot is a hash of doc_id and text."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select("doc_id", (F.octet_length(raw) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")).withColumn(
        "virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n_slots)).cast("int")
    )


def slot_loads(measured: DataFrame, n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows per slot: n_slots numbers each, however many rows there are."""
    loads, counts = [0] * n_slots, [0] * n_slots
    for r in measured.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        loads[r["virtual_slot"]], counts[r["virtual_slot"]] = r["b"], r["n"]
    return loads, counts


def assign(spark: SparkSession, measured: DataFrame, slots: SlotMap, counts: list[int]) -> DataFrame:
    """Adds shard and slot (the row's gapless position in its shard: rows of earlier virtual slots of
    the shard, then the rank in its own virtual slot). No row meets rows of another virtual slot."""
    at = [0] * slots.n_shards
    rows = []
    for v, shard in enumerate(slots.shards):
        rows.append((v, shard, at[shard]))
        at[shard] += counts[v]
    owners = F.broadcast(spark.createDataFrame(rows, "virtual_slot int, shard int, start long"))  # n_slots rows
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return measured.withColumn("rank", rank).join(owners, "virtual_slot").withColumn("slot", F.col("start") + F.col("rank") - 1).drop("rank", "start")


def shard(spark: SparkSession, docs: DataFrame, n_shards: int, map_path: str | None = None, n_slots: int = N_SLOTS) -> tuple[DataFrame, SlotMap]:
    """Rows with shard and slot, and the map used; the map is stored below map_path if given."""
    measured = measure(docs, n_slots)
    loads, counts = slot_loads(measured, n_slots)
    slots = SlotMap.build(loads, n_shards)
    if map_path:
        slots.save(spark, map_path)
        slots = SlotMap.load(spark, map_path, slots.version)
    return assign(spark, measured, slots, counts), slots
