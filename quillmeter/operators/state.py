"""State tables: which files are new, what to replace, what is gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed_files(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Files (key, signature) that are new or whose signature isn't the recorded one."""
    known = state.select("key", F.col("signature").alias("_known"), F.lit(True).alias("_seen"))
    return listing.join(known, "key", "left").filter(F.col("_seen").isNull() | ~F.col("signature").eqNullSafe(F.col("_known"))).drop("_known", "_seen")


def missing_files(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Recorded files that are no longer listed."""
    return state.join(listing.select("key"), "key", "left_anti")


def replace_by_file(base: DataFrame, rows: DataFrame, reconciled: DataFrame) -> DataFrame:
    """base with all rows of the reconciled files replaced by rows (both have a column file)."""
    return base.join(reconciled.select("file").distinct(), "file", "left_anti").unionByName(rows)


def keep_dirty(current: DataFrame, recomputed: DataFrame, key: str) -> DataFrame:
    """Recomputed rows (key, hash, ...) with dirty: True where the hash changed, else as it was; unchanged rows need no write."""
    before = current.select(key, F.col("hash").alias("_hash"), F.col("dirty").alias("_dirty"))
    changed = ~F.col("hash").eqNullSafe(F.col("_hash"))
    return recomputed.join(before, key, "left").withColumn("dirty", changed | F.coalesce("_dirty", F.lit(False))).withColumn("changed", changed).drop("_hash", "_dirty")


def close_intervals(rows: DataFrame, who: Column, at: Column) -> DataFrame:
    """Intervals (start, end) of the rows where who holds end at the given time at the latest; those that begin later vanish."""
    cut = rows.withColumn("end", F.when(who, F.least(F.coalesce("end", at), at)).otherwise(F.col("end")))
    return cut.filter(~who | F.col("end").isNull() | (F.col("start") < F.col("end")))


def without_private_columns(rows: DataFrame, include_projects: bool, private: tuple[str, ...] = ("source_record_id", "source_line_number", "source_file_path_hash")) -> DataFrame:
    """What may leave the device: no record ids or line numbers, projects only if asked for."""
    drop = [c for c in private if c in rows.columns]
    out = rows.drop(*drop)
    if not include_projects and "project" in out.columns:
        out = out.withColumn("project", F.lit(None).cast(out.schema["project"].dataType))
    return out
