"""Rollups kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def incremental_rollup(spark: SparkSession, events_path: str, schema, work_dir: str, rollup, max_files: int | None = None) -> DataFrame:
    """Stream events from a folder; each micro-batch adds its rows to a base partitioned by day and recomputes,
    from base, the days that it touches, however late they are. Returns the rollup table as it stands.

    A call resumes where the last one with the same work_dir stopped: files it has read aren't read again. Writes are
    idempotent: a batch that runs again overwrites its own files and its days. Rows without a time are a day of their
    own, the null one. Without any row yet the rollup is empty."""
    base, out = f"{work_dir}/base", f"{work_dir}/rollup"

    def apply(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = batch.withColumn("batch", F.lit(number)).withColumn("day", F.to_date("ts"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(base)
        stored = session.read.schema(rows.schema).parquet(base)
        touched = stored.filter(F.col("batch") == number).select(F.col("day").alias("_day")).distinct()
        days = F.broadcast(touched)  # at most a batch's days
        again = stored.drop("batch").join(days, stored["day"].eqNullSafe(touched["_day"]), "left_semi")
        rollup(again).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(out)

    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(events_path)
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{work_dir}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    empty = spark.createDataFrame([], schema).withColumn("day", F.to_date("ts"))
    return spark.read.schema(rollup(empty).schema).parquet(out)
