"""Where intermediate tables live, how a lineage is cut, and joins with hot keys."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is hot if it holds over 1 / HOT of a table's rows; so there are fewer than HOT such keys, however large the table.
HOT = 1000

#: Rows of an Arrow batch: some MB of texts on either side of a worker's pipe.
BATCH_ROWS = 1000

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests)
    gets a folder of its own; on a cluster that is an error, since a machine-local folder isn't shared."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{os.path.join(tempfile.gettempdir(), 'quillmeter-checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove the intermediate tables made so far by this process, once the results that read them are stored."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage is cut, and a lost executor loses nothing."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Rows that Python workers get at once, with whole texts: BATCH_ROWS instead of Spark's default, if that is unchanged."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


def give_back() -> None:
    """Memory that this process has free goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run):
    """run, a function of a task's Arrow batches, after which a worker gives back what it has free: workers wait for the
    next stage beside the JVM, and would keep the most that any of their tasks took."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passed(keep: list[str], outputs: tuple[str, ...]) -> list[Column]:
    """Columns that go through an operator; one named like an output gets the ending _in."""
    return [F.col(f"`{c}`").alias(f"{c}_in" if c in outputs else c) for c in keep]


def hot_keys(counts: DataFrame, keys: list[str], total: int | None = None) -> DataFrame | None:
    """Of counts (keys and _n, the rows a key has in a table), the keys of over 1 / HOT of all rows (total, if counts
    doesn't hold all keys); None if there are none."""
    if total is None:
        total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = [tuple(r) for r in counts.filter(F.col("_n") * HOT > total).filter("_n > 1").select(*keys).collect()]  # fewer than HOT
    return counts.sparkSession.createDataFrame(hot, counts.select(*keys).schema) if hot else None


def skewed_join(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame | None = None, how: str = "inner", total: int | None = None) -> DataFrame:
    """left joined with right, which has one row a key; counts: keys and _n of left, if known. Rows of hot keys stay where they
    are, as right's rows of these keys (fewer than HOT) are broadcast; the others meet in an ordinary join. left is read up
    to three times: it is a stored table. No key is null."""
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = hot_keys(counts, keys, total)
    if hot is None:
        return left.join(right, keys, how)
    if len(keys) == 1 and not isinstance(hot.schema[0].dataType, T.BinaryType):
        among = F.col(keys[0]).isin([r[0] for r in hot.collect()])
        own, others, some = left.filter(among), left.filter(~among), right.filter(among)
    else:
        own, others, some = (x.join(F.broadcast(hot), keys, kind) for x, kind in ((left, "left_semi"), (left, "left_anti"), (right, "left_semi")))
    return own.join(F.broadcast(some), keys, how).unionByName(others.join(right, keys, how))
