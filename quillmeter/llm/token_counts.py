"""Token counts from an exact length histogram.

Every document is encoded whole; documents are aggregated by encoded length, and
suffix sums over the histogram answer totals, quantiles and truncated totals for
every context limit, without going back to the documents.

Defined cases: null and empty texts have 0 tokens; special-token strings in a text
are ordinary text; repeated rows count as often as they occur; an empty table gives
an empty histogram; texts of any length are encoded whole, one at a time; only the text
column is read, whatever the others are called.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialize

#: Lengths per block of the two-level suffix sums.
BLOCK = 128

_encoders: dict[int, object] = {}


def _encoder(vocabulary: bytes, pattern: str):
    key = hash((vocabulary, pattern))
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        _encoders[key] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def encoded_lengths(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """One row n_tokens for each document. The vocabulary (under 2 MB) goes along with the tasks."""
    with open(vocabulary_path, "rb") as f:
        vocabulary = f.read()

    def run(batches):
        encode = _encoder(vocabulary, pattern).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n_tokens": pa.array((len(encode(x)) if (x := t.as_py()) else 0 for t in batch.column(0)), pa.int64())})

    return docs.select("text").mapInArrow(run, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length in the histogram, taken as a context limit: documents and tokens at least that
    long, documents that fit, their share, all tokens, and the tokens left if longer documents are cut there.

    Sums are two-level: blocks of BLOCK lengths are summed apart, and only the totals of blocks (longest
    document / BLOCK rows) meet in one place.
    """
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("mass", (F.col("n_tokens") * F.col("n_docs")).cast("decimal(38,0)"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("mass").alias("m"))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_later"), F.coalesce(F.sum("m").over(later), F.lit(0)).alias("mass_later"), F.sum("d").over(Window.partitionBy()).alias("all_docs"), F.sum("m").over(Window.partitionBy()).alias("all_mass"))
    down = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    out = hist.join(blocks, "block").withColumn("docs_at_least", F.sum("n_docs").over(down) + F.col("docs_later")).withColumn("mass_at_least", F.sum("mass").over(down) + F.col("mass_later"))
    over = F.col("docs_at_least") - F.col("n_docs")
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        F.col("mass_at_least").cast("long").alias("tokens_at_least"),
        (F.col("all_docs") - over).alias("docs_fitting"),
        F.round((F.col("all_docs") - over) / F.col("all_docs"), 9).alias("share_fitting"),
        F.col("all_mass").cast("long").alias("tokens_total"),
        (F.col("all_mass") - F.col("mass_at_least") + F.col("mass") + F.col("n_tokens") * over).cast("long").alias("tokens_truncated"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> dict[int, int]:
    """Tokens left when every document is cut at each limit, from the sums alone."""
    out = {}
    for limit in limits:
        r = sums.filter(F.col("n_tokens") > limit).agg(F.max("docs_at_least"), F.max("tokens_at_least")).first()
        total = sums.agg(F.max("tokens_total")).first()[0] or 0
        out[limit] = total - (r[1] or 0) + limit * (r[0] or 0)
    return out


def quantiles(sums: DataFrame, shares: list[float]) -> dict[float, int | None]:
    """The least length that at least the given share of documents does not exceed."""
    aggs = [F.min(F.when(F.col("share_fitting") >= q, F.col("n_tokens"))) for q in shares]
    return dict(zip(shares, sums.agg(*aggs).first(), strict=True))


def token_counts(spark: SparkSession, docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """The histogram, stored so that documents are encoded once, with its suffix sums."""
    return suffix_sums(materialize(spark, histogram(encoded_lengths(docs, vocabulary_path, pattern)), "length-histogram"))
