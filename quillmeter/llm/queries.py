"""The queries opN_<name>, with production parameters, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language, lines, media, near_dedup, pieces, quality, repeats, sharding, token_counts
from ._shared import scratch, table

#: Default place of the public vocabulary files; every operator takes the path as a parameter.
TOKENIZERS = "/opt/tokenizers"
#: Split pattern of the byte-level vocabulary, as its description states it.
BYTE_BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
N_SHARDS = 40


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spark, table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", BYTE_BPE_PATTERN)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, slots = sharding.shard(spark, table(spark, sf_dir, "documents"), N_SHARDS, scratch(spark, "slot-map"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slots.version).alias("map_version"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media_columns(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "width", "height", "bit_depth")


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"), 85)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model", ["doc_id"])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.learn(docs, labels, _remainder(5) != 0)
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out")
    return quality.score(docs.select("doc_id", held_out, "text"), model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontamination.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(spark, table(spark, sf_dir, "documents"), ["doc_id"]).drop("kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source", "text")
    return out.select("doc_id", "source", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), "text")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = language.learn(docs, _remainder(4) != 2)
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out")
    return language.predict(docs.select("doc_id", held_out, "text"), dictionaries, ["doc_id", "held_out"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality": op3_quality,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_language": op7_language,
    "op8_token_counts": op8_token_counts,
    "op9_sharding": op9_sharding,
    "op10_media_columns": op10_media_columns,
}

ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": decontamination.ORACLE_SQL,
    "op6_line_dedup": lines.oracle_sql(),
}
