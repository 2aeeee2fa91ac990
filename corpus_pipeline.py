"""A corpus pipeline of five operators: each stage works on all that its predecessor kept.

Language ID (rejected documents go), line dedup (boilerplate lines go), MinHash near-dedup (one
document of each group stays), benchmark decontamination (documents that contain a test item go),
SentencePiece encoding and decoding (documents become ids, checked by decoding).

Every stage takes nulls in any column, empty tables, repeated rows and extra columns as its operator
defines them; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmeter.llm import decontamination, language, lines, near_dedup, pieces
from quillmeter.llm._shared import materialize, table
from quillmeter.llm.queries import TOKENIZERS


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; the dictionaries are made from labelled documents of the input."""
    return language.accepted(docs, language.learn(docs, F.lit(True)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; n_chars follows the text. Copies count as one page here:
    else a large group of copies would lose all its lines, and the next stage couldn't find it."""
    out = lines.drop_lines(spark, docs, "source", "text", distinct=True)
    n_chars = F.when(F.col("_n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n_chars).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8)."""
    return near_dedup.keep_one(spark, docs, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and whether decoding gives the text back."""
    return pieces.encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model", ["doc_id", "lang", "source"])


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
