"""The pipeline's stages one by one: what each keeps follows from its input."""

from __future__ import annotations

import corpus_pipeline
from quillmeter.llm import near_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontaminate", "tokenize"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        left = out.cache().count()
        assert 0.5 * n < left <= docs.count()
        if name == "near_duplicates":
            kept = near_dedup.near_duplicates(spark, docs, 80).filter("kept")
            assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in out.collect()}
        docs = out
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count() and out.filter("not round_trip").count() == 0


def test_odd_rows(spark, docs, empty):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        empty = stage(spark, empty, SF)
    assert corpus_pipeline.tokenize(spark, docs, SF).filter("not round_trip").count() == 0
    assert corpus_pipeline.tokenize(spark, empty, SF).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "round_trip"] and out.count() > 100
