"""Workers give back what their tasks leave free, and get few rows at once."""

from __future__ import annotations

import os

import corpus_pipeline
import pytest
from quillmeter.llm import repeats
from quillmeter.llm._shared import BATCH_ROWS, lean

SF = "/root/testdata/sf0.001"


def resident() -> float:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


@pytest.mark.skipif(not os.path.exists("/proc/self/statm"), reason="reads /proc")
def test_free_memory_goes_back():
    pinned = []

    def run(batches):
        for batch in batches:
            held = [bytes(1000) for _ in range(200_000)]
            pinned.append(held[-1])  # the C library keeps what lies below a block in use
            yield batch

    before = resident()
    assert list(lean(run)([1])) == [1]
    assert resident() - before < 100


@pytest.fixture
def tasks(spark, monkeypatch):
    """The functions that are given to mapInArrow."""
    kind, given = type(spark.range(0)), []
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *args, **more: given.append(f) or plain(self, f, *args, **more))
    return given


def test_pipeline_tasks(spark, docs, tasks):
    for name in ("near_duplicates", "tokenize"):
        dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert len(tasks) == 4 and all(hasattr(f, "__wrapped__") for f in tasks)


def test_repeats_tasks(spark, docs, tasks):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        repeats.remove_repeats(spark, docs, ["doc_id"])
        assert spark.conf.get(name) == str(BATCH_ROWS)
    finally:
        spark.conf.set(name, before)
    assert len(tasks) == 7 and all(hasattr(f, "__wrapped__") for f in tasks)
