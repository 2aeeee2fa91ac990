"""What keep_one leaves of rows without doc_id and of rows that repeat one."""

from __future__ import annotations

from quillmeter.llm import near_dedup

SCHEMA = "doc_id long, text string, source string"


def words(begin, n=60):
    return " ".join(f"w{i}" for i in range(begin, begin + n))


def test_rows_without_id(spark):
    near = words(0).replace("w59", "changed")
    rows = [(3, words(0), "a"), (None, near, "b"), (None, words(500), "c"), (None, words(500), "c"), (None, words(500).upper(), "c"), (None, words(900), "d"), (None, "", "e"), (None, "", "e"), (None, None, "e")]
    left = near_dedup.keep_one(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(r["source"]) for r in left) == ["a", "c", "d", "e", "e", "e"]


def test_repeated_id_keeps_the_least_text(spark):
    for rows in ([(1, f"{c} " + words(100 * k), c) for k, c in enumerate(order)] for order in ("zab", "bza", "abz")):
        left = near_dedup.keep_one(spark, spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
        assert [r["source"] for r in left] == ["a"]
