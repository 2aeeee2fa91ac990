"""Decontamination finds items of under five words inside longer documents."""

from __future__ import annotations

from quillmeter.llm import decontamination


def test_short_items_inside_documents(spark):
    long = "some words before The Secret\nanswer and some words after it"
    docs = spark.createDataFrame([(1, long), (2, "the secret answer"), (3, "secret the answer is in some other order here"), (4, "Secret"), (5, ""), (6, None)], "doc_id long, text string")
    items = spark.createDataFrame([(10, "the secret ANSWER"), (11, "secret"), (12, "some words before the secret answer and some"), (13, "not in any"), (14, " ")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in decontamination.contaminated(spark, docs, items).collect()}
    assert got == {(1, 10): (1, 1), (2, 10): (1, 1), (1, 11): (1, 1), (2, 11): (1, 1), (3, 11): (1, 1), (4, 11): (1, 1), (1, 12): (4, 4)}
    assert sorted(r["doc_id"] for r in decontamination.clean(spark, docs, items.filter("item_id = 10")).collect()) == [3, 4, 5, 6]
