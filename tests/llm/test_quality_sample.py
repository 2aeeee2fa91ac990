"""The sample of the quality classifier is drawn from whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmeter.llm import quality


def test_long_documents_are_sampled_from_all_of_their_text(spark, monkeypatch):
    long = "a" * 20_000 + "é" * 20_000 + "b" * 20_000
    docs = spark.createDataFrame([(1, long), (2, "short é"), (3, None), (4, "c" * 16_384)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda texts, *_: seen.extend([t] if isinstance(t, bytes) else t for t in texts) or 0.5)
    quality.learn(docs, labels, F.lit(True))
    sizes = [sum(map(len, x)) for x in seen]
    assert sizes == [quality.SAMPLED, len("short é".encode()), 0, 16_384]
    data = b"".join(seen[0])
    assert all(data.count(c) > 1000 for c in (b"a", "é".encode(), b"b"))
    assert all(x in long.encode() for x in seen[0])


def test_fit_takes_pieces():
    net = quality.fit([[b"good text " * 30] * 3, b"BAD!! " * 40] * 4, [1, 0] * 4, (0.5, 0.5), epochs=2)
    assert 0 <= net.score(b"good text") <= 1
