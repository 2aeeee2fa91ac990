"""Texts and predicates of records, on given values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillmeter.functions import records as fn
from quillmeter.operators import records as ops


def each(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in rows.select("i", f(F.col("v"))).orderBy("i").collect()]


def test_git_remote(spark):
    given = ["git@Host.com:Team/Repo.git", "https://u:p@host.com/team/repo.git/", "ssh://git@host/a/b", "host/a", "host", " ", "git@host", "https://host", "a//B/ c ", None]
    want = ["host.com/team/repo", "host.com/team/repo", "host/a/b", "host/a", None, None, None, None, "a/b/c", None]
    assert each(spark, given, fn.git_remote) == want


def test_contained_path(spark):
    given = ["a/b", "/a", "../a", "a/../b", "a/../../b", "./a", "", None]
    assert each(spark, given, fn.contained_path) == ["a/b", None, None, "a/../b", None, "./a", "", None]


def test_opaque_token(spark):
    given = ["(abcdefgh12345678)", "abcdefghijklmnopq", "eyJhbGciOiJIUzI1", "abc123", "abcdefgh1234567/", None]
    assert each(spark, given, fn.opaque_token) == [True, False, True, False, False, None]


def test_media_type(spark):
    given = ["a/B.JPG", "x.svgz", "x.txt", ".png", "png", "a.b/c", None]
    assert each(spark, given, fn.media_type) == ["image/jpeg", "image/svg+xml", None, None, None, None, None]


def test_committer_hash(spark):
    a, b, c = each(spark, [" A@b.c ", "a@B.c", None], fn.committer_hash)
    assert a == b and len(a) == 64 and c is None


def cut(text: str, most: int, tail: int) -> str:
    """Brute force: characters from both ends while they fit."""
    if len(text.encode()) <= most:
        return text
    mark = fn.CUT_MIDDLE if tail else fn.CUT_MARK
    budget = max(most - len(mark), 0)
    kept = min(tail, budget)
    data = text.encode()
    head, end = data[: budget - kept], data[len(data) - kept :]
    return head.decode("utf-8", "ignore") + mark + end.decode("utf-8", "ignore")


@pytest.mark.parametrize(("most", "tail"), [(40, 0), (41, 12), (42, 13), (43, 14), (44, 15), (5, 3)])
def test_bounded(spark, most, tail):
    given = ["", "short", "x" * 40, "x" * 41, "é" * 50, "a" + "é" * 50, "€" * 30, "a€" * 30, "😀" * 20, "ab😀" * 20, None]
    assert each(spark, given, lambda c: fn.bounded(c, most, tail)) == [None if t is None else cut(t, most, tail) for t in given]


def test_bucket_key(spark):
    rows = spark.createDataFrame([("r", "p", None), (None, "p", "b"), (" ", None, "b"), (None, None, None)], "r string, p string, b string")
    got = [r[0] for r in rows.select(fn.bucket_key(F.col("r"), F.col("p"), F.col("b"))).collect()]
    assert got == ["repo:r|path:p|branch:none", "repo:none|path:p|branch:b", "none", "none"]


def test_weighted_overlap_and_f1(spark):
    one = spark.range(1)
    cells = [fn.weighted_overlap(F.lit(1.0), F.lit(3), F.lit(0.0), F.lit(1)), fn.weighted_overlap(F.lit(1.0), F.lit(0), F.lit(1.0), F.lit(0)), fn.f1(F.lit(0), F.lit(0), F.lit(0)), fn.f1(F.lit(1), F.lit(2), F.lit(1))]
    got = one.select(*cells).collect()[0]
    assert [round(x, 6) for x in got] == [0.75, 0.0, 0.0, 0.666667]


def test_detector_overlaps_brute_force(spark):
    spans = [(k, d, a, a + n) for k in range(3) for i, (d, a, n) in enumerate([("x", 0, 5), ("y", 0, 5), ("y", 4, 3), ("x", 5, 2), ("z", 6, 1), ("z", 2, 0), ("x", 6, 9)]) if (i + k) % 3]
    want: dict[tuple[str, str], int] = {}
    for k, d, a, b in spans:
        for k2, d2, a2, b2 in spans:
            if k == k2 and d < d2 and a < b and a2 < b2 and a < b2 and a2 < b:
                want[d, d2] = want.get((d, d2), 0) + 1
    rows = spark.createDataFrame(spans, "k int, d string, a int, b int")
    got = {(r[0], r[1]): r[2] for r in ops.detector_overlaps(rows, "k", "d", "a", "b").collect()}
    assert got == want
    assert ops.detector_overlaps(rows.limit(0), "k", "d", "a", "b").collect() == []


def test_in_report_window(spark):
    at = lambda x: F.lit(x).cast("timestamp")
    got = spark.range(1).select(
        fn.in_report_window(at("2024-01-02"), at(None), at("2024-01-01"), at("2024-01-02")),
        fn.in_report_window(at("2024-01-03"), at(None), at(None), at("2024-01-02")),
        fn.in_report_window(at("2023-01-01"), at("2024-01-01"), at("2024-01-01"), at("2024-01-02")),
        fn.in_report_window(at("2023-01-01"), at(None), at("2024-01-03"), at("2024-01-02")),
    ).collect()[0]
    assert list(got) == [True, False, False, False]
