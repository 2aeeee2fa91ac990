from __future__ import annotations

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from quillmeter.functions import patches, periods
from quillmeter.operators import state

NOW = dt.datetime(2026, 8, 17, 12, tzinfo=dt.timezone.utc)


def test_periods():
    p = periods.range_period("2026-08-01", "2026-08-03", NOW)
    assert (p.since.day, p.until, p.until_open) == (1, dt.datetime(2026, 8, 4, tzinfo=dt.timezone.utc), True)
    assert periods.range_period(None, None, NOW) == periods.Period(None, NOW)
    assert periods.range_period("2026-08-01", "2027-01-01", NOW).until == NOW
    assert periods.range_period("2027-01-01", None, NOW) == periods.Period(NOW, NOW)
    assert periods.range_period("2026-08-17T10:00:00+02:00", None, NOW).since.hour == 8
    for a, b in (("2026-08-03", "2026-08-01"), ("x", None), ("2026-08-01T10:00:00", None)):
        with pytest.raises(ValueError):
            periods.range_period(a, b, NOW)


def test_line_changes_are_longest_common_subsequences():
    def longest(a, b):
        return max(k for k in range(len(a) + 1) for x in itertools.combinations(a, k) if any(x == y for y in itertools.combinations(b, k)))

    for a in itertools.product("xyz", repeat=4):
        for b in (list("xzy"), list("zzxy"), [], list("yx")):
            deleted, added = patches.line_changes(list(a), b)
            assert len(a) - len(deleted) == len(b) - len(added) == longest(list(a), b)
    assert patches.line_changes(["a", "b"], ["b", "a"]) == (["a"], ["a"])


UNIFIED = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,3 +1,3 @@
 keep
-old line
+new line
 
--- a/gone.rs
+++ /dev/null
@@ -1,2 +0,0 @@
-a
--- b
"""


def test_patches(spark):
    x, gone = patches.patch_files(UNIFIED)
    assert (x["path"], len(x["added"]), len(x["deleted"]), x["complete"]) == ("x.py", 1, 1, True)
    assert (gone["path"], gone["deleted"], gone["complete"]) == ("gone.rs", [patches.fingerprint("a"), patches.fingerprint("-- b")], True)
    (cut,) = patches.patch_files("--- a/f\n+++ b/f\n@@ -1,5 +1,5 @@\n one\n")
    assert not cut["complete"]
    two = patches.patch_files("*** Begin Patch\n*** Add File: n.py\n+print()\n*** Update File: o.py\n@@\n-a\n+b\n*** End Patch")
    assert [(f["path"], len(f["added"]), len(f["deleted"]), f["complete"]) for f in two] == [("n.py", 1, 0, True), ("o.py", 1, 1, True)]
    rows = spark.createDataFrame([(1, UNIFIED), (2, None)], "id int, patch string")
    assert patches.explode_patches(rows, "id", "patch").count() == 2


def test_state(spark):
    listing = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "key string, signature string")
    known = spark.createDataFrame([("a", "1"), ("b", "1"), ("d", "1")], "key string, signature string")
    assert sorted(r["key"] for r in state.changed_files(listing, known).collect()) == ["b", "c"]
    assert [r["key"] for r in state.missing_files(listing, known).collect()] == ["d"]
    base = spark.createDataFrame([("f1", 1), ("f2", 2)], "file string, v int")
    new = spark.createDataFrame([("f1", 9)], "file string, v int")
    assert sorted(map(tuple, state.replace_by_file(base, new, new).collect())) == [("f1", 9), ("f2", 2)]
    cur = spark.createDataFrame([(1, "h", False), (2, "h", True), (3, "h", False)], "id int, hash string, dirty boolean")
    got = {r["id"]: (r["dirty"], r["changed"]) for r in state.keep_dirty(cur, spark.createDataFrame([(1, "h"), (2, "h"), (3, "x"), (4, "n")], "id int, hash string"), "id").collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (True, True), 4: (True, True)}
    iv = spark.createDataFrame([(1, 0, None), (2, 0, 3), (3, 7, None)], "id int, start int, end int")
    assert sorted((r["id"], r["end"]) for r in state.close_intervals(iv, F.lit(True), F.lit(5)).collect()) == [(1, 5), (2, 3)]
