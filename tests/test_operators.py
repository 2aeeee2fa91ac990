from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from quillmeter.operators import attribution, dedupe, intervals, privacy, search, sequences, titles


def at(day: int, hour: int = 0, minute: int = 0) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour, minutes=minute)


def events(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_range_totals_is_half_open_and_handles_open_ends(spark):
    iv = events(spark, [("a", 1, at(0), at(1)), ("a", 2, at(1), None), ("a", 3, at(0), at(2)), ("b", 4, at(0), at(9))], "k string, id int, start timestamp_ntz, end timestamp_ntz")
    ev = events(spark, [("a", at(0), 1), ("a", at(0, 23), 2), ("a", at(1), 4), ("a", at(5), 8), (None, at(0), 16)], "k string, ts timestamp_ntz, v long")
    got = {r["id"]: (r["n"], r["v"]) for r in intervals.range_totals(iv, ev, "k", ["v"]).collect()}
    assert got == {1: (2, 3), 2: (2, 12), 3: (3, 7), 4: (0, 0)}


def test_as_of_matches_brute_force(spark):
    random.seed(5)
    left = [(random.choice("ab"), i, at(random.randrange(20), random.randrange(24))) for i in range(60)]
    right = [(random.choice("ab"), at(random.randrange(20), k % 24, k), k) for k in range(25)]
    out = intervals.as_of(events(spark, left, "k string, id int, ts timestamp_ntz"), events(spark, right, "k string, start timestamp_ntz, v int"), "k", "ts", "start", ["v"])
    got = {r["id"]: r["v"] for r in out.collect()}
    for k, i, t in left:
        own = [(s, v) for kk, s, v in right if kk == k and s <= t]
        assert got[i] == (max(own)[1] if own else None)


def test_running_sums_equal_one_window(spark):
    rows = [("a", at(d, h), d * 24 + h) for d in range(4) for h in range(0, 24, 5)]
    out = intervals.running_sums(events(spark, rows, "k string, ts timestamp_ntz, v long"), "k", ["ts"], F.to_date("ts"), {"upto": "v"}).orderBy("ts").collect()
    total = 0
    for r in out:
        total += r["v"]
        assert r["upto"] == total


def test_rows_without_key_or_time_stay(spark):
    """Null keys and times against DuckDB."""
    import duckdb

    duck = duckdb.connect()
    duck.execute("CREATE TABLE e (k VARCHAR, id INT, ts TIMESTAMP, v BIGINT)")
    ev = [("a", 1, at(0), 1), (None, 2, at(0), 2), ("a", 3, None, 4), (None, 4, None, 8), ("b", 5, at(1), None), ("a", 6, at(2), 16), (None, 7, at(3), 32)]
    duck.executemany("INSERT INTO e VALUES (?, ?, ?, ?)", ev)
    duck.execute("CREATE TABLE r (k VARCHAR, id INT, s TIMESTAMP, t TIMESTAMP)")
    iv = [("a", 1, at(0), None), (None, 2, at(0), at(9)), ("a", 3, None, at(9)), ("b", 4, at(0), at(2)), ("c", 5, at(0), at(2))]
    duck.executemany("INSERT INTO r VALUES (?, ?, ?, ?)", iv)
    left = events(spark, ev, "k string, id int, ts timestamp_ntz, v long")
    right = events(spark, iv, "k string, id int, start timestamp_ntz, end timestamp_ntz")
    got = intervals.running_sums(left, "k", ["ts", "id"], F.to_date("ts"), {"upto": "v"}).select("id", "upto").collect()
    want = "SELECT id, coalesce(sum(v) OVER (PARTITION BY k ORDER BY ts NULLS FIRST, id ROWS UNBOUNDED PRECEDING), 0) FROM e"
    assert sorted(map(tuple, got)) == sorted((i, int(v)) for i, v in duck.execute(want).fetchall())
    got = intervals.as_of(left.select("k", "id", "ts"), right.select("k", "start", F.col("id").alias("at")), "k", "ts", "start", ["at"]).select("id", "at").collect()
    want = "SELECT id, (SELECT max_by(r.id, r.s) FROM r WHERE r.k = e.k AND r.s <= e.ts) FROM e"
    assert sorted(map(tuple, got)) == sorted(duck.execute(want).fetchall())
    got = intervals.range_totals(right, left, "k", ["v"]).select("id", "n", "v").collect()
    want = "SELECT r.id, count(e.id), coalesce(sum(e.v), 0) FROM r LEFT JOIN e ON r.k = e.k AND e.ts >= r.s AND (r.t IS NULL OR e.ts < r.t) GROUP BY r.id"
    assert sorted(map(tuple, got)) == sorted((i, n, int(v)) for i, n, v in duck.execute(want).fetchall())


def test_stream_resumes_and_keeps_rows_without_a_time(spark, tmp_path):
    from quillmeter.streaming.rollups import incremental_rollup

    schema = "id int, ts timestamp_ntz"
    rows = [(i, at(i % 3) if i % 5 else None) for i in range(20)]
    folder, work = f"file://{tmp_path}/events", f"file://{tmp_path}/work"
    read = []

    def rollup(x):
        read.append(1)
        return x.groupBy("day").agg(F.count("*").alias("n"))

    def run():
        found = incremental_rollup(spark, folder, events(spark, [], schema).schema, work, rollup).collect()
        return {str(r["day"]): r["n"] for r in found}

    def want(some):
        return {k: sum(str(t.date() if t else None) == k for _, t in some) for k in {str(t.date() if t else None) for _, t in some}}

    events(spark, rows[:12], schema).coalesce(1).write.mode("append").parquet(folder)
    assert run() == want(rows[:12])
    events(spark, rows[12:], schema).coalesce(1).write.mode("append").parquet(folder)
    assert run() == want(rows) and sum(want(rows).values()) == 20
    calls = len(read)
    assert run() == want(rows) and len(read) == calls + 1  # nothing new: only the schema is asked for


def test_identities_that_lead_nowhere(spark):
    from quillmeter.operators import lookups

    accounts = events(spark, [("A", "a@x", "1"), ("B", "b@x", "2")], "account string, email string, uid string")
    wanted = events(spark, [(1, "a@x", None), (2, None, None), (3, "z@x", "9"), (4, "a@x", "2")], "k int, email string, uid string")
    got = sorted(tuple(r) for r in lookups.resolve_identity(wanted, accounts, "k", ["email", "uid"]).collect())
    assert got == [(1, "A", False), (2, None, False), (3, None, False), (4, None, True)]


def test_merge_overlapping(spark):
    rows = [("a", 1, 3), ("a", 3, 5), ("a", 7, 9), ("a", 2, 4), ("b", 0, 1)]
    got = sorted(map(tuple, intervals.merge_overlapping(events(spark, rows, "k string, a int, b int"), "k", "a", "b").select("k", "a", "b", "n_ranges").collect()))
    assert got == [("a", 1, 5, 3), ("a", 7, 9, 1), ("b", 0, 1, 1)]


def test_merge_overlapping_of_tied_ranges_matches_a_walk(spark):
    """Equal ranges that begin an island are all in it, in whatever order they are read: SQL that sorts them anew for
    each window may leave some in the island before."""
    random.seed(3)
    starts = [(random.randrange(40), random.randrange(0, 2400, 7)) for _ in range(600)]
    rows = [(k, a, a + 60) for k, a in starts for _ in range(random.choice([1, 2, 60]))]
    random.shuffle(rows)
    want: list[list[int]] = []
    for k, a, b in sorted(rows):
        if want and want[-1][0] == k and a <= want[-1][2]:
            want[-1][2:] = [max(b, want[-1][2]), want[-1][3] + 1]
        else:
            want.append([k, a, b, 1])
    ranges = events(spark, rows, "k int, a int, b int").repartition(7)
    got = sorted(map(list, intervals.merge_overlapping(ranges, "k", "a", "b").select("k", "a", "b", "n_ranges").collect()))
    assert got == want


def test_gap_sessions_truncate_hours(spark):
    rows = [("a", at(0), 1), ("a", at(0, 2, 59), 2), ("a", at(0, 5, 58), 3), ("a", at(0, 9), 4)]
    got = [r["session"] for r in sequences.gap_sessions(events(spark, rows, "k string, ts timestamp_ntz, id int"), "k", "ts", "id", 2).orderBy("id").collect()]
    assert got == [0, 0, 0, 1]


def test_wildcard_dedupe_matches_a_walk(spark):
    random.seed(9)
    rows = [(random.randrange(6), i, random.choice([None, "x", "y", "z"])) for i in range(80)]
    got = sorted((r["k"], r["arrival"], r["v"], r["n_merged"]) for r in dedupe.wildcard(events(spark, rows, "k int, arrival int, v string"), ["k"], "arrival", "v").collect())
    kept: dict[int, list[list]] = {}
    for k, i, v in rows:
        for r in kept.setdefault(k, []):
            if r[1] is None or v is None or r[1] == v:
                r[1] = r[1] or v
                r[2] += 1
                break
        else:
            kept[k].append([i, v, 1])
    assert got == sorted((k, *r) for k, rs in kept.items() for r in rs)


def test_ordered_overlap_and_jaccard(spark):
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    o = sequences.ordered_overlap
    j = sequences.weighted_jaccard
    got = spark.range(1).select(o(arr("a", "b", "c"), arr("a", "x", "c", "b")), o(arr(), arr("a")), o(arr("b", "a"), arr("a")), j(arr("a", "a", "b"), arr("a", "c")), j(arr(), arr("a"))).first()
    assert list(got) == [2 / 3, 1.0, 0.0, 0.25, 0.0]


def test_attribution_rejects_ties_and_short_edits(spark):
    e = events(spark, [(1, "p", at(0), ["a", "b", "c"]), (2, "q", at(0), ["a", "b", "c"]), (3, "p", at(0), ["a", "b"]), (4, "r", at(0), ["a", "b", "c", "d", "e"])], "edit_id int, path string, at timestamp_ntz, lines array<string>")
    c = events(spark, [(10, "p", at(2), ["a", "b", "c"]), (11, "q", at(1), ["a", "b", "c"]), (12, "q", at(3), ["a", "b", "c"]), (13, "r", at(20), ["a", "b", "c", "d"]), (14, "p", at(40), ["a", "b", "c"])], "commit_id int, path string, at timestamp_ntz, lines array<string>")
    got = sorted(map(tuple, attribution.match(e, c).select("edit_id", "commit_id", "confidence").collect()))
    assert got == [(1, 10, "high"), (4, 13, "medium")]


def test_spans_are_bytes_and_merge_by_priority(spark):
    rows = [(1, "é mail a.b@example.org or 10.0.0.1, 999.1.1.1"), (2, None), (3, "key sk-ABCDEF1234567890")]
    got = sorted((r["id"], r["start"], r["category"], r["value"]) for r in privacy.find_spans(events(spark, rows, "id int, text string"), "id", "text").collect())
    assert got == [(1, 8, "email", "a.b@example.org"), (1, 27, "ip", "10.0.0.1"), (3, 4, "secret", "sk-ABCDEF1234567890")]
    assert privacy.merge([(0, 5, "phone"), (3, 8, "secret"), (8, 9, "ip")]) == [(0, 8, "secret"), (8, 9, "ip")]


def test_search(spark):
    rows = events(spark, [(1, "The quick brown fox"), (2, "quick, fox brown!"), (3, None), (4, "foxes quicken")], "id int, text string")
    ids = lambda **k: sorted(r["id"] for r in search.matches(rows, "id", "text", **k).collect())
    assert ids(every=["quick", "fox"]) == [1, 2]
    assert ids(every=["quick"], none=["the"]) == [2]
    assert ids(phrase=["quick", "brown"]) == [1]
    assert ids(prefix="fox") == [1, 2, 4]
    assert ids(some=["foxes", "the"]) == [1, 4]
    assert [r["id"] for r in search.bm25(rows, "id", "text", ["quick", "the"]).orderBy(F.desc("score")).collect()] == [1, 2]


def test_titles(spark):
    rows = [(1, 0, "ok\n```\ncode\n```\n# Fix login ABC-12 for admins"), (1, 1, "continue"), (2, 0, "ok"), (3, 0, None)]
    got = {r["bucket"]: r["title"] for r in titles.best_titles(events(spark, rows, "bucket int, ordinal int, text string")).collect()}
    assert got == {1: "Fix login ABC-12 for admins", 2: "Unresolved work item", 3: "Unresolved work item"}
