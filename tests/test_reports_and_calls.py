from __future__ import annotations

import io
import json
import subprocess
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quillmeter.functions.records import committer_hash
from quillmeter.operators import calls
from quillmeter.sources import reports, sinks


def test_reported_summaries(spark, tmp_path):
    good = {"schema_version": reports.REPORT_SCHEMA, "provider": "p", "source_kind": "manual", "source_name": "s", "report_format": "f", "period_start": "2026-01-01T00:00:00Z", "usage": {"input_tokens": 3, "output_tokens": 4}}
    given = {"a": good, "b": good, "c": good | {"schema_version": "x"}, "d": good | {"source_kind": "local_adapter"}, "e": good | {"usage": {}}, "f": good | {"usage": {"input_tokens": 3, "total_tokens": 9}}}
    for name, r in given.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(r))
    (tmp_path / "g.json").write_text("{broken")
    got = reports.reported_summaries(spark, str(tmp_path)).collect()
    assert sorted(r["problem"] or "" for r in got) == ["", "", "", "kind", "schema", "schema", "zero"]
    fine = [r for r in got if r["problem"] is None]
    assert sorted(r["total_tokens"] for r in fine) == [7, 7, 9]
    assert len({r["summary_id"] for r in fine}) == 2


def test_git_commits(spark, tmp_path):
    now = datetime.now(timezone.utc)
    repo = tmp_path / "r"
    repo.mkdir()

    def git(*args, email="A@b.c", at=now):
        stamp = at.isoformat()
        env = {"GIT_AUTHOR_NAME": "n", "GIT_COMMITTER_NAME": "n", "GIT_AUTHOR_EMAIL": email, "GIT_COMMITTER_EMAIL": email, "GIT_AUTHOR_DATE": stamp, "GIT_COMMITTER_DATE": stamp, "PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(tmp_path)}
        subprocess.run(["git", "-C", str(repo), *args], check=True, capture_output=True, env=env)

    git("init", "-q", "-b", "main")
    git("commit", "-q", "--allow-empty", "-m", "old", at=now - timedelta(days=100))
    git("commit", "-q", "--allow-empty", "-m", "one", at=now - timedelta(days=2))
    git("checkout", "-q", "-b", "side")
    git("commit", "-q", "--allow-empty", "-m", "two", at=now - timedelta(days=1))
    git("checkout", "-q", "main")
    git("commit", "-q", "--allow-empty", "-m", "other", email="x@y.z", at=now - timedelta(hours=3))
    git("merge", "-q", "--no-ff", "-m", "merge", "side", at=now - timedelta(hours=2))
    git("commit", "-q", "--allow-empty", "-m", "ahead", at=now + timedelta(days=3))
    known = spark.createDataFrame([("a@B.c",)], "e string").select(committer_hash(F.col("e")).alias("committer_hash"))
    got = reports.git_commits(spark, [str(repo), str(tmp_path / "none")], known, now).collect()
    assert len(got) == 2 and {r["root"] for r in got} == {str(repo)}


def test_paired_calls(spark):
    rows = [
        ("c", 0, "1", "call", "edit", None, "{}"), ("c", 1, "1", "result", None, None, '{"output": "{\\"metadata\\": {\\"exit_code\\": 1}}"}'),
        ("c", 2, "2", "call", "edit", None, "{}"), ("c", 3, "2", "result", None, "completed", '{"success": true}'),
        ("c", 4, "3", "call", "edit", None, "{}"), ("c", 5, "4", "result", None, None, "{}"), ("c", 6, None, "call", "edit", None, "{}"),
        ("d", 0, "1", "result", None, None, "{}"), ("d", 1, "1", "call", "run", None, "{}"), ("d", 2, "1", "result", None, "Cancelled", None),
        ("d", 3, "5", "call", "run", None, None), ("d", 4, "5", "result", None, None, "plain"), ("d", 5, "6", "call", "run", None, None), ("d", 6, "6", "result", None, None, '{"isError": true}'),
    ]
    items = spark.createDataFrame(rows, "conversation string, ordinal int, call_id string, kind string, tool string, status string, body string")
    got = {(r["conversation"], r["call_id"]): r["state"] for r in calls.paired_calls(items).collect()}
    assert got == {("c", "1"): "failed", ("c", "2"): "done", ("c", "3"): "truncated", ("d", "1"): "failed", ("d", "5"): "done", ("d", "6"): "failed"}
    assert calls.paired_calls(items.limit(0)).collect() == []


def test_print_and_export(spark, tmp_path):
    rows = spark.createDataFrame([(2, None), (1, "x"), (3, "y")], "id int, t string")
    out = io.StringIO()
    assert sinks.print_json(rows, "id", out=out) == 3
    assert [json.loads(x)["id"] for x in out.getvalue().splitlines()] == [1, 2, 3]
    sinks.export_spans(rows, str(tmp_path / "l"))
    lines = [json.loads(x) for f in (tmp_path / "l").glob("part-*") for x in f.read_text().splitlines()]
    sinks.export_spans(rows, str(tmp_path / "a"), "json")
    arrays = [r for f in (tmp_path / "a").glob("part-*") if (t := f.read_text()) for r in json.loads(t)]
    assert sorted(lines, key=lambda r: r["id"]) == sorted(arrays, key=lambda r: r["id"]) == [{"id": 1, "t": "x"}, {"id": 2, "t": None}, {"id": 3, "t": "y"}]
    with pytest.raises(ValueError):
        sinks.export_spans(rows, str(tmp_path / "x"), "xml")
