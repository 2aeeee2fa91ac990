"""Patches and edits to added and deleted lines."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

# An edit of more cells counts as all lines replaced.
MAX_CELLS = 4_000_000
FILE_SCHEMA = "path string, added array<string>, deleted array<string>, complete boolean"


def fingerprint(line: str) -> str | None:
    """Hash of a line without its white space at both ends; blank lines have none."""
    bare = line.strip()
    return hashlib.sha256(bare.encode()).hexdigest()[:32] if bare else None


def line_changes(old: list[str], new: list[str]) -> tuple[list[str], list[str]]:
    """Deleted and added lines by longest common subsequence; where two are as long, the deletion comes first."""
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    a, b = old[head : len(old) - tail], new[head : len(new) - tail]
    if len(a) * len(b) > MAX_CELLS:
        return a, b
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    deleted, added, i, j = [], [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            deleted.append(a[i])
            i += 1
        else:
            added.append(b[j])
            j += 1
    return deleted + a[i:], added + b[j:]


_HUNK = re.compile(r"^@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@")


def patch_files(patch: str) -> list[dict]:
    """Files of a unified or begin/end patch: path, added, deleted (fingerprints), complete (False if it is cut off)."""
    files: list[dict] = []
    left = None  # lines that the hunk still owes: old, new; None outside hunks with counts
    loose = False

    def start(path: str) -> None:
        files.append({"path": path, "added": [], "deleted": [], "complete": True})

    def owed() -> None:
        if files and left and any(left):
            files[-1]["complete"] = False

    old_path = ""
    for line in patch.splitlines():
        if left and any(left):
            kind = line[:1]
            if kind in ("+", "-", " ", ""):
                left[0] -= kind != "+"
                left[1] -= kind != "-"
                if kind in "+-" and kind and (f := fingerprint(line[1:])):
                    files[-1]["added" if kind == "+" else "deleted"].append(f)
                continue
            if kind == "\\":
                continue
            owed()
        if m := re.match(r"^\*\*\* (?:Add|Update|Delete) File: (.+)$", line):
            start(m[1].strip())
            left, loose = None, True
        elif line.startswith("*** Move to: ") and files:
            files[-1]["path"] = line[13:].strip()
        elif line.startswith("*** End Patch"):
            loose = False
        elif line.startswith("--- ") and not loose:
            old_path = re.sub(r"^a/", "", line[4:].split("\t")[0].strip())
        elif line.startswith("+++ ") and not loose:
            new_path = re.sub(r"^b/", "", line[4:].split("\t")[0].strip())
            start(old_path if new_path == "/dev/null" else new_path)
        elif (m := _HUNK.match(line)) and files and not loose:
            left = [int(m[1] or 1), int(m[2] or 1)]
        elif loose and files and line[:1] in ("+", "-") and (f := fingerprint(line[1:])):
            files[-1]["added" if line[0] == "+" else "deleted"].append(f)
    owed()
    if loose and files:
        files[-1]["complete"] = False
    return files


def explode_patches(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key and the files of each patch."""

    def run(batches):
        for batch in batches:
            out = [(k.as_py(), f) for k, p in zip(batch.column(0), batch.column(1), strict=True) for f in patch_files(p.as_py() or "")]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], batch.schema[0].type), *(pa.array([f[c] for _, f in out], t) for c, t in (("path", pa.string()), ("added", pa.list_(pa.string())), ("deleted", pa.list_(pa.string())), ("complete", pa.bool_())))], names=[key, "path", "added", "deleted", "complete"])

    source = rows.select(key, column)
    return source.mapInArrow(run, f"{key} {source.schema[key].dataType.simpleString()}, {FILE_SCHEMA}")
