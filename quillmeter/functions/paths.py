"""Which files count as code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions that count as code.
CODE_EXTENSIONS = """
asm astro bash c cc clj cljc cljs cpp cs css cts cxx dart erl ex exs fish fs fsi fsx go gql graphql groovy
h hh hpp hrl hs htm html hxx java jl js jsx kt kts less lhs lua m ml mli mm mjs mts nim php pl pm proto
ps1 psm1 py pyi pyw r raku rb rs s sass scala sc scss sh sol sql svelte swift ts tsx vb vue wat zig zsh
""".split()
# Directories whose files never count.
EXCLUDED_DIRECTORIES = """
.git node_modules vendor vendors dist build target .next .cache coverage generated __generated__ gen out
.turbo .gradle .dart_tool pods deriveddata
""".split()
# Lock files.
LOCK_FILES = """
cargo.lock package-lock.json npm-shrinkwrap.json pnpm-lock.yaml yarn.lock poetry.lock uv.lock pipfile.lock
composer.lock gemfile.lock go.sum go.work.sum bun.lock bun.lockb podfile.lock package.resolved gradle.lockfile
""".split()
EXCLUDED_ENDINGS = [".min.js", ".min.css", ".map"]
# Marks of tests.
TEST_DIRECTORIES = ["test", "tests", "spec", "specs", "__tests__", "fixtures"]
TEST_ENDINGS = ["_test.rs", "_tests.rs", "_test.go", "tests.swift", "_test.py"]


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _pieces(path: Column) -> tuple[Column, Column, Column]:
    lower = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    parts = F.split(lower, "/")
    return lower, parts, F.element_at(parts, -1)


def is_excluded(path: Column) -> Column:
    _, parts, name = _pieces(path)
    return F.arrays_overlap(parts, F.array(*map(F.lit, EXCLUDED_DIRECTORIES))) | name.isin(LOCK_FILES) | _any([name.endswith(e) for e in EXCLUDED_ENDINGS])


def category(path: Column) -> Column:
    """'source', 'test', or null for what doesn't count."""
    _, parts, name = _pieces(path)
    extension = F.when(name.rlike(r"^.+\.[^.]*$"), F.element_at(F.split(name, r"\."), -1))
    test = F.arrays_overlap(parts, F.array(*map(F.lit, TEST_DIRECTORIES))) | name.contains(".test.") | name.contains(".spec.") | name.startswith("test_") | _any([name.endswith(e) for e in TEST_ENDINGS])
    return F.when(~is_excluded(path) & extension.isin(CODE_EXTENSIONS), F.when(test, "test").otherwise("source"))
