from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named as operators name their own.
CLASHING = ["score", "class", "lang_pred", "accepted", "kept", "h", "t", "n", "raw", "ids", "hits", "shingles", "_drop", "line"]


@pytest.fixture(scope="session")
def corpus():
    """Small texts with every odd case: (doc_id, text, lang, source, n_chars)."""
    rng = random.Random(11)
    words = {l: ["".join(rng.choice(a) for _ in range(rng.randrange(2, 9))) for _ in range(300)] for l, a in (("en", "etaoinshrd"), ("xx", "uvwzyqkjxg"))}

    def prose(lang, n):
        return " ".join(rng.choice(words[lang]) + (".\n" if rng.random() < 0.08 else "") for _ in range(n))

    texts = [(prose(l, rng.randrange(30, 160)), l) for l in ("en", "xx") * 20]
    base = texts[0][0].split(" ")
    for k in range(8):  # near copies of one text, with more and more changed
        w = list(base)
        for _ in range(k):
            w[rng.randrange(len(w))] = "changed"
        texts.append((" ".join(w), "en"))
    texts += [(texts[1][0], "xx")] * 3 + [(texts[2][0].upper(), "en")]
    passage = prose("en", 70)
    texts += [(prose("en", 20) + " " + passage + " " + prose("en", 25), "en") for _ in range(4)]
    texts += [("", "en"), (None, "en"), ("   \n\t ", "xx"), ("one two", "en"), ("one two", "en"), ("123 456 !!", None), ("é中😀 ﬁ", "xx"), ("word " * 3000, "en"), ("x" * 20000, "xx"), (prose("xx", 9000), "xx"), ("abc " * 60, "en")]
    rows = [(i, t, l, f"s{i % 3}" if i % 7 else None, len(t) if t is not None else None) for i, (t, l) in enumerate(texts)]
    rows += [(rows[5][0], *rows[5][1:]), (None, "a null id with some words here", "en", "s1", 30), (None, "a null id with some words here", "en", None, 30), (rows[9][0], "the same id, another text of a few words", "en", "s0", None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus, SCHEMA)
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHING}).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame([], SCHEMA).withColumns({c: F.lit("x") for c in CLASHING})
