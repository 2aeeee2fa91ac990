"""Very short texts that tie in whole bytes are told apart by several pieces of the dictionaries."""

from __future__ import annotations

import random

from quillmeter.llm import language


def test_ties_of_short_texts():
    rng = random.Random(5)
    words = {k: ["".join(rng.choice(a) for _ in range(rng.randrange(2, 8))) for _ in range(200)] for k, a in (("en", "etaoinshrd"), ("ex", "etaoinslcm"))}
    model = language.Classifier({k: " ".join(rng.choice(w) for _ in range(3000)).encode() for k, w in words.items()})
    texts = [(rng.choice(words[k]), k) for k in ("en", "ex") * 60]
    ties = [(t, k) for t, k in texts if len(set(model.sizes(t.encode(), language.ONE))) == 1]
    assert len(ties) > 10
    found = [(*model.predict(t), k) for t, k in ties]
    told = [(lang, k) for lang, score, k in found if score > 0]
    assert len(told) > len(ties) / 2 and sum(a == b for a, b in told) > 0.6 * len(told)


def test_sizes_are_those_of_a_naive_version():
    """Every block, whatever its length, behind its lead; block by block, with a compressor made for each."""
    import zstandard

    rng = random.Random(6)
    dictionaries = {k: bytes(rng.choice(a) for _ in range(9000)) for k, a in (("en", b"abcde "), ("ex", b"defgh "))}
    model = language.Classifier(dictionaries)
    for n in (1, 3, 511, 512, 513, 4095, 4096, 4097, 4608, 9000):  # the bounds of pieces and blocks
        data = bytes(rng.choice(b"abcdefgh ") for _ in range(n))
        want = []
        for name in sorted(dictionaries):
            whole = dictionaries[name]
            lead = whole[len(whole) // 2 :][: language.PIECE]

            def packed(x, whole=whole):
                d = zstandard.ZstdCompressionDict(whole, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=language.LEVEL)
                return len(zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(x))

            want.append(sum(packed(lead + data[i : i + language.BLOCK]) - packed(lead) for i in range(0, n, language.BLOCK)))
        assert model.sizes(data, language.ONE) == want


def test_a_long_sample_text_is_taken_from_all_of_it():
    text = b"a" * 50_000 + b"b" * 50_000 + b"c" * 50_000
    got = language._fill([text, b"short"], 6000)
    assert len(got) <= 6001 and got.startswith(b"short\n") and {97, 98, 99} <= set(got) and got.endswith(b"c")
    assert min(got.count(c) for c in b"abc") > 1000


def test_learns_the_picked_text_of_a_repeated_id(spark):
    from pyspark.sql import functions as F

    rows = [(1, "alpha beta gamma", "aa"), (1, "uno dos tres", "bb"), (2, "alpha delta", "aa"), (2, "cuatro cinco", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.learn(docs, F.lit(True))
    assert got["aa"].split() and set(got["aa"].decode().split()) <= {"alpha", "beta", "gamma", "delta"}
    assert set(got["bb"].decode().split()) <= {"uno", "dos", "tres", "cuatro", "cinco"}


def test_held_out_accuracy(spark):
    """Fitted and scored as op7 does it, on rows that were not learned from; by length of the text."""
    from quillmeter.llm.queries import op7_language

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "n_chars")
    rows = [r for r in op7_language(spark, sf).join(docs, "doc_id").collect() if r["held_out"] and r["lang"]]
    long = [r for r in rows if r["n_chars"] >= 100]
    assert len(long) > 150 and sum(r["lang_pred"] == r["lang"] for r in long) >= 0.97 * len(long)
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.95 * len(rows)
