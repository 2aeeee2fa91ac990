"""Each operator against a brute-force version on a small corpus with odd cases, and on an empty table."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmeter.llm import decontamination, language, lines, media, near_dedup, pieces, quality, repeats, sharding, token_counts
from quillmeter.llm.queries import BYTE_BPE_PATTERN, TOKENIZERS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) >= 5:
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, docs, corpus, percent):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark, docs, percent).collect()]
    nodes = [(r[0], shingles(r[1])) for r in corpus if r[0] is not None]
    parent = {i: i for i, _ in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(nodes):
        for j, b in nodes[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    want = [(r[0], len(shingles(r[1])), None if r[0] is None else root(r[0]), r[0] is None or root(r[0]) == r[0]) for r in corpus]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_near_duplicates_in_blocks(spark, docs, monkeypatch):
    whole = sorted(map(str, near_dedup.near_duplicates(spark, docs).collect()))
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 3)
    monkeypatch.setattr(near_dedup, "BROADCAST_CLASSES", 0)
    assert sorted(map(str, near_dedup.near_duplicates(spark, docs).collect())) == whole


def test_similarity_is_exact_for_very_large_sets():
    """1,700,379 of 2,000,446 is less than 85 %, by less than float32 can tell."""
    import pyarrow as pa

    sizes = {1: 2_000_446, 2: 1_700_379, 3: 1_700_380}
    sets = {k: np.arange(n, dtype=np.uint64).tobytes() for k, n in sizes.items()}
    for a, b, linked in ((1, 2, False), (1, 3, True)):
        rows = [{"leader": 1, "first": 0, "second": 0, "class": k, "new": True, "set": sets[k]} for k in (a, b)]
        found = [r for batch in near_dedup._compare(85)([pa.RecordBatch.from_pylist(rows)]) for r in batch.to_pylist()]
        assert (len(found) == 1) is linked, (a, b)


def test_keep_one(spark, docs):
    left = near_dedup.keep_one(spark, docs)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    labels = {r["component_id"] for r in near_dedup.near_duplicates(spark, docs).collect()}
    assert {i for i in ids if i is not None} == labels - {None}


def test_pieces_equal_the_library(spark, docs, corpus):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = pieces.encode(docs.withColumn("key", F.xxhash64("text")), MODEL, ["doc_id", "key"])
    texts = {r["key"]: r["text"] for r in docs.withColumn("key", F.xxhash64("text")).collect()}
    rows = out.collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert r["ids"] == (sp.encode(texts[r["key"]]) if texts[r["key"]] else [])
        assert r["round_trip"] and r["n_tokens"] == len(r["ids"])
    back = {r["key"]: r["text"] for r in pieces.decode(out, MODEL, ["key"]).collect()}
    assert all(back[k] == (t or "") for k, t in texts.items())


def test_unigram_viterbi_equals_brute_force():
    class Toy(pieces.Model):
        def __init__(self, scores):
            self.unigram, self.ids, self.texts, self.scores = True, {x: i for i, x in enumerate(scores)}, list(scores), list(scores.values())
            self.worst, self.unknown, self.bytes, self.byte_of, self.silent, self.pairs, self.words = min(scores.values()) - 10, -99, {}, {}, set(), {}, {}
            self.ends = {x[k:]: None for x in scores for k in range(1, len(x))} | self.ids
            self.plain = self.texts

    scores = {"▁": -3.1, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -2.7, "bab": -3.9, "ba": -4.05, "c": -6.3}
    toy = Toy(scores)
    words = sorted({"▁" + "".join(p) for n in range(5) for p in __import__("itertools").product("abc", repeat=n)})

    def best(w):
        if not w:
            return 0.0, []
        return max(((best(w[:-k])[0] + scores[w[-k:]], best(w[:-k])[1] + [toy.ids[w[-k:]]]) for k in range(1, len(w) + 1) if w[-k:] in scores), key=lambda x: x[0])

    for w, got in zip(words, toy.encode_words(words), strict=True):
        assert abs(sum(toy.scores[i] for i in got) - best(w)[0]) < 1e-9


def test_quality_learns(spark):
    rng = np.random.default_rng(2)
    good = [(" ".join(rng.choice(["lorem", "ipsum", "dolor", "amet"], 60)), 1) for _ in range(60)]
    bad = [(" ".join(x.upper() + "!!" for x in t.split()), 0) for t, _ in good[:30]]
    rows = [(i, t, q) for i, (t, q) in enumerate(good + bad)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model, ["doc_id"]).collect()}
    held = [(got[i], q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert min(s for s, q in held if q) > 0.5 > max(s for s, q in held if not q)


def test_quality_odd_cases(spark, docs, corpus, empty):
    net = quality.fit([b"good text " * 30, b"BAD!! " * 40] * 4, [1, 0] * 4, (0.5, 0.5), epochs=2)
    rows = quality.score(docs, net, ["doc_id", "score"]).collect()
    assert len(rows) == len(corpus) and all(0 <= r[-1] <= 1 for r in rows)
    assert quality.score(empty, net, ["doc_id"]).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.learn(docs, labels, F.lit(True)) == 0.5
    assert quality.learn(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"), F.lit(True)) == 1.0


def test_chunks_cover_everything():
    for n in (0, 1, 7, 511, 512, 513, 960, 961, 5000):
        data = bytes(range(1, 256)) * 20
        chunks, weight = quality.chunks_of(data[:n])
        assert abs(weight.sum() - 1) < 1e-9
        assert sum(len(c) for c in chunks) >= n
        rebuilt = b"".join(bytes(c[: quality.STEP]) for c in chunks[:-1]) + bytes(chunks[-1])
        assert rebuilt[:n] == data[:n]


def test_decontamination(spark, docs, corpus):
    words = [WORD.findall(r[1] or "") for r in corpus]
    items = [(0, " ".join(words[0][3:20])), (1, " ".join(words[1][:8])), (2, "never seen words in any text at all"), (3, ""), (4, None), (5, "one two"), (6, " ".join(words[30][5:40]).upper()), (7, " ".join([*words[2][:30], "odd"])), (7, " ".join([*words[2][:30], "odd"])), (8, " ".join(words[45][:40]))]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("hits", F.lit(1))
    want = {}
    for r in corpus:
        for i, t in items:
            a, b = shingles(r[1]), shingles(t)
            if b and 100 * len(a & b) >= 80 * len(b):
                want[r[0], i] = max(want.get((r[0], i), 0), len(a & b))
    got = {}
    for r in decontamination.contaminated(spark, docs, table).collect():
        got[r["doc_id"], r["item_id"]] = max(got.get((r["doc_id"], r["item_id"]), 0), r["n_shared"])
    assert got == want and len(want) > 5
    left = decontamination.clean(spark, docs, table)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(r[0]) for r in corpus if not any(shingles(t) and 100 * len(shingles(r[1]) & shingles(t)) >= 80 * len(shingles(t)) for _, t in items))


def test_decontamination_beyond_the_broadcasts(spark, docs, monkeypatch):
    items = docs.select(F.col("doc_id").alias("item_id"), "text").filter("doc_id < 12")
    whole = sorted(map(str, decontamination.contaminated(spark, docs, items).collect()))
    for name in ("BROADCAST_HASHES", "BROADCAST_SHINGLES", "BROADCAST_LEAKS"):
        monkeypatch.setattr(decontamination, name, 0)
    monkeypatch.setattr(decontamination, "MOST_BITS", 1 << 12)
    assert sorted(map(str, decontamination.contaminated(spark, docs, items).collect())) == whole and whole


def test_decontamination_of_many_items_and_a_very_long_one(spark):
    items = spark.range(100_000).select(F.col("id").alias("item_id"), F.concat_ws(" ", *[F.concat(F.lit(f"{c}"), F.xxhash64("id", F.lit(c)).cast("string")) for c in "abcdefg"]).alias("text"))
    long = " ".join(f"w{i}" for i in range(120_000))
    items = items.unionByName(spark.createDataFrame([(-1, long)], "item_id long, text string"))
    picked = {r["item_id"]: r["text"] for r in items.filter("item_id in (5, 77777)").collect()}
    rows = [(1, "some words before " + picked[5] + " and after"), (2, picked[77777]), (3, "w0 w1 w2 w3 w4 w5 w6 w7 and no more"), (4, "before " + " ".join(long.split()[10_000:115_000])), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in decontamination.contaminated(spark, docs, items).collect()}
    assert got == {(1, 5): (3, 3), (2, 77777): (3, 3), (4, -1): (104_996, 119_996)}


@pytest.mark.parametrize("length", [8, 60, 200])
def test_repeats(spark, docs, corpus, length):
    if length < repeats_minimum():
        with pytest.raises(Exception):
            repeats.remove_repeats(spark, docs, ["doc_id"], length).collect()
        return
    texts = [(r[1] or "").encode() for r in corpus]
    counts = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    want = []
    for r, t in zip(corpus, texts, strict=True):
        mark = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                mark[i] += 1
                mark[i + length] -= 1
        gone = np.cumsum(mark)[: len(t)] > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        want.append((r[0], len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in repeats.remove_repeats(spark, docs, ["doc_id"], length).drop("kept").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def repeats_minimum():
    from quillmeter.llm.anchors import GRAM

    return GRAM


def test_repeats_in_blocks(spark, docs, monkeypatch):
    whole = sorted(map(str, repeats.remove_repeats(spark, docs, ["doc_id"]).collect()))
    monkeypatch.setattr(repeats, "BLOCK_CONTEXTS", 1)
    monkeypatch.setattr(repeats, "INDEX_BYTES", 600)
    assert sorted(map(str, repeats.remove_repeats(spark, docs, ["doc_id"]).collect())) == whole


def test_marks_come_from_the_index(spark, docs, corpus, monkeypatch):
    """Without the matching statistics of the index nothing is marked: exact copies, settled contexts and others alike."""
    from quillmeter.llm.run_index import RunIndex

    assert repeats.marks(spark, docs).count() > 100
    plain = spark.createDataFrame([(i, r[1]) for i, r in enumerate(corpus)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(RunIndex, "elsewhere", lambda self: np.zeros(self.n, np.int64))
    monkeypatch.setattr(RunIndex, "matched", lambda self, strings, length: [np.zeros(len(s), bool) for s in strings])
    _, classes = repeats._classes(spark, plain, repeats.LENGTH)
    rows = [{**r.asDict(), "own": 0, "first": 0, "second": 0, "context": bytes(r["context"])} for r in classes.orderBy("h").collect()]
    import pyarrow as pa

    assert len(rows) > 20 and any(r["twice"] for r in rows)
    assert sum(b.num_rows for b in repeats._compare(repeats.LENGTH)([pa.RecordBatch.from_pylist(rows)])) == 0
    monkeypatch.undo()
    found = [r for b in repeats._compare(repeats.LENGTH)([pa.RecordBatch.from_pylist(rows)]) for r in b.to_pylist()]
    sizes = {(r["h"], r["c"]): len(r["context"]) - repeats.LENGTH + 1 for r in rows if r["twice"]}
    whole = {(r["h"], r["c"]) for r in found if (r["lo"], r["hi"]) == (0, sizes.get((r["h"], r["c"])))}
    assert whole == set(sizes)  # classes of several members are found whole


def test_an_anchor_of_many_contexts_in_production_blocks(spark):
    """One passage in over BLOCK_CONTEXTS different surroundings: its anchors' contexts lie in several blocks."""
    import random

    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(230))
    texts = [f"{i:07d}" + "".join(rng.choice("klmnopqrst ") for _ in range(150)) + passage + "".join(rng.choice("uvwxyz ") for _ in range(150)) for i in range(3200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    occurrences, _ = repeats._classes(spark, docs, repeats.LENGTH)
    assert occurrences.groupBy("h").agg(F.count_distinct("c").alias("n")).agg(F.max("n")).first()[0] > repeats.BLOCK_CONTEXTS
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in repeats.remove_repeats(spark, docs, ["doc_id"]).collect()}
    left = collections.Counter(t[156] for t in texts), collections.Counter(t[157 + 230] for t in texts)
    assert min(min(x.values()) for x in left) > 1  # every neighbouring byte is shared by some two texts
    counts = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if counts[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(np.frombuffer(t.encode(), np.uint8)[~gone])
        assert got[i] == (int(gone.sum()), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("distinct", [False, True])
def test_lines(spark, docs, corpus, distinct):
    """By brute force; a host of 25 pages has a line on exactly 8 % of them, another blank lines of tabs, a third a single page."""
    extra = [(1000 + i, f"page {i}\nmenu home\n\nmenu home\n", "en", "s1", 30) for i in range(40)]
    extra += [(2000 + i, f"text {i}\n" + ("exactly\n" if i < 2 else ""), "en", "ties", 30) for i in range(25)]
    extra += [(3000 + i, f"tabbed {i}\n\t \r\n\t \r", "en", "tabs", 30) for i in range(5)] + [(4000, "alone\non its host", "en", "single", 30)]
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, docs.select("doc_id", "text", "lang", "source", "n_chars").schema)).withColumn("host", F.lit("clash"))
    pages, of = collections.defaultdict(set), collections.defaultdict(set)
    rows = [*corpus, *extra]
    for page, r in enumerate(rows):
        own = (r[1] or "") if distinct else page
        pages[r[3]].add(own)
        for x in (r[1] or "").split("\n"):
            if x.strip(" \t\r\f\v"):
                of[r[3], x].add(own)
    gone = {k for k, v in of.items() if len(v) > 1 and 100 * len(v) > lines.RATIO_PERCENT * len(pages[k[0]])}
    assert ("s1", "menu home") in gone and not any(k[1] == "exactly" for k in gone) and not any("\t" in k[1] for k in gone)
    want = [(r[0], None if r[1] is None else "\n".join(x for x in r[1].split("\n") if (r[3], x) not in gone)) for r in rows]
    out = lines.drop_lines(spark, table, "source", "text", distinct=distinct)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want, key=str)


def test_language(spark, docs, corpus):
    known = language.learn(docs, F.lit(True))
    assert sorted(known) == ["en", "xx"]
    rows = {(r["doc_id"], r["text"]): r for r in language.predict(docs, known, ["doc_id", "text"]).collect()}
    letters = [r for r in corpus if r[1] and re.search(r"[^\W\d_]", r[1])]
    for r in corpus:
        got = rows[r[0], r[1]]
        assert 0 <= got["score"] <= 1
        if r not in letters:
            assert (got["lang_pred"], got["accepted"]) == ("und", False)
    long = [r for r in letters if r[2] and len(r[1]) > 100]
    assert sum(rows[r[0], r[1]]["lang_pred"] == r[2] for r in long) >= 0.9 * len(long)
    assert language.accepted(docs, known).columns == docs.columns
    assert language.predict(docs, {}, ["doc_id"]).filter("lang_pred <> 'und'").count() == 0


def test_token_counts(spark, docs, corpus):
    import tiktoken

    path = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    encode = token_counts._encoder(open(path, "rb").read(), BYTE_BPE_PATTERN).encode_ordinary
    n = [len(encode(r[1] or "")) for r in corpus]
    sums = token_counts.token_counts(spark, docs, path, BYTE_BPE_PATTERN).cache()
    for r in sums.collect():
        limit = r["n_tokens"]
        assert r["n_docs"] == n.count(limit)
        assert r["docs_at_least"] == sum(x >= limit for x in n) and r["tokens_at_least"] == sum(x for x in n if x >= limit)
        assert r["docs_fitting"] == sum(x <= limit for x in n) and r["tokens_total"] == sum(n)
        assert r["tokens_truncated"] == sum(min(x, limit) for x in n)
    for limit, total in token_counts.truncated_totals(sums, [1, 10, 77, 10**6]).items():
        assert total == sum(min(x, limit) for x in n)
    assert token_counts.quantiles(sums, [0.5, 1.0]) == {0.5: sorted(n)[-(-len(n) // 2) - 1], 1.0: max(n)}
    assert isinstance(tiktoken.__version__, str)


def test_sharding(spark, docs, corpus, tmp_path):
    rows, slots = sharding.shard(spark, docs, 5, f"file://{tmp_path}/map", 64)
    got = rows.collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in corpus)
    for s in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.SlotMap.load(spark, f"file://{tmp_path}/map", 1) == slots
    loads = [(k * 37) % 101 + 1 for k in range(64)]
    first = sharding.SlotMap.build(loads, 5)
    law = sharding.shard(spark, spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text")), 5)[0]
    bytes_of = [r[0] for r in law.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(bytes_of) == 5 and max(bytes_of) - min(bytes_of) < 0.01 * sum(bytes_of) / 5
    per = [sum(w for w, s in zip(loads, first.shards, strict=True) if s == k) for k in range(5)]
    assert max(per) - min(per) <= max(loads)
    more = first.rebalance(loads, 6)
    moved = [k for k in range(64) if more.shards[k] != first.shards[k]]
    after = [sum(w for w, s in zip(loads, more.shards, strict=True) if s == k) for k in range(6)]
    assert more.version == 2 and 0 < len(moved) <= 64 // 4 and max(after) - min(after) <= max(loads)
    assert all(per[first.shards[k]] > sum(loads) / 6 for k in moved)
    fewer = first.rebalance(loads, 4)
    assert set(fewer.shards) == {0, 1, 2, 3}


def test_media(spark, docs, corpus, tmp_path):
    folder = f"file://{tmp_path}/media"
    rows = media.media_columns(spark, docs, folder).collect()
    assert len(rows) == len(corpus)
    by = collections.defaultdict(list)
    for r in corpus:
        by[str(r[0])].append((r[1] or "").encode())
    for r in rows:
        t = next(x for x in by[str(r["doc_id"])] if hashlib.sha256(media.payload_of(x)).hexdigest() == r["digest"])
        payload = media.payload_of(t)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(payload) % 64 == 0 and payload
        name, body = next(m for m in media.members(folder, r["shard"]) if m[0] == f"{r['digest']}.png")
        assert (len(body), hashlib.sha256(body).hexdigest()) == (r["media_bytes"], r["media_sha256"]) and media.from_png(body) == payload
        counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256) / len(payload)
        mean = sum(i * p for i, p in enumerate(counts))
        dev = sum(p * (i - mean) ** 2 for i, p in enumerate(counts)) ** 0.5
        entropy = -sum(p * np.log2(p) for p in counts if p)
        size, *values = r["feature"].split(";")
        assert size == f"{r['width']}x{r['height']}" == f"64x{len(payload) // 64}"
        assert np.allclose([float(v.split("=")[1]) for v in values], [mean, dev, counts[128:].sum(), entropy], atol=1e-4)
    same = collections.defaultdict(set)
    for r in rows:
        same[r["digest"]].add(tuple(v for k, v in r.asDict().items() if k != "doc_id"))
    assert all(len(x) == 1 for x in same.values()) and len(same) < len(rows)
    big = bytes(range(256)) * (1 << 13)
    assert media.from_png(media.to_png(big)) == big and media.read_header(media.to_png(big)[:33])["width"] == 64
    index = media.store(spark, docs, f"file://{tmp_path}/again")
    meta = media.metadata(index, f"file://{tmp_path}/again").collect()
    heights = {hashlib.sha256(media.payload_of(t)).digest(): len(media.payload_of(t)) // 64 for own in by.values() for t in own}
    assert all((m["bit_depth"], m["width"], m["height"]) == (8, 64, heights[bytes(m["digest"])]) for m in meta)


def test_empty_tables(spark, empty):
    assert near_dedup.near_duplicates(spark, empty).count() == 0
    assert near_dedup.keep_one(spark, empty).count() == 0
    assert pieces.encode(empty, MODEL, ["doc_id"]).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(spark, empty, items).count() == 0
    assert decontamination.clean(spark, empty, items).count() == 0
    assert repeats.remove_repeats(spark, empty, ["doc_id"]).count() == 0
    assert lines.drop_lines(spark, empty, "source", "text").count() == 0
    assert language.learn(empty, F.lit(True)) == {}
    assert language.accepted(empty, {}).count() == 0
    assert token_counts.token_counts(spark, empty, f"{TOKENIZERS}/byte_bpe_50k.tiktoken", BYTE_BPE_PATTERN).count() == 0
    assert sharding.shard(spark, empty, 3)[0].count() == 0
    assert media.media_columns(spark, empty).count() == 0
