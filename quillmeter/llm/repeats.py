"""Suffix-array dedup with a run-length index: removes every byte covered by a string of LENGTH
bytes that starts anywhere else in the corpus too.

No index of the whole corpus is built. Every window of LENGTH bytes has an anchor (a content-chosen
gram, see anchors.py), and equal windows have equal anchors, so windows are compared only where
anchors repeat:

1. Each text's anchors are counted over the corpus by hash, with map-side combining. Anchors seen
   once end there.
2. The contexts of the others (an anchor's context: the bytes of all windows that have it) are cut from
   the distinct texts. Equal contexts of an anchor are one class, counted; that its members are equal is
   checked on bytes, not only on their hashes.
3. The classes of an anchor are indexed in a run-compressed Burrows-Wheeler transform with samples at
   run ends, a class of several members twice. Every mark comes from its matching statistics: windows of
   one index that repeat in it; and, for an anchor of over BLOCK_CONTEXTS classes, windows of one block
   that occur in another one, streamed in both directions. A hot anchor is many pairs of blocks in many tasks.
4. Marks go back from classes to texts, and are merged to spans.

A text is known by a 64-bit hash and its size, an anchor's context by two 64-bit hashes (the anchor's and
its own). Two different contexts of one name stop the job with a message. Two different texts of one name
(of n distinct texts, less than n * n / 2**65 of one size) would share their marks: that isn't checked.
Texts are shuffled twice, compressed: to their anchors and to their spans, neither of which is of bounded size.

Defined cases: null is the empty text; texts under LENGTH bytes stay whole; repeated rows are
copies of each other and vanish whole if they have LENGTH bytes; overlapping matches of a string
with itself count; an empty table gives no rows; only the columns named are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import hot_keys, lean, materialize, skewed_join, small_batches
from .anchors import anchors, range_hashes
from .run_index import RunIndex

LENGTH = 200
#: Contexts of one anchor in a block; bytes of contexts indexed together.
BLOCK_CONTEXTS, INDEX_BYTES = 1500, 200_000
#: Bytes of contexts that a worker holds at once.
HELD_BYTES = 8_000_000

_ANCHOR = "h long, t long, n int, c long, w int, lo int, hi int"


def _keyed(docs: DataFrame, *keep: Column | str) -> DataFrame:
    """keep, t, n and raw: the text's hash, size and bytes."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(*keep, F.xxhash64(text).alias("t"), F.octet_length(text).cast("int").alias("n"), F.encode(text, "UTF-8").alias("raw"))


def _packed(texts: DataFrame) -> DataFrame:
    """texts with raw compressed, for a shuffle of whole texts."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array((pack(x.as_py()) for x in batch.column(batch.num_columns - 1)), pa.binary())], names=batch.schema.names)

    return texts.mapInArrow(lean(run), texts.schema)


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _anchor_rows(length: int):
    """h, t, n, c, w, lo, hi of the anchors of a batch's distinct texts; w: how many of the batch's rows have the text."""

    def run(batches):
        for batch in batches:
            t, n = (batch.column(i).to_numpy() for i in (0, 1))
            _, firsts, often = np.unique(np.stack([t, n.astype(np.int64)]), axis=1, return_index=True, return_counts=True)
            parts, counts = [], []
            for i in firsts.tolist():
                data = np.frombuffer(batch.column(2)[i].as_py(), np.uint8)
                at, h, lo, hi = anchors(data, length)
                counts.append(len(at))
                if len(at):
                    parts.append((h, range_hashes(data, lo, hi + length) + (at - lo).astype(np.uint64), lo, hi))
            if not parts:
                continue
            h, c, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
            per_text = (np.repeat(x, counts) for x in (t[firsts], n[firsts], often.astype(np.int32)))
            t_of, n_of, w_of = per_text
            columns = [h.view(np.int64), t_of, n_of, c.view(np.int64), w_of, lo.astype(np.int32), hi.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "t", "n", "c", "w", "lo", "hi"])

    return run


def _context_rows(length: int):
    """h, c, t, n, lo, size, w of each anchor in a text, and the context's bytes where they are new to the worker."""
    kinds = {"h": pa.int64(), "c": pa.int64(), "t": pa.int64(), "n": pa.int32(), "lo": pa.int32(), "size": pa.int32(), "w": pa.int64(), "context": pa.binary()}

    def run(batches):
        seen, held, rows = {}, 0, {k: [] for k in kinds}
        for batch in batches:
            for r in batch.to_pylist():
                raw = _unpacked(r["raw"])
                for h, c, lo, hi in zip(*(r[k] for k in ("h", "c", "lo", "hi")), strict=True):
                    context = raw[lo : hi + length]
                    known = seen.setdefault((h, c), context)
                    if known is not context:
                        if known != context:
                            raise ValueError(f"two contexts of one name: {h}, {c}")
                        context = None
                    else:
                        held += len(context)
                    for k, v in zip(kinds, (h, c, r["t"], r["n"], lo, hi - lo + 1, r["w"], context), strict=True):
                        rows[k].append(v)
                if held > HELD_BYTES or len(rows["h"]) > 100_000:
                    yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in rows.items()})
                    rows = {k: [] for k in kinds}
                    if held > HELD_BYTES:
                        seen, held = {}, 0
        if rows["h"]:
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in rows.items()})

    return run


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(flags, prepend=False, append=False))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _compare(length: int):
    """h, c, lo, hi: ranges of window starts in a context whose windows are in another context of its anchor."""

    def both(left: list[tuple], right: list[tuple]):
        if not left or not right:
            return
        for own, other in ((left, right), (right, left)):
            index = RunIndex([x[2] for x in own])
            for (h, c, _, _), flags in zip(other, index.matched([x[2] for x in other], length), strict=True):
                for lo, hi in _ranges(flags):
                    yield h, c, lo, hi

    def inside(rows: list[tuple]):
        index = RunIndex([x[2] for x in rows], [x[3] for x in rows])
        edge = np.flatnonzero(np.diff(index.repeated(length), prepend=False, append=False))  # a separator is never repeated
        of = np.searchsorted(index.starts, edge[::2], side="right") - 1
        lo, hi = edge[::2] - index.starts[of], edge[1::2] - index.starts[of]
        h, c = (np.array([x[k] for x in rows])[of] for k in (0, 1))
        return zip(h.tolist(), c.tolist(), lo.tolist(), hi.tolist(), strict=True)

    def run(batches):
        key, cell, pool, size = None, ([], []), [], 0

        def batch_of(found):
            found = list(found)
            cols = list(zip(*found, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_pydict({k: pa.array(v, t) for k, v, t in zip(("h", "c", "lo", "hi"), cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)})

        for batch in batches:
            for r in batch.to_pylist():
                k = (r["h"], r["first"], r["second"])
                if k != key:
                    if cell[0] or cell[1]:
                        yield batch_of(both(*cell))
                    if size > INDEX_BYTES:
                        yield batch_of(inside(pool))
                        pool, size = [], 0
                    key, cell = k, ([], [])
                row = (r["h"], r["c"], r["context"], r["twice"])
                if r["first"] == r["second"]:  # whole anchors and blocks share an index: others have no window of theirs
                    pool.append(row)
                    size += len(r["context"])
                else:
                    cell[r["own"] == r["second"]].append(row)
        if cell[0] or cell[1]:
            yield batch_of(both(*cell))
        if pool:
            yield batch_of(inside(pool))

    return run


def _classes(spark: SparkSession, docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Occurrences (h, c, t, n, lo, size, w) of repeated anchors in distinct texts, and their classes (h, c, _n, twice, context):
    _n occurrences, in several rows of docs or places if twice."""
    texts = _keyed(docs).filter(F.col("n") >= length).select("t", "n", "raw")
    found = materialize(spark, texts.mapInArrow(lean(_anchor_rows(length)), _ANCHOR), "anchors")
    counts = found.groupBy("h").agg(F.count("*").alias("_n"), F.sum("w").alias("of")).filter("of > 1").select("h", "_n")
    counts = materialize(spark, counts, "repeated-anchors")
    # hot anchors are repeated: their rows need no partner, and go anywhere
    hot = hot_keys(counts, ["h"])
    known = F.col("h").isin([r["h"] for r in hot.collect()]) if hot is not None else F.lit(False)
    own = found.withColumn("meet", F.when(known, F.xxhash64("t", "lo")).otherwise(F.col("h")))
    own = own.join(counts.select(F.col("h").alias("meet"), F.lit(True).alias("repeated")), "meet", "left").filter(known | F.col("repeated"))
    # a text's anchors come once from every batch that has it: a set
    sets = own.groupBy("t", "n").agg(F.collect_set(F.struct("h", "c", "lo", "hi")).alias("a"))
    sets = sets.select("t", "n", *[F.col(f"a.{k}").alias(k) for k in ("h", "c", "lo", "hi")])
    whole = _packed(texts).groupBy("t", "n").agg(F.count("*").alias("w"), F.max("raw").alias("raw"))
    cut = whole.join(sets, ["t", "n"]).select("t", "n", "w", "raw", "h", "c", "lo", "hi")
    schema = "h long, c long, t long, n int, lo int, size int, w long, context binary"
    occurrences = materialize(spark, cut.mapInArrow(lean(_context_rows(length)), schema), "contexts")
    grouped = occurrences.groupBy("h", "c").agg(F.count("*").alias("_n"), F.sum("w").alias("of"), F.min("context").alias("context"), F.max("context").alias("largest"))
    checked = F.when(F.col("context") == F.col("largest"), F.col("context")).otherwise(F.raise_error(F.lit("two contexts of one name")))
    return occurrences.drop("context"), grouped.select("h", "c", "_n", (F.col("of") > 1).alias("twice"), checked.alias("context"))


def marks(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """t, n, lo, hi: ranges of window starts, by text, whose windows start elsewhere too."""
    occurrences, classes = _classes(spark, docs, length)
    by_anchor = occurrences.groupBy("h").agg(F.approx_count_distinct("c").alias("classes"), F.count("*").alias("_n"))
    by_anchor = materialize(spark, by_anchor, "anchor-sizes")
    sizes = by_anchor.filter(F.col("classes") > BLOCK_CONTEXTS)
    sizes = sizes.select("h", F.ceil(F.col("classes") / BLOCK_CONTEXTS).cast("int").alias("blocks"))
    placed = classes.join(sizes, "h", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod("c", F.col("blocks")).cast("int"))
    placed = placed.select("h", "c", "context", "twice", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = placed.select("h", "c", "context", "twice", "own", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"))
    dealt = cells.repartition("h", "first", "second").sortWithinPartitions("h", "first", "second")
    matched = dealt.select("h", "first", "second", "own", "c", "context", "twice").mapInArrow(lean(_compare(length)), "h long, c long, lo int, hi int")
    ranges = materialize(spark, matched.groupBy("h", "c").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "ranges")
    places = occurrences.select("h", "c", "t", "n", F.col("lo").alias("base"))
    total = by_anchor.agg(F.sum("_n")).first()[0] or 0
    hot = hot_keys(by_anchor.select("h", "_n"), ["h"], total)  # only these can have a hot class
    counts = None if hot is None else occurrences.join(F.broadcast(hot), "h", "left_semi").groupBy("h", "c").agg(F.count("*").alias("_n"))
    joined = places.join(ranges, ["h", "c"]) if counts is None else skewed_join(places, ranges, ["h", "c"], counts, total=total)
    back = joined.select("t", "n", "base", F.explode("ranges").alias("r"))
    return back.select("t", "n", (F.col("base") + F.col("r.lo")).alias("lo"), (F.col("base") + F.col("r.hi")).alias("hi"))


def spans(marked: DataFrame, length: int = LENGTH) -> DataFrame:
    """t, n, begins, ends: the removed runs of bytes of each text, merged."""
    ordered = marked.select("t", "n", "lo", (F.col("hi") + length - 1).alias("end")).groupBy("t", "n").agg(F.array_sort(F.collect_set(F.struct("lo", "end"))).alias("r"))

    def merge(batches):
        for batch in batches:
            begins, ends = [], []
            for r in batch.column(2):
                x = np.array([(v["lo"], v["end"]) for v in r.as_py()], np.int64)
                reach = np.maximum.accumulate(x[:, 1])
                new = np.append(True, x[1:, 0] > reach[:-1])
                begins.append(x[new, 0].tolist())
                ends.append(reach[np.append(np.flatnonzero(new)[1:] - 1, len(x) - 1)].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(begins, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["t", "n", "begins", "ends"])

    return ordered.mapInArrow(lean(merge), "t long, n int, begins array<int>, ends array<int>")


def _cut(batches):
    for batch in batches:
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")}
        for raw, begins, ends in zip(*(batch.column(i) for i in range(batch.num_columns - 3, batch.num_columns)), strict=True):
            raw, begins, ends = _unpacked(raw.as_py()), begins.as_py() or [], ends.as_py() or []
            kept = b"".join(raw[a:b] for a, b in zip([0, *ends], [*begins, len(raw)], strict=True))
            for k, v in (("n_bytes", len(raw)), ("n_removed", len(raw) - len(kept)), ("n_spans", len(begins)), ("kept", kept), ("kept_sha256", hashlib.sha256(kept).hexdigest())):
                out[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=[*batch.schema.names[:-3], *out])


def remove_repeats(spark: SparkSession, docs: DataFrame, keep: list[str], length: int = LENGTH) -> DataFrame:
    """The columns keep of docs, n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_sha256."""
    small_batches(spark)
    found = materialize(spark, spans(marks(spark, docs, length), length), "spans")
    joined = _keyed(docs, *[F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep)])
    joined = _packed(joined).join(found, ["t", "n"], "left")
    source = joined.select(*[f"_keep_{i}" for i in range(len(keep))], "raw", "begins", "ends")
    schema = source.drop("raw", "begins", "ends").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary").add("kept_sha256", "string")
    cut = source.mapInArrow(lean(_cut), schema)
    outputs = ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
    return cut.select(*[F.col(f"_keep_{i}").alias(f"{c}_in" if c in outputs else c) for i, c in enumerate(keep)], *outputs)
