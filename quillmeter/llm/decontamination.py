"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions alone.

Texts are lower-cased (A-Z) and cut at white space; a shingle is five words, or the whole
sequence of a shorter text. A document is contaminated by an item if it contains at least
80 % of the item's distinct shingles.

Items are partitioned by size into classes (powers of two). A class fixes the length of an
item's bottom-k MinHash sketch: k = floor(0.2 * upper end of the class) + 1 smallest shingle
hashes. A document that contains 80 % of an item misses fewer than k of its shingles, so at
least one hash of the sketch is in the document: the search loses nothing, however long the
document. Documents are probed with their full shingle sets, candidates are verified by
exact containment.

The sketches of all items make one bitmap (a Bloom filter of one hash) of a size that follows their
counted number, up to MOST_BITS; beyond, it only lets more through. Documents are read once for the
search: shingles that are not in the bitmap end in the scan, the few others meet the table of
sketch hashes, broadcast only below BROADCAST_HASHES entries, counted first, and shuffled beyond.
Documents with a candidate are shingled a second time for the verification, each distinct text once.
A text is known by its 64-bit hash and size.

Defined cases: null, empty and blank texts have no shingle, so such documents contain nothing
and such items are found nowhere; an item of under five words is found wherever its words stand
in a row, so documents are probed with shingles of these lengths too where items have them (the
SQL, which knows five-word shingles and whole texts alone, agrees on items of five words or more);
repeated rows of a doc_id give one pair with the largest count; a null
doc_id is a group of its own; exactly 80 % counts as contained; texts and items of any length are
shingled whole; empty tables give no rows; only doc_id and text, item_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize

WORDS = 5
PERCENT = 80
#: Bits of the bitmap for each sketch hash, and at most (16 MB).
BITS_EACH, MOST_BITS = 32, 1 << 27
#: Sketch entries, and shingles of items, up to which they are broadcast (16 and 8 bytes each), counted first.
BROADCAST_HASHES, BROADCAST_SHINGLES = 1_000_000, 2_000_000
#: Contaminated documents up to which their keys are broadcast (16 bytes each), counted first; beyond, a shuffled anti-join.
BROADCAST_LEAKS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]+"


def _word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.translate(text, UPPER, LOWER), SPACE), lambda x: x != ""), lambda x: F.xxhash64(x))


def _shingles(text: Column, lengths: tuple[int, ...] = ()) -> Column:
    """Shingle hashes of a text, and those of the further lengths (under WORDS) in words. The words are bound to a lambda's variable, so that they are computed
    once, however the optimiser moves the expression."""

    def of(w: Column) -> Column:
        n = F.size(w)
        long = F.transform(F.sequence(F.lit(0), F.greatest(n - WORDS, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WORDS)]))
        short = F.when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
        own = F.when(n >= WORDS, long).otherwise(short)
        return F.concat(own, *[runs(w, k) for k in lengths]) if lengths else own

    def runs(w: Column, k: int) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), lambda i: F.xxhash64(F.slice(w, i + 1, k)))
        return F.when(F.size(w) >= k, every).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(_word_hashes(text)), of), F.lit(0))


def sketches(items: DataFrame) -> DataFrame:
    """item_id, n_words (WORDS at most), shingles (distinct), n_item, size_class and the bottom-k sketch of each item."""
    counted = items.select("item_id", "text", F.least(F.size(_word_hashes(F.coalesce("text", F.lit("")))), F.lit(WORDS)).alias("n_words"))
    own = counted.select("item_id", "n_words", _shingles(F.coalesce("text", F.lit(""))).alias("shingles"))
    sets = own.select("item_id", "n_words", F.array_sort(F.array_distinct("shingles")).alias("shingles")).distinct()
    sized = sets.withColumn("n_item", F.size("shingles")).filter("n_item > 0").withColumn("size_class", F.ceil(F.log2("n_item")).cast("int"))
    k = F.floor(F.pow(F.lit(2), F.col("size_class")) * (100 - PERCENT) / 100).cast("int") + 1
    return sized.withColumn("sketch", F.slice("shingles", F.lit(1), k))


def _bitmap(spark: SparkSession, hashes: DataFrame, n_hashes: int) -> tuple[DataFrame, int]:
    """One row: an array of longs in which the bits of all hashes (column hit) are set; and the number of bits."""
    bits = 1 << 12
    while bits < min(n_hashes * BITS_EACH, MOST_BITS):
        bits *= 2
    set_ = hashes.select(_word(F.col("hit"), bits).alias("word"), _bit(F.col("hit")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = spark.range(bits // 64).select(F.col("id").cast("int").alias("word"))
    rows = every.join(F.broadcast(set_), "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    row = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bitmap"))
    return materialize(spark, row, "sketch-bitmap"), bits


def _word(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 6).bitwiseAND(bits // 64 - 1).cast("int")


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("text_hash"), F.octet_length(F.coalesce(text, F.lit(""))).alias("n_bytes")]


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, n_shared, n_item of each document and item with containment of at least PERCENT."""
    known = materialize(spark, sketches(items), "benchmark-sketches")
    entries = known.select(F.explode("sketch").alias("hit"), "item_id").distinct()
    n_hashes, n_shingles = known.agg(F.coalesce(F.sum(F.size("sketch")), F.lit(0)), F.coalesce(F.sum("n_item"), F.lit(0))).first()
    lengths = tuple(r["n_words"] for r in known.filter(F.col("n_words") < WORDS).select("n_words").distinct().orderBy("n_words").collect())
    bitmap, bits = _bitmap(spark, entries, n_hashes)
    set_bits = bitmap.scalar()  # read once, and sent along with the tasks

    def shingles(text: Column) -> Column:
        return _shingles(F.coalesce(text, F.lit("")), lengths)

    # exploding an expression, not a column, keeps the optimiser from adding a filter that computes it twice
    every = docs.select(*_key(F.col("text")), F.explode(shingles(F.col("text"))).alias("hit"))
    hits = every.filter(F.get(set_bits, _word(F.col("hit"), bits)).bitwiseAND(_bit(F.col("hit"))) != 0)
    pairs = hits.join(F.broadcast(entries) if n_hashes <= BROADCAST_HASHES else entries, "hit")
    pairs = materialize(spark, pairs.select("text_hash", "n_bytes", "item_id").distinct(), "decontamination-pairs")
    verified = materialize(spark, _verified(docs, known, pairs, shingles, n_shingles), "decontamination-verified")
    # of a document and an item one row is left, whatever the copies of the text: the rows of verified are few
    small = F.broadcast(verified) if verified.count() <= BROADCAST_LEAKS else verified
    found = docs.select("doc_id", *_key(F.col("text"))).join(small, ["text_hash", "n_bytes"])
    return found.groupBy("doc_id", "text_hash", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))


def _verified(docs: DataFrame, known: DataFrame, pairs: DataFrame, shingles, n_shingles: int) -> DataFrame:
    """text_hash, n_bytes, item_id, n_item, n_shared of the pairs whose exact containment is at least PERCENT."""
    wanted = pairs.select("text_hash", "n_bytes").distinct()
    if pairs.count() <= BROADCAST_LEAKS:
        wanted = F.broadcast(wanted)
    texts = docs.select(*_key(F.col("text")), "text").join(wanted, ["text_hash", "n_bytes"], "left_semi")
    texts = texts.groupBy("text_hash", "n_bytes").agg(F.max("text").alias("text"))  # copies of a text are one
    texts = texts.select("text_hash", "n_bytes", F.array_distinct(shingles(F.col("text"))).alias("of_doc"))
    own = known.select("item_id", F.col("n_item").cast("long").alias("n_item"), "shingles")
    full = pairs.join(F.broadcast(own) if n_shingles <= BROADCAST_SHINGLES else own, "item_id").join(texts, ["text_hash", "n_bytes"])
    shared = F.size(F.array_intersect("shingles", "of_doc")).cast("long").alias("n_shared")
    return full.select("text_hash", "n_bytes", "item_id", "n_item", shared).filter(F.col("n_shared") * 100 >= F.col("n_item") * PERCENT)


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated ones; all columns stay as they are."""
    leaks = contaminated(spark, docs, items).select(F.col("doc_id").alias("_leak"), F.col("text_hash").alias("_leak_hash")).distinct()
    leaks = materialize(spark, leaks, "leaks")
    if leaks.count() <= BROADCAST_LEAKS:
        leaks = F.broadcast(leaks)
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["_leak"]) & (F.xxhash64(docs["text"]) == leaks["_leak_hash"]), "left_anti")


def _sql_shingles(key: str, name: str) -> str:
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END) AS g
 FROM (SELECT {key}, list_filter(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {name} WHERE text IS NOT NULL)"""


ORACLE_SQL = f"""
WITH d AS ({_sql_shingles("doc_id", "documents")}), b AS ({_sql_shingles("item_id", "benchmark")}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT d.doc_id, b.item_id, count(*) AS n_shared, n.n_item FROM d JOIN b USING (g) JOIN n USING (item_id)
GROUP BY d.doc_id, b.item_id, n.n_item HAVING count(*) * 100 >= n.n_item * {PERCENT}"""
