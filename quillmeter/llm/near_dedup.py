"""MinHash near-dedup with tensored banding.

Two small collections of COLLECTION hash groups, each of GROUP minhashes, are computed for a
document; every pair of a group from the one and a group from the other is the key of a table.
So 2 * COLLECTION * GROUP minhashes make COLLECTION ** 2 tables of 2 * GROUP rows each; with 10
and 2, 40 minhashes do for 100 tables. Two sets of similarity s meet in a table with probability
(1 - (1 - s**2)**10)**2: at 0.85 all but about 5 in a million, at 0.8 all but 7 in 100,000.

1. Documents with the same shingle set are one class, named by its least doc_id, from here on.
2. A bucket's leader is its least class; leader and size are aggregated map-side, then joined to
   the bucket's members. Rows of hot buckets, groups and classes aren't shuffled (skewed_join).
   Buckets of one class end here.
3. All classes that a leader leads in any table form its group: every pair that met in a table is
   in the group of the bucket's leader. Where classes of a group are in the group of the leader's
   own first leader too, they needn't be compared with each other once more; a group without
   others is skipped. This leaves about one group for a family of copies, not one a table.
4. Groups are compared exactly, on full sets, in blocks of at most BLOCK_CLASSES classes and about
   BLOCK_SHINGLES shingles: a large group is many pairs of blocks in many tasks. Only a spanning
   forest of the links leaves a block pair, no pairs.
5. Components over these links are the result.

Defined cases: null, empty and blank texts have no shingle, n_shingles 0, and are linked with
nothing; a text of fewer than five words is one shingle; equal sets are one class, however many
rows; rows of one doc_id with different texts are one node with all their links; a null doc_id
is linked with nothing (component_id null, kept true); an empty table gives no rows; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import lean, materialize, skewed_join, small_batches
from .components import connected_components
from .shingles import mix, shingle_sets, slices

COLLECTION, GROUP = 10, 2
BLOCK_CLASSES, BLOCK_SHINGLES = 1000, 400_000
#: Classes to compare up to which their ids are broadcast to the scan of texts (8 bytes each); beyond, a shuffled semi-join.
BROADCAST_CLASSES = 2_000_000
#: Shingles, and sets, that are compared at once.
COLUMNS, ROWS = 2048, 250
#: keep_one numbers rows without doc_id from here to its double, so that a row with a lesser doc_id stays rather than they.
UNNAMED = 1 << 62

_seeds = np.random.default_rng(19930301).integers(1, 1 << 63, (2 * COLLECTION * GROUP, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEYS = [f"{c}{i}" for c in "ab" for i in range(COLLECTION)]


def hash_groups(sets: list[np.ndarray]) -> np.ndarray:
    """(2 * COLLECTION, len(sets)) keys: each combines GROUP minhashes of a nonempty set."""
    flat = np.concatenate(sets)
    begins = np.cumsum([0, *map(len, sets[:-1])])
    out = np.zeros((2 * COLLECTION, len(sets)), np.uint64)
    for f in range(2 * COLLECTION * GROUP):
        h = (flat ^ _seeds[f, 0]) * _seeds[f, 1]
        h ^= h >> np.uint64(32)
        out[f // GROUP] = mix(out[f // GROUP] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(h, begins))
    return out


def _features(batches):
    for batch in batches:
        texts = [(x.as_py() or "").encode() for x in batch.column(1)]
        for a, b in slices(texts):
            sets = shingle_sets(texts[a:b])
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            keys = np.zeros((2 * COLLECTION, len(sets)), np.uint64)
            whole = np.zeros((2, len(sets)), np.uint64)
            if len(full):
                own = [sets[i] for i in full]
                keys[:, full] = hash_groups(own)
                flat, begins = np.concatenate(own), np.cumsum([0, *map(len, own[:-1])])
                whole[0, full] = np.add.reduceat(mix(flat + np.uint64(1)), begins)
                whole[1, full] = np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begins)
            columns = [batch.column(0).slice(a, b - a), pa.array(sizes), *(pa.array(x.view(np.int64)) for x in (*whole, *keys))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "s0", "s1", *_KEYS])


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit key of the shingle set (s0, s1) and the hash groups a0.., b0.. of every document."""
    schema = "doc_id long, n_shingles long, s0 long, s1 long, " + ", ".join(f"{k} long" for k in _KEYS)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(_features), schema)


def candidate_groups(spark: SparkSession, classes: DataFrame) -> DataFrame:
    """leader, class, n_shingles, new: groups that cover every pair of classes meeting in a table (see 2 and 3 above)."""
    a, b = F.array(*_KEYS[:COLLECTION]), F.array(*_KEYS[COLLECTION:])
    keyed = classes.select("class", "n_shingles", a.alias("a"), b.alias("b"))
    keys = F.transform(F.sequence(F.lit(0), F.lit(COLLECTION**2 - 1)), lambda t: F.xxhash64(F.get("a", F.floor(t / COLLECTION).cast("int")), F.get("b", t % COLLECTION), t))
    rows = keyed.select("class", "n_shingles", F.explode(keys).alias("key"))
    buckets = rows.groupBy("key").agg(F.min("class").alias("leader"), F.max("class").alias("last")).filter("leader != last").select("key", "leader")
    led = materialize(spark, rows.join(buckets, "key").groupBy("leader", "class").agg(F.max("n_shingles").alias("n_shingles")), "led")
    home = materialize(spark, led.groupBy("class").agg(F.min("leader").alias("home")), "homes")
    size = materialize(spark, led.groupBy("leader").agg(F.count("*").alias("_n")), "group-sizes")
    own = skewed_join(led, home.withColumnRenamed("class", "leader"), ["leader"], size)
    known = led.select(F.col("leader").alias("home"), "class", F.lit(True).alias("known"))
    flagged = own.join(known, ["home", "class"], "left").withColumn("new", F.col("known").isNull() | (F.col("home") == F.col("leader")))
    flagged = materialize(spark, flagged.select("leader", "class", "n_shingles", "new"), "groups")
    active = flagged.groupBy("leader").agg(F.max("new").alias("any"), F.count("*").alias("n"), F.sum("n_shingles").alias("mass")).filter("any").drop("any")
    return skewed_join(flagged, materialize(spark, active, "active-groups"), ["leader"], size)


def _compare(similar: int):
    """Links of each block pair: a spanning forest of pairs with 100 * shared >= similar * union, of which one at least is new."""

    def links(ids: np.ndarray, sets: list[np.ndarray], new: np.ndarray) -> tuple[list[int], list[int]]:
        n = len(sets)
        sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(n), sizes)
        values, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.cumsum(often > 1) - 1
        shared = often[column] > 1  # a shingle of one set alone is in no intersection
        owner, column = owner[shared], rank[column[shared]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((n, n), np.int32)
        for at in range(0, int((often > 1).sum()), COLUMNS):
            lo, hi = np.searchsorted(column, [at, at + COLUMNS])
            block = np.zeros((n, COLUMNS), np.float32)
            block[owner[lo:hi], column[lo:hi] - at] = 1
            np.add(common, block @ block.T, out=common, casting="unsafe")  # a product is at most COLUMNS, a whole number
        found = np.zeros((n, n), bool)
        for at in range(0, n, ROWS):  # in whole numbers, some rows at a time
            rows = slice(at, at + ROWS)
            shared_ = common[rows].astype(np.int64)
            found[rows] = (100 + similar) * shared_ >= similar * (sizes[rows, None] + sizes[None, :])
            found[rows] &= new[rows, None] | new[None, :]
        found = np.triu(found, 1)
        parent = list(range(n))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        us, vs = [], []
        for x, y in zip(*np.nonzero(found), strict=True):
            if (p := root(x)) != (q := root(y)):
                parent[q] = p
                us.append(int(ids[x]))
                vs.append(int(ids[y]))
        return us, vs

    def run(batches):
        key, ids, sets, new = None, [], [], []

        def flush():
            us, vs = links(np.array(ids), sets, np.array(new)) if len(sets) > 1 else ([], [])
            return pa.RecordBatch.from_pydict({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            for r in batch.to_pylist():
                if (k := (r["leader"], r["first"], r["second"])) != key:
                    if sets:
                        yield flush()
                    key, ids, sets, new = k, [], [], []
                ids.append(r["class"])
                sets.append(np.frombuffer(r["set"], np.uint64))
                new.append(r["new"])
        if sets:
            yield flush()

    return run


def _sets(batches):
    for batch in batches:
        texts = [(x.as_py() or "").encode() for x in batch.column(1)]
        for a, b in slices(texts):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in shingle_sets(texts[a:b])], pa.binary())], names=["class", "set"])


def verified_links(spark: SparkSession, docs: DataFrame, groups: DataFrame, similar: int) -> DataFrame:
    """u, v: links between classes that connect what the exact similarity connects."""
    wanted = materialize(spark, groups.select("class").distinct(), "classes")
    if wanted.count() <= BROADCAST_CLASSES:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("class"), "text").join(wanted, "class", "left_semi")
    sets = texts.mapInArrow(lean(_sets), "class long, set binary")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_CLASSES), F.ceil(F.col("mass") / BLOCK_SHINGLES)).cast("int")
    placed = groups.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    placed = placed.select("leader", "class", "new", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("leader", "class", "new", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"))
    dealt = placed.join(sets, "class").repartition("leader", "first", "second").sortWithinPartitions("leader", "first", "second")
    return dealt.select("leader", "first", "second", "class", "new", "set").mapInArrow(lean(_compare(similar)), "u long, v long")


def near_duplicates(spark: SparkSession, docs: DataFrame, similar: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs; similar: least similarity of a link in percent."""
    small_batches(spark)
    known = materialize(spark, features(docs), "features")
    signature = [F.max(k).alias(k) for k in _KEYS]
    classes = known.filter("n_shingles > 0 and doc_id is not null").groupBy("s0", "s1", "n_shingles").agg(F.min("doc_id").alias("class"), F.count("*").alias("_n"), *signature)
    classes = materialize(spark, classes, "signatures")
    groups = materialize(spark, candidate_groups(spark, classes), "candidates")
    labels = connected_components(spark, verified_links(spark, docs, groups, similar))
    named = classes.select("s0", "s1", "n_shingles", "class").join(labels.withColumnRenamed("node", "class"), "class", "left")
    # classes that share a doc_id (rows of one id with different texts) are one node
    named = named.select("s0", "s1", "n_shingles", F.coalesce("component", "class").alias("component_id"))
    named = materialize(spark, named, "components")
    rows = known.select("doc_id", "n_shingles", "s0", "s1")
    keys = ["s0", "s1", "n_shingles"]
    out = skewed_join(rows.filter("n_shingles > 0"), named, keys, classes.select(*keys, "_n"), "left")
    out = out.unionByName(rows.filter("n_shingles = 0").withColumn("component_id", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def keep_one(spark: SparkSession, docs: DataFrame, similar: int = 80) -> DataFrame:
    """docs with one document of each group left, the one with the least doc_id; all columns stay as they are.
    Of rows that repeat a doc_id, the one with the least text stays, whatever the others' texts. Rows without
    doc_id are compared by a number made of their text, so of their copies too one stays; those without a word stay."""
    node = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2) + F.lit(UNNAMED))
    gone = materialize(spark, near_duplicates(spark, docs.select(node.alias("doc_id"), "text"), similar).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "duplicates")
    if gone.count() <= BROADCAST_CLASSES:
        gone = F.broadcast(gone)
    left = docs.join(gone, node == gone["_gone"], "left_anti")
    single = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    if not docs.filter(~single).groupBy(node).count().filter("count > 1").isEmpty():
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        order = F.struct("text", F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns]))
        firsts = left.filter(~single).groupBy(node.alias("_node")).agg(F.min_by(row, order).alias("_row")).select("_row.*")
        left = firsts.unionByName(left.filter(single))
    return left
