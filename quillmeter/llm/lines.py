"""Line dedup by site-relative frequency, in DataFrame functions alone.

Pages are grouped by host; the pages that contain a line are divided by the host's page
total, and lines above the boilerplate ratio are dropped from every page of that host.
A line on one page alone repeats nothing, whatever its share of a small host.

A page is a row. Where copies are to be removed later, distinct=True counts each text of a host
as one page, in both counts: else the lines of a large group of copies are boilerplate, and
nothing is left of the group to be found (the pipeline's choice, as near-dedup comes after it).

Only 64-bit hashes of lines (and texts) are shuffled, never texts; counts are combined
before they meet, so a hot host or line is a few rows for each task. A host has at most
(mean lines of a page) / ratio boilerplate lines, so the lists that go back to the pages
are small; they are broadcast only below BROADCAST_ROWS lines, counted first.

Defined cases: blank lines (of spaces, tabs, returns, feeds alone) are never dropped and never
counted; null text stays null with 0 lines, and counts as a page (with distinct, as the empty one);
a null host is a host of its own; a line occurring twice in a page counts once; a line on exactly the
ratio's share of pages stays; all copies of a dropped line go; repeated rows are pages of their own and
stay repeated; very long texts are split whole; an empty table stays empty; columns of pages other
than host and text pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize

RATIO_PERCENT = 8
#: Lines of all hosts together up to which the lists are broadcast (16 bytes each).
BROADCAST_ROWS = 200_000
#: What a blank line consists of besides spaces.
BLANKS = " \t\r\x0b\f"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) == ""


def boilerplate(pages: DataFrame, host: str, text: str, ratio_percent: int = RATIO_PERCENT, distinct: bool = False) -> DataFrame:
    """host, line (hash), n_pages of lines on several pages and over ratio_percent of the host's pages."""
    keyed = pages.select(F.col(f"`{host}`").alias("host"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("page"), F.col(f"`{text}`").alias("text"))
    n = F.count_distinct("page") if distinct else F.count("*")
    totals = keyed.groupBy("host").agg(n.alias("pages"))
    hashes = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: ~_blank(x)), lambda x: F.xxhash64(x)))
    counts = keyed.select("host", "page", F.explode(hashes).alias("line")).groupBy("host", "line").agg(n.alias("n_pages"))
    counts = counts.filter("n_pages > 1")
    joined = counts.join(totals.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")))
    return joined.filter(F.col("n_pages") * 100 > F.col("pages") * ratio_percent).select("host", "line", "n_pages")


def drop_lines(spark: SparkSession, pages: DataFrame, host: str, text: str, ratio_percent: int = RATIO_PERCENT, distinct: bool = False) -> DataFrame:
    """pages with boilerplate lines gone from the text column, and _n_lines and _n_dropped beside it."""
    found = materialize(spark, boilerplate(pages, host, text, ratio_percent, distinct), "boilerplate")
    lists = found.groupBy(F.col("host").alias("_host")).agg(F.collect_list("line").alias("_drop"))
    if found.count() <= BROADCAST_ROWS:
        lists = F.broadcast(lists)
    names = pages.columns
    plain = pages.toDF(*(f"c{i}" for i in range(len(names))))  # so that no name clashes
    own, body = f"c{names.index(host)}", F.col(f"c{names.index(text)}")
    joined = plain.join(lists, plain[own].eqNullSafe(lists["_host"]), "left")
    listed = F.coalesce("_drop", F.array().cast("array<bigint>"))
    kept = F.filter(_lines(body), lambda x: _blank(x) | ~F.array_contains(listed, F.xxhash64(x)))
    out = joined.withColumn("_kept", kept).withColumn("_n", F.when(body.isNull(), 0).otherwise(F.size(_lines(body))))
    columns = [(F.array_join("_kept", "\n") if n == text else F.col(f"c{i}")).alias(n) for i, n in enumerate(names)]
    return out.select(*columns, F.col("_n").alias("_n_lines"), F.when(body.isNull(), 0).otherwise(F.col("_n") - F.size("_kept")).alias("_n_dropped"))


def oracle_sql(ratio_percent: int = RATIO_PERCENT) -> str:
    return f"""
WITH pages AS (SELECT row_number() OVER () AS page, source, text FROM documents),
totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
occurrences AS (SELECT DISTINCT page, source, unnest(string_split(text, chr(10))) AS line FROM pages WHERE text IS NOT NULL),
counts AS (SELECT source, line, count(*) AS n FROM occurrences
           WHERE trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> '' GROUP BY source, line HAVING count(*) > 1),
lists AS (SELECT c.source, list(c.line) AS gone FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
          WHERE c.n * 100 > t.pages * {ratio_percent} GROUP BY c.source),
split AS (SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS parts, coalesce(l.gone, []) AS gone
          FROM documents d LEFT JOIN lists l ON d.source IS NOT DISTINCT FROM l.source),
kept AS (SELECT doc_id, source, parts, list_filter(parts, lambda x: NOT list_contains(gone, x)) AS rest FROM split)
SELECT doc_id, source, CAST(coalesce(len(parts), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(parts) - len(rest), 0) AS INTEGER) AS n_dropped,
       CASE WHEN parts IS NULL THEN NULL ELSE array_to_string(rest, chr(10)) END AS text
FROM kept"""
