"""Line deduplication by site-relative frequency.

Pages are grouped by host. The share of a line is the number of the host's pages that contain it
over the number of the host's pages; lines with a share above RATIO that at least LEAST_PAGES of
its pages contain are boilerplate of that host and are dropped from its pages. LEAST_PAGES only
parts a template from two copies of a page, so a footer of a host of three pages goes as well.
RATIO stands in the gap that the tables at sf0.1 show: the most common line of every source is on
8.6 percent of its pages or more, no other line of any source on over 4.8. Copied pages were on 6.2
percent at most in any of the larger tables.

Only line hashes are shuffled for the counts, summed in the map tasks first. A host has at most
(its mean lines per page) / RATIO boilerplate lines, since each is on more than RATIO of its pages:
so these are gathered into one small row per host, whatever the host's size. The texts then meet
their host's row in a join whose side Spark broadcasts if its measured size is small, and else
sort-merges, where a hot host's partition is split.

Defined results: lines are what newlines part, compared without blanks at their ends; blank lines
are neither counted nor dropped; a line that repeats within a page counts once; a null host is a
host of its own; a null text has no lines and stays null; repeated rows count as pages each; a text
that loses no line is returned byte for byte; a share equal to RATIO is not above it, so such a line
stays; whole texts are read, however long; an empty table gives no rows. Working columns have names
that begin with `_line_`; other columns pass through, but for `n_lines` and `n_dropped` in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, named, table

RATIO, LEAST_PAGES = 0.07, 3


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """_line_host and _line_drop (sorted hashes of the lines to drop) of each host that has such lines."""
    of_host, of_text = named(host, text)
    totals = pages.groupBy(of_host.alias("_line_host")).agg(F.count(F.lit(1)).alias("_line_pages"))
    lines = F.filter(F.split(of_text, "\n"), lambda x: F.trim(x) != "")
    counted = (
        pages.select(of_host.alias("_line_host"), F.explode(F.array_distinct(F.transform(lines, _key))).alias("_line_key"))
        .groupBy("_line_host", "_line_key")
        .agg(F.count(F.lit(1)).alias("_line_on"))
        .where(F.col("_line_on") >= least_pages)
    )
    often = counted.alias("c").join(totals.alias("t"), F.col("c._line_host").eqNullSafe(F.col("t._line_host")))
    often = often.where(F.col("_line_on") > ratio * F.col("_line_pages")).select("c._line_host", "_line_key")
    return cut(often.groupBy("_line_host").agg(F.sort_array(F.collect_list("_line_key")).alias("_line_drop")), "line-boilerplate")


def cleaned(pages: DataFrame, host: str = "host", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """pages, all columns in their places, without boilerplate lines; and with `_line_n` and `_line_dropped`, the lines before and the lines dropped."""
    found = boilerplate(pages, host, text, ratio, least_pages)
    of_host, of_text = named(host, text)
    joined = pages.join(found, of_host.eqNullSafe(F.col("_line_host")), "left")
    drop = F.coalesce("_line_drop", F.array().cast("array<bigint>"))
    lines = F.split(of_text, "\n")
    keep = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(drop, _key(x)))
    kept = joined.withColumns({"_line_kept": F.when(F.size(drop) > 0, keep), "_line_n": F.when(of_text.isNull(), 0).otherwise(F.size(lines)).cast("long")})
    dropped = F.when(F.col("_line_kept").isNull(), 0).otherwise(F.col("_line_n") - F.size("_line_kept")).cast("long")
    rest = F.when(dropped > 0, F.array_join("_line_kept", "\n")).otherwise(of_text)
    own = [rest.alias(c) if c == text else named(c)[0] for c in pages.columns]
    return kept.select(*own, "_line_n", dropped.alias("_line_dropped"))


def drop_boilerplate(pages: DataFrame, host: str = "host", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """pages without boilerplate lines, and with `n_lines` and `n_dropped`, which replace columns of these names in any case."""
    made = cleaned(pages, host, text, ratio, least_pages)
    own = named(*(c for c in pages.columns if c.lower() not in ("n_lines", "n_dropped")))
    return made.select(*own, F.col("_line_n").alias("n_lines"), F.col("_line_dropped").alias("n_dropped"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a document's source is its host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, "source").select("doc_id", "source", "n_lines", "n_dropped", "text")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, * FROM documents),
l AS (SELECT row, doc_id, source, text, unnest(CASE WHEN text IS NULL THEN [NULL] ELSE string_split(text, chr(10)) END) AS line,
                  generate_subscripts(CASE WHEN text IS NULL THEN [NULL] ELSE string_split(text, chr(10)) END, 1) AS i FROM d),
t AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
f AS (SELECT source, trim(line, ' ') AS line FROM l WHERE trim(line, ' ') <> '' GROUP BY source, trim(line, ' ') HAVING count(DISTINCT row) >= {LEAST_PAGES}
      AND count(DISTINCT row) > {RATIO} * (SELECT pages FROM t WHERE t.source IS NOT DISTINCT FROM l.source)),
k AS (SELECT l.*, f.line IS NOT NULL AS dropped FROM l LEFT JOIN f ON f.source IS NOT DISTINCT FROM l.source AND f.line = trim(l.line, ' '))
SELECT doc_id, source, CAST(count(line) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       CASE WHEN any_value(text) IS NULL THEN NULL ELSE coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '') END AS text
FROM k GROUP BY row, doc_id, source
"""
