"""WARC fixity audit with Merkle trees over records and ordered offset ranges.

A leaf is the SHA-256 of a record at its offset in its file. Above it, nodes cover ordered offset
ranges of a file: LEAF_RANGE bytes, then ARITY times as many a level, up to one root per file. A
node's hash is the SHA-256 of its children's positions and hashes in order. Two replicas are compared
by roots; only the children of nodes that differ are compared a level below, so the rows compared are
in proportion to the damage. Children of a node are few by construction (a range holds no more records
than fit into it), so no group grows with the corpus; only hashes are shuffled, never records. Offsets
are sums over a file's parts first (an id and the first digits of a hash), then over the different
records of a part, so an id of very many records, or none, makes no task of its own.

Defined results: a null url or html counts as empty; pages without an id make up a file of their own,
numbered -1, after which nothing depends on ids but order; repeated pages are records each; a record at
an offset where a replica has none is `missing`, the other way round `extra`, and one of another hash
`changed`; records of one id are in the order of their hashes, equal ones side by side; pages are hashed whole,
however long; further columns go, whatever their names; two replicas without records give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

LEAF_RANGE, ARITY = 1 << 16, 16
PAGES_A_FILE = 1000
PART_DIGITS = 3  #: rows of one id are placed in parts by so many digits of their hash, whose sizes are summed first


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC resource record of a page."""
    body, uri = F.coalesce(html, F.lit("")), F.coalesce(url, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        uri,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def tree(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes (file, at, hash) of each level from leaves(file, at, hash), whose `at` is an offset; the last level is the roots."""
    found, width = [leaves.select("file", "at", "hash")], LEAF_RANGE
    for _ in range(levels):
        below = found[-1]
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "hash"))), lambda x: F.concat_ws(":", x["at"].cast("string"), x["hash"])), ",")
        step = width if below is found[0] else ARITY
        nodes = below.groupBy("file", F.floor(F.col("at") / step).alias("at")).agg(F.sha2(joined, 256).alias("hash"))
        found.append(cut(nodes, "warc-nodes"))
    return found


def levels_for(last_offset: int) -> int:
    """Levels above the leaves until one range covers a file."""
    levels, width = 1, LEAF_RANGE
    while last_offset >= width:
        levels, width = levels + 1, width * ARITY
    return levels


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """file, at, fault, ours and theirs (hashes) of each damaged record of two replicas' leaves(file, at, hash)."""
    last = ours.select("at").union(theirs.select("at")).agg(F.max("at")).first()[0]
    levels = levels_for(last or 0)
    a, b = tree(ours, levels), tree(theirs, levels)
    suspects = None
    for level in range(levels, -1, -1):
        step = LEAF_RANGE if level == 0 else ARITY
        sides = []
        for side, name in ((a[level], "ours"), (b[level], "theirs")):
            side = side.select("file", "at", F.col("hash").alias(name))
            if suspects is not None:
                below = suspects.select(F.col("file").alias("_f"), F.col("at").alias("_a"))
                side = side.join(below, (F.col("file") == F.col("_f")) & (F.floor(F.col("at") / step) == F.col("_a")), "left_semi")
            sides.append(side)
        differ = sides[0].join(sides[1], ["file", "at"], "full").where(~F.col("ours").eqNullSafe(F.col("theirs")))
        suspects = cut(differ, "warc-differ") if level else differ
    fault = F.when(F.col("theirs").isNull(), "missing").when(F.col("ours").isNull(), "extra").otherwise("changed")
    return suspects.withColumn("fault", fault)


def replicas(pages: DataFrame) -> DataFrame:
    """file, at, page_id, length, ours and theirs (record hashes) of pages as WARC files, and of a second replica of them.

    The second replica stands for one on failing disks: of the records whose hash begins with 00 the
    first byte of the page is another, and those whose hash begins with 01 can't be read.
    """
    page = F.col("page_id")
    text = record_text(page, F.col("url"), F.col("html"))
    body = F.coalesce("html", F.lit(""))
    hashed = pages.select(page, F.coalesce(F.floor(page / PAGES_A_FILE), F.lit(-1)).alias("file"), F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("ours"), "url", "html")
    broken = record_text(page, F.col("url"), F.concat(F.lit("\0"), F.substring(body, F.lit(2), F.length(body))))
    theirs = F.when(F.col("ours").startswith("00"), F.sha2(broken, 256)).when(~F.col("ours").startswith("01"), F.col("ours"))
    hashed = hashed.select("page_id", "file", "length", "ours", theirs.alias("theirs"))
    # equal records stand one after the other: one row stands for them until offsets are known
    own = ["file", "page_id", "part"]
    hashed = hashed.withColumn("part", F.substring("ours", 1, PART_DIGITS)).groupBy(*own, "ours", "theirs", "length").agg(F.count(F.lit(1)).alias("copies"))
    hashed = cut(hashed, "warc-distinct")
    size = F.col("length") * F.col("copies")
    earlier = Window.partitionBy("file").orderBy("page_id", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(hashed.groupBy(*own).agg(F.sum(size).alias("size")), "warc-parts")
    parts = parts.select(F.col("file").alias("_file"), F.col("page_id").alias("_page"), F.col("part").alias("_part"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    before = Window.partitionBy(*own).orderBy("ours").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("inside", F.coalesce(F.sum(size).over(before), F.lit(0)))
    placed = placed.join(parts, (F.col("file") == F.col("_file")) & F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("part") == F.col("_part")))
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return placed.select("page_id", "file", "length", "ours", "theirs", (F.col("start") + F.col("inside") + F.col("copy") * F.col("length")).alias("at"))


def op3_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged records of a second replica of all pages, located by the audit."""
    both = cut(replicas(table(spark, sf_dir, "pages")), "warc-records")
    found = audit(both.select("file", "at", F.col("ours").alias("hash")), both.where("theirs is not null").select("file", "at", F.col("theirs").alias("hash")))
    located = found.join(both.select("file", "at", "page_id", "length"), ["file", "at"])
    return located.select("page_id", F.col("file").alias("file_id"), F.col("at").alias("record_offset"), "length", "fault", "ours", "theirs")


SQL = rf"""
WITH t AS (SELECT page_id, url, html, coalesce(CAST(floor(page_id / {PAGES_A_FILE}) AS BIGINT), -1) AS file_id,
  'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) AS head,
  coalesce(html, '') AS body, chr(13) || chr(10) || chr(13) || chr(10) AS tail FROM pages),
h AS (SELECT *, strlen(head || body || tail) AS length, sha256(head || body || tail) AS ours FROM t),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file_id ORDER BY page_id, ours ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS record_offset FROM h)
SELECT page_id, file_id, CAST(record_offset AS BIGINT) AS record_offset, CAST(length AS BIGINT) AS length, CASE WHEN ours LIKE '01%' THEN 'missing' ELSE 'changed' END AS fault, ours,
  CASE WHEN ours LIKE '00%' THEN sha256(encode(head) || '\x00'::BLOB || encode(substr(body, 2)) || encode(tail)) END AS theirs
FROM o WHERE ours LIKE '00%' OR ours LIKE '01%'
"""
