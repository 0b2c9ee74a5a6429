"""Mixing sources to target weights by weighted fair queueing.

Each source gets a target share of all words by its weight; no target is above MAX_REPEAT times
the source's size, and what that leaves over goes to the others by weight. Each source's documents
are shuffled by a hash and queued up to MAX_REPEAT times over; the finish time of a queued
document is the source's words up to its end over the source's target. All queues together are
ordered by finish time and cut where the words reach the total budget.

Prefix sums are taken in two levels, so that no source and no global order meets in one task:
sums per range of the shuffle hash (or of finish time), prefix sums over the ranges, and exact
order only within one range, of rows that differ in id or size. The number of ranges follows the number of rows and does not change
results. Only (id, size, source) is shuffled; texts stay where they are, or meet a larger table of
copies in one join.

Defined results: null texts and texts without words have size 0 and are taken 0 times; null
sources are one source, ordered last; null ids order first; repeated rows are documents each; with
no words at all every target is 0; an empty table gives no rows. The document at the cut is taken
if more than half of it fits. Ties are broken by hash, id, size and round; rows equal in id, source
and size, whose queue places are interchangeable, by a hash of their texts. Whole texts are counted,
however long. Working columns begin with `_mix_`; others, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, named, small, table

WEIGHTS, MAX_REPEAT = (5, 2, 1), 3
ROWS_A_RANGE, FEWEST_RANGES, TIMES = 500_000, 256, 8  #: queues are cut near finish time 1; times of TIMES or more share a range
_HASHES = 1 << 60
_ORDER = ("finish", "hash", "id", "size", "round")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_hash(doc_id: Column) -> Column:
    """60 bits of an MD5, that any engine can compute."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size and target of each source, from sizes(source, size). One row a source: a small table."""
    by_name, by_ratio = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy("ratio", "rank")
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("ratio", repeat * F.col("source_size") / F.col("weight"))
        .withColumn("words", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("weight_left", F.sum("weight").over(rest))
        .withColumn("size_left", F.sum("source_size").over(rest))
    )
    # if the sources of lower ratio stop at their limits, so much is left for the others
    left = F.col("words") - repeat * (F.col("words") - F.col("size_left"))
    ranked = ranked.withColumn("left", left).withColumn("free", F.col("left") / F.col("weight_left") <= F.col("ratio"))
    first = F.min(F.when(F.col("free"), F.struct("ratio", "rank", "left", "weight_left"))).over(Window.partitionBy())
    ranked = ranked.withColumn("first", first)
    stops = F.struct("ratio", "rank") < F.struct("first.ratio", "first.rank")
    target = F.when(stops, (repeat * F.col("source_size")).cast("double")).otherwise(F.col("first.left") * F.col("weight") / F.col("first.weight_left"))
    return ranked.select("source", "source_size", target.alias("target"))


def queue(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = MAX_REPEAT) -> DataFrame:
    """sizes(id, source, size) with source_size, target, hash and end: the source's words in the shuffled order up to here."""
    # rows equal in id, source and size follow each other: one row stands for them until ends are known
    sizes = cut(sizes.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("hash", shuffle_hash(F.col("id"))), "mix-sizes")
    ranges = max(FEWEST_RANGES, sizes.count() // ROWS_A_RANGE)
    all_words = F.col("size") * F.col("n")
    shares = cut(targets(sizes.select("source", all_words.alias("size")), weights, repeat), "mix-targets")
    placed = sizes.withColumn("range", F.floor(F.col("hash") * (ranges / _HASHES)).cast("int"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(placed.groupBy("source", "range").agg(F.sum(all_words).alias("in_range")), "mix-ranges")
    sums = sums.select("source", "range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("before"))
    sums = sums.join(small(shares), sums["source"].eqNullSafe(shares["source"])).drop(shares["source"])
    own = Window.partitionBy("source", "range").orderBy("hash", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("here", F.coalesce(F.sum(all_words).over(own), F.lit(0)))
    joined = placed.alias("p").join(sums.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.range") == F.col("s.range")))
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return joined.select("p.id", "p.source", "p.size", "p.hash", "source_size", "target", (F.col("before") + F.col("here") + F.col("copy") * F.col("p.size")).alias("end"))


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = MAX_REPEAT) -> DataFrame:
    """id, source, size, source_size, target and `copies`, how often the mix takes the document, from sizes(id, source, size)."""
    queued = cut(queue(sizes, weights, repeat), "mix-queue")
    ranges = max(1024, queued.count() * repeat // ROWS_A_RANGE)
    finish = lambda r: (r * F.col("source_size") + F.col("end")) / F.col("target")
    times = (
        queued.where("target > 0 and size > 0")
        .withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
        .withColumn("finish", finish(F.col("round")))
        .withColumn("range", F.least(F.floor(F.col("finish") * ranges), F.lit(TIMES * ranges)).cast("int"))
    )
    budget = queued.agg(F.sum("size")).first()[0] or 0
    upto = F.sum("in_range").over(Window.orderBy("range"))
    sums = times.groupBy("range").agg(F.sum("size").alias("in_range")).withColumn("upto", upto)
    at = sums.where(F.col("upto") >= budget).orderBy("range").select("range", (F.col("upto") - F.col("in_range")).alias("before")).first()
    copies = F.lit(0)
    if at:
        own = Window.orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = (
            times.where(F.col("range") == at["range"])
            .withColumn("upto", F.sum("size").over(own) + F.lit(at["before"]))
            .where(F.col("upto") - F.col("size") / 2 <= budget)
            .orderBy(F.desc("upto"), *map(F.desc, _ORDER))
            .first()
        )
        if last:
            limit = F.struct(*(F.lit(last[c]).cast(times.schema[c].dataType).alias(c) for c in _ORDER))
            taken = lambda r: F.struct(finish(F.lit(r)).alias("finish"), "hash", "id", "size", F.lit(r).alias("round")) <= limit
        else:
            taken = lambda r: F.floor(finish(F.lit(r)) * ranges) < at["range"]
        copies = sum((F.when(taken(r), 1).otherwise(0) for r in range(repeat)), F.lit(0))
        copies = F.when((F.col("target") > 0) & (F.col("size") > 0), copies).otherwise(0)
    return queued.select("id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs as the mix takes them: each row as often as its document is taken, with its own columns.

    Rows of one id, source and size follow each other in their queue, so their copies differ by one at
    most, and only where the cut goes between them: there the first ones, by a hash of the text, get
    the greater number. They are counted by hash range first and ordered only within the range where
    the numbers change.
    """
    of_id, of_source, of_text = named(id, source, text)
    keys = ["_mix_id", "_mix_source", "_mix_size"]
    sizes = docs.select(of_id.alias("id"), of_source.alias("source"), words(of_text).alias("size"))
    taken = mix(sizes).groupBy("id", "source", "size").agg(F.min("copies").alias("least"), F.max("copies").alias("most"), F.sum("copies").alias("sum"), F.count(F.lit(1)).alias("n"))
    taken = cut(taken.where("most > 0").select(*(F.col(c).alias(k) for c, k in zip(("id", "source", "size"), keys, strict=True)), F.col("least").alias("_mix_least"), (F.col("sum") - F.col("least") * F.col("n")).alias("_mix_more")), "mix-taken")
    same = of_id.eqNullSafe(F.col("_mix_id")) & of_source.eqNullSafe(F.col("_mix_source")) & (words(of_text) == F.col("_mix_size"))
    joined = docs.join(small(taken), same).withColumn("_mix_copies", F.col("_mix_least"))
    if not taken.where("_mix_more > 0").isEmpty():
        joined = joined.withColumn("_mix_mark", F.xxhash64(of_text)).withColumn("_mix_part", F.shiftright("_mix_mark", 52))
        uneven = joined.where("_mix_more > 0")
        by_part = Window.partitionBy(*keys).orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)
        parts = uneven.groupBy(*keys, "_mix_part").agg(F.count(F.lit(1)).alias("_mix_n")).withColumn("_mix_before", F.coalesce(F.sum("_mix_n").over(by_part), F.lit(0)))
        parts = cut(parts, "mix-parts").select(*(F.col(c).alias(f"{c}_of") for c in (*keys, "_mix_part")), "_mix_before")
        alike = F.lit(True)
        for c in (*keys, "_mix_part"):
            alike = alike & F.col(c).eqNullSafe(F.col(f"{c}_of"))
        place = F.row_number().over(Window.partitionBy(*keys, "_mix_part").orderBy("_mix_mark"))
        uneven = uneven.join(small(parts), alike).withColumn("_mix_place", place + F.col("_mix_before"))
        uneven = uneven.withColumn("_mix_copies", F.col("_mix_least") + F.when(F.col("_mix_place") <= F.col("_mix_more"), 1).otherwise(0)).select(*named(*joined.columns))
        joined = joined.where("_mix_more = 0").unionByName(uneven)
    return joined.where("_mix_copies > 0").withColumn("_mix_round", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))).select(*named(*docs.columns))


def op6_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs.select(F.col("doc_id").alias("id"), "source", words(F.col("text")).alias("size")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
                  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS weight, sum(source_size) OVER () AS words FROM s),
r AS (SELECT *, {MAX_REPEAT} * source_size / weight AS ratio FROM w),
q AS (SELECT *, sum(weight) OVER o AS weight_left, words - {MAX_REPEAT} * (words - sum(source_size) OVER o) AS rest
      FROM r WINDOW o AS (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c AS (SELECT ratio AS r0, rank AS k0, rest AS rest0, weight_left AS weight0 FROM q WHERE rest / weight_left <= ratio ORDER BY ratio, rank LIMIT 1),
t AS (SELECT source, source_size, words, CASE WHEN (ratio, rank) < (r0, k0) THEN CAST({MAX_REPEAT} * source_size AS DOUBLE) ELSE rest0 * weight / weight0 END AS target FROM q, c),
e AS (SELECT d.*, t.source_size, t.target, t.words, sum(size) OVER (PARTITION BY d.source ORDER BY hash, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CASE WHEN target > 0 AND size > 0 THEN (round * source_size + upto) / target END AS finish FROM e, range(0, {MAX_REPEAT}) AS x(round)),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, hash, doc_id, size, round ROWS UNBOUNDED PRECEDING) AS total FROM f WHERE finish IS NOT NULL),
h AS (SELECT doc_id, source, size, hash, upto, count(*) AS copies FROM g WHERE total - size / 2 <= words GROUP BY ALL)
SELECT e.doc_id, CAST(e.size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target, CAST(e.size * coalesce(h.copies, 0) AS BIGINT) AS taken
FROM e LEFT JOIN h ON e.doc_id = h.doc_id AND e.hash = h.hash AND e.upto = h.upto AND e.size = h.size
"""
