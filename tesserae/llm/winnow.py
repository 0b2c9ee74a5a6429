"""Document fingerprints by winnowing.

The k-grams of a text are its runs of K words, lower-cased (A-Z). Their 64-bit hashes roll: a gram's hash is
a cyclic polynomial of its words' hashes, and the next gram's is that one turned by a bit, without
the word that leaves and with the one that comes (shifts and exclusive ors only, which don't
overflow). A block of BLOCK grams rolls on from its first gram, so arrays that grow are short and the
number of steps is in proportion to the text's length. Every window of WINDOW successive k-grams
gives its smallest hash, the rightmost one on ties, with its position in words. So any match of at
least K + WINDOW - 1 words is found, and none of fewer than K words is. All of it is array expressions on one row.

Defined results: a null text counts as empty and has an empty fingerprint; a text of fewer than K
words has one k-gram, all its words; fewer than WINDOW k-grams are one window; equal texts have equal
fingerprints; the likeness of two empty fingerprints is 1, of an empty and another one 0; texts are
read whole, and positions hold for up to 2**31 words. Repeated rows stay repeated: rows of one id
follow each other by a hash of their text, so that a common id's rows can be dealt to many tasks. Further columns go, and working columns have names that begin with `_w_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, cut, table

K, WINDOW, BLOCK = 5, 4, 8
SEGMENTS, ROWS_A_RANGE, MOST_RANGES = 64, 500, 100_000
QUANTILES = 1024  #: an id of more than two of these shares of all rows is found to be common, so there are few common ones
MARK_BITS = 31


def bind(value: Column, then) -> Column:
    """`then` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def turned(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x


def rolled(hashes: Column) -> Column:
    """Hashes of all runs of K values (of all values, if they are fewer), each from the one before it."""
    count = F.when(F.size(hashes) > 0, F.greatest(F.size(hashes) - (K - 1), F.lit(1))).otherwise(0)

    def first(i: Column) -> Column:
        own = F.lit(0).cast("bigint")
        for j in range(K):
            own = own.bitwiseXOR(turned(F.coalesce(F.get(hashes, i + j), F.lit(0).cast("bigint")), K - 1 - j))
        return own

    def block(start: Column) -> Column:
        rest = F.slice(hashes, start + (K + 1), F.least(F.lit(BLOCK - 1), count - start - 1))  # the words that come, one a gram
        step = lambda made, word: F.array_append(made, turned(F.element_at(made, -1), 1).bitwiseXOR(turned(F.get(hashes, start + F.size(made) - 1), K)).bitwiseXOR(word))
        return F.aggregate(rest, F.array(first(start)), step)

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)), F.lit(BLOCK)), block)
    return F.when(F.size(hashes) > 0, F.flatten(blocks)).otherwise(F.array().cast("array<bigint>"))


def picked(grams: Column) -> Column:
    """Positions of each window's smallest gram, the rightmost on ties, each once and in order."""

    def least_of(j: Column) -> Column:
        own = [F.get(grams, j + k) for k in range(WINDOW)]
        place = j
        for k in range(1, WINDOW):
            place = F.when(own[k] <= F.least(*own[:k]) if k > 1 else own[1] <= own[0], j + k).otherwise(place)
        return place

    def few(size: Column) -> Column:
        best = F.array_min(F.transform(grams, lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))))
        return F.when(size > 0, F.array(-best["i"])).otherwise(F.array().cast("array<int>"))

    size = F.size(grams)
    return F.when(size >= WINDOW, F.array_distinct(F.transform(F.sequence(F.lit(0), size - WINDOW), least_of))).otherwise(few(size))


def selected(text: Column) -> Column:
    """array of struct(hash, position) of the selected k-grams of a text, in order of position."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    chosen = lambda grams: F.transform(picked(grams), lambda i: F.struct(F.get(grams, i).alias("hash"), i.alias("position")))
    return bind(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: bind(rolled(hashes), chosen))


def hashes(fingerprint: Column) -> Column:
    """The distinct hashes of a fingerprint, without positions."""
    return F.array_distinct(fingerprint["hash"])


def positions(fingerprint: Column) -> Column:
    """Where the selected k-grams begin, in words."""
    return fingerprint["position"]


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def digest(fingerprint: Column) -> Column:
    return F.sha2(F.array_join(F.transform(fingerprint, lambda x: F.concat_ws(":", F.hex(x["hash"]), x["position"].cast("string"))), ","), 256)


def by_range(docs: DataFrame) -> DataFrame:
    """docs with `_w_mark`, a hash of the text, and `_w_range`, which grows with (doc_id, mark): equal parts of the segments between quantiles.

    Clumped ids so don't meet in one range. A null id comes first. Rows without an id, and those of an id that two successive
    quantiles name, are parted by their marks. The results don't depend on the ranges.
    """
    docs = docs.withColumn("_w_mark", F.pmod(F.xxhash64("text"), F.lit(1 << MARK_BITS)))
    probabilities = ",".join(str(i / QUANTILES) for i in range(QUANTILES + 1))
    found = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("with_id"), F.expr(f"percentile_approx(doc_id, array({probabilities}), {8 * QUANTILES})").alias("q")).first()
    named = found["q"] or []
    by_mark = lambda parts: F.shiftrightunsigned(F.col("_w_mark") * F.least(parts, F.lit(MOST_RANGES)), MARK_BITS)
    parted = F.when(F.col("doc_id").isNull(), by_mark(F.lit((found["n"] - found["with_id"]) // ROWS_A_RANGE + 1)))
    place = F.lit(0)
    edges = sorted(set(named[:: QUANTILES // SEGMENTS]))
    if edges:
        parts = min(MOST_RANGES, found["with_id"] // ROWS_A_RANGE) // SEGMENTS + 1
        within = F.when(F.col("doc_id") > edges[-1], len(edges) * parts + 1)
        for k in range(len(edges) - 1, 0, -1):
            low, high = edges[k - 1 : k + 1]
            inside = F.floor((F.col("doc_id") - low) * (parts / (high - low))).cast("int")
            within = within.when(F.col("doc_id") >= low, 1 + k * parts + F.least(inside, F.lit(parts - 1)))
        place = F.coalesce(within, F.lit(0))
    common = sorted({x for x, y in zip(named, named[1:], strict=False) if x == y})
    if common:
        rows = [(named.count(x) + 1) * found["with_id"] // QUANTILES for x in common]
        ids, sizes = (F.array(*(F.lit(x).cast("bigint") for x in xs)) for xs in (common, [n // ROWS_A_RANGE + 1 for n in rows]))
        before = F.size(F.filter(ids, lambda x: x < F.col("doc_id")))
        is_common = F.array_contains(ids, F.col("doc_id"))
        place = place * (2 * QUANTILES) + F.coalesce(2 * before + is_common.cast("int"), F.lit(0))
        parted = parted.when(is_common, by_mark(F.get(sizes, before)))
    return docs.withColumn("_w_range", place.cast("bigint") * (1 << MARK_BITS) + F.coalesce(parted, F.lit(0)))


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with fp, next_text and next_fp, of the row that follows by doc_id, then by mark and text; the first follows the last.

    Texts move once, to their ranges; within a range a window looks one row on, and the last
    row of a range gets the first row of the next from a small table of one row a range.
    """
    ranged = by_range(docs)
    firsts = ranged.groupBy("_w_range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "_w_mark", "text")).alias("first"))
    firsts = cut(firsts.select("_w_range", F.col("first.text").alias("_w_head")), "winnow-firsts")
    around = firsts.select("_w_range", F.lead("_w_range").over(Window.orderBy("_w_range")).alias("after"), F.min("_w_range").over(Window.partitionBy()).alias("least"))
    around = around.select(F.col("_w_range").alias("_w_of"), F.coalesce("after", "least").alias("_w_range"))
    heads = cut(around.join(firsts, "_w_range").select("_w_of", "_w_head"), "winnow-heads")
    own = Window.partitionBy("_w_range").orderBy(F.asc_nulls_first("doc_id"), "_w_mark", "text")
    placed = ranged.repartition("_w_range").withColumn("fp", selected(F.col("text")))
    seen = placed.select("*", F.lead("text").over(own).alias("_w_text"), F.lead("fp").over(own).alias("_w_fp"))
    seen = seen.join(heads, F.col("_w_range") == F.col("_w_of"), "left")
    return seen.select("doc_id", "text", "fp", F.coalesce("_w_text", "_w_head").alias("next_text"), F.coalesce("_w_fp", selected(F.col("_w_head"))).alias("next_fp"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against its edited text: the last half of its characters replaced by the start of the next document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = with_next(docs).withColumn("edited", edited).withColumn("edited_fp", selected(F.col("edited")))
    rows = rows.withColumns({"_w_own": hashes(F.col("fp")), "_w_edited": hashes(F.col("edited_fp")), "_w_after": hashes(F.col("next_fp"))})
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("fp")).alias("fingerprint"),
        digest(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("_w_own"), F.col("_w_edited")).alias("near_edited"),
        likeness(F.col("_w_own"), F.col("_w_after")).alias("near_next"),
    )
