"""Merkle manifest of a dataset, with an authentication path for every document by fractal traversal.

A leaf is the SHA-256 of a document's fields. Each source has a tree over its leaves in the order of
doc_id, three children a node (the last node of a level may have fewer, even one); the roots of the
sources, in their order, are the leaves of one more such tree, whose root stands for the dataset. A
document's path holds, level by level up to that root, the siblings to its left and right: with it anyone
can prove a document without the others.

A tree is cut into aligned blocks of 3**BLOCK_LEVELS leaves, one row each, so nothing grows with the
size of a source: first the blocks' roots are made, which are the leaves of the next tier's blocks, until
one block covers each tree; then paths are made from the top tier down, and a block's own paths are
appended the path of its root, which one join brings. Within a block the traversal goes from leaf to leaf
and holds, for each STACKED levels, the subtree with the current leaf (existing) and the one to its
right (desired). The desired one is built by one leaf a step on its own stack, and is whole when
the current leaf enters it. So a block's task holds its leaves and a few dozen nodes, never a tree.

Positions come from a range partitioning by source, id and leaf, written with a running number in each
partition: a source's offset in a partition is a prefix sum over partitions, and no source meets in one task.

Defined results: nulls are told from empty values in a leaf; null sources are one source, the first; null
ids are the first of a source; rows of one id are leaves each, ordered by their leaf, and equal rows
are interchangeable; a lone document's leaf is the root of its source, and its path is empty up there; an
empty table gives no rows; texts of any length are hashed whole; further columns go, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, picked, small, table

ARITY = 3
STACKED, BLOCK_LEVELS = 2, 6  #: levels of a subtree that the traversal holds; levels of a block, a multiple of these
BLOCK = ARITY**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS_A_PART = 250_000


def leaf(*fields: Column) -> Column:
    """SHA-256 of fields, each `-` if null, else its UTF-8 length, `:` and itself."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts), 256)


def positions(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows, a written table, with `at`: the row's place, from 0, among those of its tree (nulls are a tree) in this order."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // ROWS_A_PART)
    sort = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    placed = cut(rows.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id()), "manifest-order")
    part = F.shiftright("_at", 33)  # the partition's number stands above the row's
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(tree, part.alias("_part")).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
    sums = cut(sums.select(F.col(tree).alias("_tree"), "_part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("_shift")), "manifest-offsets")
    found = placed.join(small(sums), part.eqNullSafe(F.col("_part")) & F.col(tree).eqNullSafe(F.col("_tree")))
    return found.withColumn("at", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_tree", "_shift")


def levels_of(n: int) -> int:
    """Levels above n leaves until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class Stack:
    """Grows a subtree leaf by leaf and keeps its nodes of the levels from `low` up to below `top`."""

    def __init__(self, low: int, top: int) -> None:
        self.low, self.kept = low, [[] for _ in range(top - low)]
        self.open: list[list[str]] = [[] for _ in range(top)]  # of each level the nodes that wait for their siblings

    def push(self, node: str, level: int = 0) -> None:
        while level < len(self.open):
            if level >= self.low:
                self.kept[level - self.low].append(node)
            self.open[level].append(node)
            if len(self.open[level]) < ARITY:
                return
            node, self.open[level] = digest(self.open[level]), []
            level += 1

    def close(self) -> None:
        """The leaves end here: what waits goes up without further siblings."""
        for level in range(len(self.open) - 1):
            if self.open[level]:
                node, self.open[level] = digest(self.open[level]), []
                self.push(node, level + 1)


def block_root(leaves: list[str], levels: int) -> str:
    """The root of a block, so many levels above its leaves."""
    stack = Stack(levels, levels + 1)
    for x in leaves:
        stack.push(x)
    stack.close()
    return stack.kept[0][0]


def traverse(leaves: list[str], levels: int) -> Iterator[tuple[list[str], list[str]]]:
    """For each leaf of a block the siblings to the left and to the right of its path, level by level, each joined to one string."""
    bounds = [(low, min(low + STACKED, levels)) for low in range(0, levels, STACKED)]
    n = len(leaves)

    def grown(low: int, top: int, start: int) -> tuple[Stack, int]:
        """A subtree with the leaves from start on, whole."""
        stack, end = Stack(low, top), min(start + ARITY**top, n)
        for x in leaves[start:end]:
            stack.push(x)
        stack.close()
        return stack, end

    existing, desired = [], []
    for low, top in bounds:
        stack, end = grown(low, top, 0)
        existing.append(stack)
        desired.append([Stack(low, top), end])
    for at in range(n):
        for k, (low, top) in enumerate(bounds):
            if at and at % ARITY**top == 0:  # the leaf enters the desired subtree
                desired[k][0].close()
                existing[k], desired[k] = desired[k][0], [Stack(low, top), min(at + ARITY**top, n)]
        lefts, rights = [], []
        for k, (low, top) in enumerate(bounds):
            for level in range(low, top):
                own = existing[k].kept[level - low]
                place = at // ARITY**level - (at // ARITY**top) * ARITY ** (top - level)
                run = place - place % ARITY
                lefts.append("".join(own[run:place]))
                rights.append("".join(own[place + 1 : run + ARITY]))
            stack, then = desired[k]
            if then < n:
                stack.push(leaves[then])
                desired[k][1] = then + 1
        yield lefts, rights


def blocks(nodes: DataFrame, kept: list[str]) -> DataFrame:
    """One row (tree, block, levels, nodes) for each aligned block of nodes(tree, at, n, digest, *kept), n being the tree's number of nodes."""
    levels = sum((F.when(F.col("n") > ARITY**k, 1).otherwise(0) for k in range(BLOCK_LEVELS)), F.lit(0))
    inside = F.sort_array(F.collect_list(F.struct("at", "digest", *kept)))
    block = F.floor(F.col("at") / BLOCK).alias("block")
    return nodes.groupBy("tree", block).agg(F.max(levels).alias("levels"), F.max("n").alias("n"), inside.alias("nodes"))


def block_roots(made: DataFrame) -> DataFrame:
    """tree, at, n and digest: the nodes of the next tier, one of each row of blocks()."""
    bounded_batches(made.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roots = [block_root(x.as_py(), m) for x, m in zip(b.column(4), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(roots, pa.string())], names=["tree", "at", "n", "digest"])

    thin = made.select("tree", "block", F.ceil(F.col("n") / BLOCK).alias("n"), "levels", F.col("nodes.digest").alias("digests"))
    return thin.mapInArrow(run, "tree long, at long, n long, digest string")


def tiers(nodes: DataFrame, kept: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The written blocks of each tier, and the roots: tree and digest of each. Trees that one block covers end at that tier."""
    made, roots = [cut(blocks(nodes, kept), "manifest-blocks")], []
    while True:
        above = cut(block_roots(made[-1]), "manifest-roots")
        roots.append(above.where("n = 1").select("tree", "digest"))
        above = above.where("n > 1")
        if above.isEmpty():
            break
        made.append(cut(blocks(above, []), "manifest-blocks"))
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return made, cut(found, "manifest-trees")


def paths(made: DataFrame, above: DataFrame, kept: list[str]) -> DataFrame:
    """tree, at, digest, lefts, rights and kept of each node in the rows of blocks().

    above(tree, block, lefts, rights) has the paths of the blocks' roots; its other columns go to all nodes of the block.
    """
    bounded_batches(made.sparkSession, rows=16)
    told = [c for c in above.columns if c not in ("tree", "block", "lefts", "rights")]
    above = above.select(F.col("tree").alias("_t"), F.col("block").alias("_b"), "lefts", "rights", *told)
    joined = made.join(above, (F.col("tree") == F.col("_t")) & (F.col("block") == F.col("_b"))).select("nodes", "levels", "tree", *told, "lefts", "rights")
    inner, texts = joined.schema["nodes"].dataType.elementType.fields, pa.list_(pa.string())
    names = [*(f.name for f in inner), "tree", *told, "upper_lefts", "upper_rights", "lefts", "rights"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                own = b.column(0)[i].values  # the block's nodes, a struct array
                found = list(traverse(own.field(1).to_pylist(), b.column(1)[i].as_py()))
                repeat = pa.array([i] * len(own), pa.int32())
                outer = [c.take(repeat) for c in b.columns[2:]]
                yield pa.RecordBatch.from_arrays([*map(own.field, range(len(inner))), *outer, *(pa.array([x[side] for x in found], texts) for side in (0, 1))], names=names)

    types = {f.name: f.dataType.simpleString() for f in (*inner, *joined.schema)}
    schema = ", ".join(f"`{c}` {types.get(c, 'array<string>')}" for c in names)
    found = joined.mapInArrow(run, schema)
    return found.select("tree", "at", "digest", F.concat("lefts", "upper_lefts").alias("lefts"), F.concat("rights", "upper_rights").alias("rights"), *told, *kept)


def authenticated(made: list[DataFrame], tops: DataFrame, kept: list[str]) -> DataFrame:
    """Paths of all nodes of the lowest tier, from tops(tree, lefts, rights): the paths of the trees' own roots. Its other columns go to all nodes of a tree."""
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for tier in reversed(made[1:]):
        inner = paths(tier, above, []).drop("digest").withColumnRenamed("at", "block")
        over = tier.select("tree").distinct()  # the other trees end below this tier and hand their paths down
        above = cut(inner.unionByName(above.join(over, "tree", "left_anti")), "manifest-upper")
    return paths(made[0], above, kept)


def fold(start: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(F.arrays_zip(lefts.alias("l"), rights.alias("r")), start, lambda node, x: F.sha2(F.concat(x["l"], node, x["r"]), 256))


def manifest(docs: DataFrame, changed: Column | None = None) -> tuple[DataFrame, str | None]:
    """doc_id, source, leaf, subroot, lefts and rights of each document, and the dataset's root (None without documents).

    With `changed`, a text by the columns of documents that replaces the text where it isn't null, there
    is also `other`: the leaf with that text, null where it is the same.
    """
    own = picked(docs, *FIELDS)
    fields = [F.col(c) for c in FIELDS]
    kept = leaf(*fields)
    other = F.lit(None).cast("string") if changed is None else F.when(~changed.eqNullSafe(F.col("text")), leaf(*fields[:-1], changed))
    rows = cut(own.select("doc_id", "source", kept.alias("digest"), other.alias("other"), F.monotonically_increasing_id().alias("tie")), "manifest-leaves")
    sources = cut(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "manifest-sources")
    ranked = cut(positions(sources.withColumn("one", F.lit(1)), "one", ["source"]).select(F.col("source").alias("_source"), F.col("at").alias("tree"), "n"), "manifest-ranks")
    placed = positions(rows, "source", ["doc_id", "digest", "tie"])
    nodes = placed.join(small(ranked), F.col("source").eqNullSafe(F.col("_source"))).select("tree", "at", "n", "digest", "doc_id", "other")
    made, subroots = tiers(nodes, ["doc_id", "other"])
    total = subroots.count()
    top = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(total).cast("long").alias("n"), "digest")
    upper, root = tiers(top, [])
    empty = upper[-1].sparkSession.createDataFrame([(0, [], [])], "tree long, lefts array<string>, rights array<string>")
    by_tree = authenticated(upper, empty, []).select(F.col("at").alias("tree"), F.col("digest").alias("subroot"), "lefts", "rights")
    tops = cut(by_tree.join(ranked.select("tree", F.col("_source").alias("source")), "tree"), "manifest-tops")
    found = authenticated(made, tops, ["doc_id", "other"])
    first = root.first()
    return found.select("doc_id", "source", F.col("digest").alias("leaf"), "other", "subroot", "lefts", "rights"), first and first["digest"]


def op11_fractal_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents proved against the root; every second one (by the CRC of its id) after its line breaks were deleted."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found, root = manifest(table(spark, sf_dir, "documents"), tampered)
    lefts, rights = F.col("lefts"), F.col("rights")
    siblings = F.concat_ws("", F.transform(F.arrays_zip(lefts.alias("l"), rights.alias("r")), lambda x: F.concat(x["l"], x["r"])))
    found = found.withColumn("root", F.lit(root).cast("string")).withColumn("folded_root", fold(F.coalesce("other", "leaf"), lefts, rights))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The CRC-32 of a string of digits, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
_FIELD = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
_LEAF = lambda text: "sha256(" + " || ".join([*map(_FIELD, FIELDS[:-1]), _FIELD(text)]) + ")"

SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, {_LEAF("text")} AS leaf, {_LEAF(f"CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS other FROM documents),
p AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  count(*) OVER (PARTITION BY source) AS n FROM d),
low AS (
  SELECT 0 AS level, tree, pos, n, leaf AS digest FROM p
  UNION ALL
  SELECT any_value(level) + 1, tree, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY tree, pos // 3),
tops AS MATERIALIZED (SELECT tree, digest AS subroot FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM tops) AS n, subroot AS digest FROM tops
  UNION ALL
  SELECT any_value(level) + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY pos // 3),
everything AS MATERIALIZED (
  SELECT tree, level, pos, digest, n FROM low WHERE n > 1
  UNION ALL
  SELECT t.tree, h.level + (SELECT max(level) FROM low l WHERE l.tree = t.tree), h.pos, h.digest, h.n FROM high h, tops t WHERE h.n > 1),
height AS MATERIALIZED (SELECT tree, max(level) AS levels FROM low GROUP BY tree),
walk AS (
  SELECT doc_id, tree, pos AS first, leaf, 0 AS level, CASE WHEN n = 1 THEN tree ELSE pos END AS pos, other AS node, '' AS proof FROM p
  UNION ALL
  SELECT w.doc_id, w.tree, w.first, w.leaf, w.level + 1, CASE WHEN w.level + 1 = any_value(h.levels) THEN w.tree ELSE w.pos // 3 END,
    sha256(coalesce(string_agg(e.digest, '' ORDER BY e.pos) FILTER (e.pos < w.pos), '') || w.node || coalesce(string_agg(e.digest, '' ORDER BY e.pos) FILTER (e.pos > w.pos), '')),
    w.proof || coalesce(string_agg(e.digest, '' ORDER BY e.pos) FILTER (e.pos <> w.pos), '')
  FROM walk w JOIN everything e ON e.tree = w.tree AND e.level = w.level AND e.pos // 3 = w.pos // 3 JOIN height h ON h.tree = w.tree
  GROUP BY w.doc_id, w.tree, w.first, w.leaf, w.level, w.pos, w.node, w.proof),
ends AS (SELECT doc_id, tree, first, leaf, arg_max(node, level) AS folded_root, arg_max(proof, level) AS proof FROM walk GROUP BY ALL),
top AS (SELECT digest AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM ends JOIN tops USING (tree), top
"""
