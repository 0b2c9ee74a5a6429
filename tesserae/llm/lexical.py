"""Ranked lexical search with a bit-sliced impact index.

The impact of a term on a document is a whole number, a weight by the term's rarity times a part by how
often it occurs and how long the document is; a score is the sum of impacts. The index holds, for
each block of BLOCK documents and each term, bitmaps of impact bits: one for every bit, in which the
documents with that bit are marked. They are kept over the documents of the block that hold the term
(their slots are listed beside), so that rare terms take little room, and are spread over the block when
they are read. To score a block for a query, the bitmaps of its terms are added by carry arithmetic: sums
and carries of all documents at once by bitwise operations. Its best k are found from the most
significant bitmap down: the candidates with that bit stay if there are k or more, and are taken if fewer.

Blocks are the documents of a task as they come, so postings are never shuffled by term and a frequent
term makes no hot group; only the index rows of terms that are asked for go to their block's task, and a
task hands on its k best a query. Statistics are exact and of all documents.

Queries are taken in slices by a hash, each of about SLICE (query, term) rows, which a task can hold:
their number follows the table of queries, whatever its size, and every slice is searched in all blocks.

Defined results: null texts and texts without terms are no results and don't count in the statistics;
queries without terms or results have no rows; rows of one query id are one query with the terms of all,
a null id is an id; null document ids order first among ties; documents of one id are documents each, in
any order where their scores are equal; terms of weight 0 add nothing; texts of any length are
read whole; empty tables give no rows; further columns go, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, picked, table

TOP = 50
BLOCK = 8192  #: documents of a block at most; slots are 16 bits wide
POSTINGS = 1 << 21  #: a block ends before BLOCK documents if it holds so many postings
SLICE = 1_000_000
#: Bytes below 128 that aren't digits or letters part terms; only A-Z are lower-cased.
_TERM_BYTES = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM_BYTES).split()


def queries_of(items: DataFrame, id: str, text: str) -> DataFrame:
    """item_id and term, once each."""
    own = picked(items, id, text).toDF("item_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set(terms_of(x))) for x in b.column(1).to_pylist()]
            places = np.repeat(np.arange(b.num_rows), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(places)), pa.array([t.decode() for x in found for t in x], pa.string())], names=["item_id", "term"])

    return own.mapInArrow(run, f"item_id {own.schema['item_id'].dataType.simpleString()}, term string").distinct()


def postings(docs: DataFrame, id: str, text: str, wanted: DataFrame | None) -> DataFrame:
    """block, slot, doc_id, n (its terms with repeats), terms and tfs of each document with terms.

    Documents of a block are in the order of their ids. With `wanted`, a written table of terms that a task can hold, only these are posted.
    """
    bounded_batches(docs.sparkSession)
    own = picked(docs, id, text).toDF("doc_id", "text")
    shared = None if wanted is None else docs.sparkSession.sparkContext.broadcast(frozenset(r[0].encode() for r in wanted.collect()))
    kind = own.schema["doc_id"].dataType
    schema = f"block long, slot int, doc_id {kind.simpleString()}, n long, terms array<string>, tfs array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, held, size, blocks = shared and shared.value, [], 0, 0
        first = TaskContext.get().partitionId() << 32
        of_id = None

        def flush() -> pa.RecordBatch:
            held.sort(key=lambda x: (x[0] is not None, x[0]))
            ids, n, terms, tfs = zip(*held, strict=True)
            columns = [[first + blocks] * len(ids), range(len(ids)), ids, n, [[t.decode() for t in x] for x in terms], tfs]
            types = [pa.int64(), pa.int32(), of_id, pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["block", "slot", "doc_id", "n", "terms", "tfs"])

        for b in batches:
            of_id = b.column(0).type
            for doc, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                met = Counter(terms_of(x))
                if met:
                    kept = met.keys() if only is None else met.keys() & only
                    held.append((doc, met.total(), list(kept), [met[t] for t in kept]))
                    size += len(kept)
                    if len(held) == BLOCK or size >= POSTINGS:
                        yield flush()
                        held, size, blocks = [], 0, blocks + 1
        if held:
            yield flush()

    return own.mapInArrow(run, schema)


def bitmap(marks: np.ndarray) -> int:
    return int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")


def index(posted: DataFrame, weights: dict[str, int], documents: int, total: int) -> DataFrame:
    """Index rows block, term, slots and slices: the impact bitmaps, least significant first, over the term's documents.

    From posted, as postings() gives it, the terms' weights, the number of documents and that of all their terms. For each block a row with a null
    term holds the document ids of its slots.
    """
    shared = posted.sparkSession.sparkContext.broadcast(weights)
    bounded_batches(posted.sparkSession, rows=BLOCK)
    ids = posted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight_of = shared.value
        now, held, size = None, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            """The rows of what is held of one block."""
            slots, doc_ids = np.concatenate([x[0] for x in held]), pa.concat_arrays([x[1] for x in held])
            n = np.concatenate([x[2] for x in held])
            m = 50 + (50 * n * documents) // total
            of = np.repeat(np.arange(len(slots)), np.concatenate([x[3] for x in held]))
            terms = pa.concat_arrays([x[4] for x in held]).dictionary_encode()
            tf = np.concatenate([x[5] for x in held]).astype(np.int64)
            known = np.array([weight_of.get(t, 0) for t in terms.dictionary.to_pylist()], np.int64)
            which = terms.indices.to_numpy()
            impact = known[which] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[of]))
            keep = np.flatnonzero(impact)
            keep = keep[np.argsort(which[keep], kind="stable")]
            ends = np.r_[np.flatnonzero(np.diff(which[keep])) + 1, len(keep)] if len(keep) else []
            names, places, slices, start = [None], [slots.astype(np.uint16).tobytes()], [None], 0
            for end in ends:
                rows = keep[start:end]
                bits = int(impact[rows].max()).bit_length()
                marks = (impact[rows][None, :] >> np.arange(bits)[:, None]) & 1
                names.append(terms.dictionary[int(which[rows[0]])].as_py())
                places.append(slots[of[rows]].astype(np.uint16).tobytes())
                slices.append([x.tobytes() for x in np.packbits(marks.astype(np.uint8), axis=1, bitorder="little")])
                start = end
            id_lists = pa.ListArray.from_arrays(pa.array([0] + [len(doc_ids)] * len(names), pa.int32()), doc_ids)
            yield pa.RecordBatch.from_arrays([pa.array([now] * len(names), pa.int64()), pa.array(names, pa.string()), pa.array(places, pa.binary()), pa.array(slices, pa.list_(pa.binary())), id_lists], names=["block", "term", "slots", "slices", "ids"])

        for b in batches:
            blocks = b.column(0).to_numpy()
            starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(blocks) else []
            for s, e in zip(starts, [*starts[1:], len(blocks)], strict=True):
                if int(blocks[s]) != now or size >= 2 * POSTINGS:  # a part of a block has index rows of its own
                    if held:
                        yield from flush()
                    now, held, size = int(blocks[s]), [], 0
                x = b.slice(s, e - s)
                lists = x.column(4)
                counts = np.diff(lists.offsets.to_numpy())
                held.append((x.column(1).to_numpy(), x.column(2), x.column(3).to_numpy(), counts, lists.flatten(), x.column(5).flatten().to_numpy()))
                size += int(counts.sum())
        if held:
            yield from flush()

    return posted.mapInArrow(run, f"block long, term string, slots binary, slices array<binary>, ids array<{ids}>")


def add(total: list[int], more: list[int]) -> list[int]:
    """Bitmaps of the sums of two numbers a document, both least significant first, by a ripple of carries."""
    made, carry = [], 0
    for i in range(max(len(total), len(more))):
        a, b = total[i] if i < len(total) else 0, more[i] if i < len(more) else 0
        either = a ^ b
        made.append(either ^ carry)
        carry = (a & b) | (either & carry)
    return made + [carry] if carry else made


def best(total: list[int], k: int) -> int:
    """The bitmap of the k documents of the greatest sums above 0 (all, if fewer); of equal ones those in the lowest slots."""
    taken, open_ = 0, 0
    for x in total:
        open_ |= x
    for x in reversed(total):
        both = taken | (open_ & x)
        if both.bit_count() > k:
            open_ &= x
        else:
            taken, open_ = both, open_ & ~x
    for _ in range(k - taken.bit_count()):
        if not open_:
            break
        low = open_ & -open_
        taken, open_ = taken | low, open_ ^ low
    return taken


def slots_in(marks: int) -> list[int]:
    found = []
    while marks:
        low = marks & -marks
        found.append(low.bit_length() - 1)
        marks ^= low
    return found


def search(indexed: DataFrame, queries: list[tuple[object, list[str]]], k: int, of_item: str) -> DataFrame:
    """item_id, doc_id and score of the k best documents of each task for each of queries, from the rows of index()."""
    shared = indexed.sparkSession.sparkContext.broadcast(queries)
    bounded_batches(indexed.sparkSession, rows=1024)
    ids = indexed.schema["ids"].dataType.elementType.simpleString()
    placed = indexed.repartition("block").sortWithinPartitions("block")
    order = lambda x: (-x[0], x[1] is not None, x[1])

    def spread(slots: np.ndarray, slices: list[bytes], width: int) -> list[int]:
        """The bitmaps of a term over the whole block."""
        packed = np.frombuffer(b"".join(slices), np.uint8).reshape(len(slices), -1)
        marks = np.zeros((len(slices), width), np.uint8)
        marks[:, slots] = np.unpackbits(packed, axis=1, count=len(slots), bitorder="little")
        return [bitmap(x) for x in marks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, now = shared.value, None
        found: list[list[tuple[int, object]]] = [[] for _ in asked]
        known: dict[str, list[tuple[np.ndarray, list[bytes]]]] = {}
        docs: dict[int, object] = {}
        of_doc = None

        def score() -> None:
            ready: dict[str, list[int]] = {}
            width = max(docs, default=0) + 1
            for i, (_, terms) in enumerate(asked):
                total: list[int] = []
                for t in terms:
                    if t in known:
                        if t not in ready:
                            if len(ready) >= 256:  # bounds what is spread at a time
                                ready.clear()
                            ready[t] = []
                            for part in known[t]:
                                ready[t] = add(ready[t], spread(*part, width))
                        total = add(total, ready[t])
                for slot in slots_in(best(total, k)):
                    found[i].append((sum((x >> slot & 1) << bit for bit, x in enumerate(total)), docs[slot]))
                if len(found[i]) > 8 * k:
                    found[i] = heapq.nsmallest(k, found[i], key=order)

        for b in batches:
            of_doc = b.column(4).type.value_type
            for block, term, slots, slices, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block != now:
                    score()
                    now = block
                    known.clear()
                    docs.clear()
                places = np.frombuffer(slots, np.uint16)
                if term is None:
                    docs.update(zip(places.tolist(), own, strict=True))
                else:
                    known.setdefault(term, []).append((places, slices))
        score()
        rows = [(q, doc, s) for (q, _), x in zip(asked, found, strict=True) for s, doc in heapq.nsmallest(k, x, key=order)]
        if rows:
            q, doc, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(doc, of_doc), pa.array(s, pa.int64())], names=["item_id", "doc_id", "score"])

    return placed.mapInArrow(run, f"item_id {of_item}, doc_id {ids}, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents for each item."""
    asked = cut(queries_of(items, item_id, text), "search-terms")
    of_item = asked.schema["item_id"].dataType.simpleString()
    terms = cut(asked.select("term").distinct(), "search-vocabulary")
    posted = cut(postings(docs, doc_id, text, terms if terms.count() <= SLICE else None), "search-postings")
    size = posted.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("terms")).first()
    met = posted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarity = F.floor(1000 * F.log(F.lit(2.0 * size["n"] + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = cut(met.join(terms, "term").select("term", rarity.alias("weight")).where("weight > 0"), "search-weights")
    slices = max(1, asked.count() // SLICE)
    found = None
    for i in range(slices):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == i).join(weights, "term")
        rows = own.groupBy("item_id").agg(F.sort_array(F.collect_set(F.struct("term", "weight"))).alias("terms")).orderBy("item_id").collect()
        if not rows:
            continue
        of = {t["term"]: t["weight"] for r in rows for t in r["terms"]}
        built = cut(index(posted, of, size["n"], size["terms"]), "search-index")
        part = search(built, [(r["item_id"], [t["term"] for t in r["terms"]]) for r in rows], k, of_item)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = posted.select(F.lit(None).cast(of_item).alias("item_id"), "doc_id", F.lit(0).cast("long").alias("score")).limit(0)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = rf"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark),
l AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM l),
p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term),
r AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY term, docs),
m AS (SELECT doc_id, 50 + (50 * n * docs) // total AS m FROM l, s),
f AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN r USING (term) JOIN m USING (doc_id) GROUP BY ALL),
t AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM f WHERE score > 0)
SELECT * FROM t WHERE rank <= {TOP}
"""
