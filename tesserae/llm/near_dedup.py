"""MinHash near-deduplication by fast similarity sketching.

A document's set is its distinct SHINGLE-word shingles, as 64-bit hashes. Its sketch has COORDINATES
coordinates: in round i every shingle is hashed into a bin and leaves i plus a fraction there if that
is less than what the bin holds; after COORDINATES rounds, further rounds throw all shingles into one
bin each, so every coordinate fills even for a set of one. Two sets agree in a coordinate with
probability equal to their Jaccard similarity. BANDS bands of ROWS coordinates make the buckets: a
pair at a threshold of 85 percent shares none with a probability of 2e-9, at 80 with 3e-6. Links are
confirmed on full sets.

1. Rows with equal sets are one class (grouped by 128 bits of hash, summed in the map tasks first);
   the class is known by its smallest doc_id. Copies are never expanded into pairs.
2. Each class is compared with two others only: the smallest and the largest members of its buckets
   that it meets most often. So pairs are in proportion to classes, however large the buckets.
   Sketches filter the pairs, whole texts confirm them, and components are found by alternating large
   and small stars.
3. Buckets that still hold several components are compared in full, in blocks of BLOCK members, so
   that no task holds more than two blocks. A block pair gives only the pairs of different components
   whose sizes and sketches allow a link, and each pair only in the first bucket it shares. A member
   goes only to the blocks of its own and the next size step (a step is the ratio of sizes that a link
   allows). Those pairs are confirmed, and components that they link are joined. No bucket is capped, and after this step no pair that shares a bucket is left out.

Texts are fetched only for the ends of pairs left by the sketches. Everything that is used twice is written to the shared
folder, so a lost executor costs one step.

Defined results: without words (or text) n_shingles is 0 and the row is linked with nothing; with
fewer words than a shingle has, all of them are one shingle; rows with equal ids are versions of one
document, so the classes of all its versions are of one component (but for a version without words); rows with a null doc_id are not linked except to copies with ids, and their
component is null if they have none; they are kept then; a similarity equal to the threshold links;
whole texts are read, however long; further columns go. An empty table gives no rows. Working columns
begin with `_nd_`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import bounded_batches, cut, discard, scratch, small, table

SHINGLE, THRESHOLD = 5, 85  #: percent
COORDINATES, BANDS, ROWS = 512, 42, 6
MARGIN = 0.075  #: of the sketches' estimate: over 4.7 standard deviations at THRESHOLD
BLOCK = 1024
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; arithmetic wraps."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS = np.cumprod(np.full(64, _ODD, _U))
_SALTS = _mixed(np.arange(1, 2 * COORDINATES + 1, dtype=_U) * _ODD)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles. Words are parted by ASCII white space and lower-cased A-Z."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, _U)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), _U, n)
    width = min(n, SHINGLE)
    total = np.full(n - width + 1, _U(width))
    for k in range(width):
        total += hashes[k : n - width + 1 + k] * _POWERS[k]
    return np.unique(_mixed(total))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """COORDINATES values: the round in the upper bits, hash bits below."""
    n = len(hashes)
    out = np.full(COORDINATES, np.iinfo(_U).max, _U)
    at, step = 0, max(1, min(COORDINATES, 8 * COORDINATES // n + 1))
    while at < COORDINATES:
        rounds = np.arange(at, min(at + step, COORDINATES))
        x = _mixed(hashes[None, :] ^ _SALTS[rounds][:, None])
        bins = (x >> _U(65 - COORDINATES.bit_length())).astype(np.intp)  # COORDINATES is a power of two
        np.minimum.at(out, bins.ravel(), ((x & _U((1 << 48) - 1)) | (rounds.astype(_U)[:, None] << _U(48))).ravel())
        at += len(rounds)
        if out.max() != np.iinfo(_U).max:
            return out
    for j in np.flatnonzero(out == np.iinfo(_U).max):
        out[j] = (_mixed(hashes ^ _SALTS[COORDINATES + j]).min() & _U((1 << 48) - 1)) | (_U(COORDINATES + j) << _U(48))
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    bands = coordinates[: BANDS * ROWS].reshape(BANDS, ROWS)
    return _mixed((_mixed(bands) * _POWERS[None, :ROWS]).sum(axis=1, dtype=_U) + np.arange(BANDS, dtype=_U) * _ODD).astype(np.int64)


def least_agreement(threshold: int) -> float:
    """Share of coordinates in which the sketches of a pair at the threshold agree at least: MARGIN, in standard deviations of that threshold, below it."""
    deviation = lambda t: (t * (100 - t)) ** 0.5
    return threshold / 100 - MARGIN * deviation(threshold) / deviation(THRESHOLD)


def linked(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (len(a) + len(b) - both)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set1, set2 (hashes of the whole set), bands and sketch (a byte a coordinate), from docs(doc_id, text)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sets1, sets2, bands, bytes_ = [], [], [], [], []
            with np.errstate(over="ignore"):
                for text in batch.column("text").to_pylist():
                    own = shingles(text)
                    sizes.append(len(own))
                    sets1.append(int(_mixed(own).sum(dtype=_U).astype(np.int64)))
                    sets2.append(int(_mixed(own ^ _ODD).sum(dtype=_U).astype(np.int64)))
                    values = sketch(own) if len(own) else None
                    bands.append(None if values is None else band_keys(values))
                    bytes_.append(None if values is None else (values & _U(255)).astype(np.uint8).tobytes())
            made = [pa.array(sizes, pa.int64()), pa.array(sets1, pa.int64()), pa.array(sets2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(bytes_, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *made], names=["doc_id", "n_shingles", "set1", "set2", "bands", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>, sketch binary")


def similar_enough(a: str, b: str, threshold: int = THRESHOLD) -> F.Column:
    """May sketches and sizes in columns `{a}_sketch`, `{a}_n` ... be those of a link?"""
    low, high = F.least(f"{a}_n", f"{b}_n"), F.greatest(f"{a}_n", f"{b}_n")
    return 100 * low >= threshold * high


def _pairs_by_sketch(pairs: DataFrame, classes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Those pairs(a, b) whose sizes and sketches allow a link."""
    own = lambda x: classes.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch"))
    both = pairs.join(own("a"), "a").join(own("b"), "b").where(similar_enough("a", "b", threshold))
    least = least_agreement(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(f"{c}_sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in "ab")
                near = (x == y).mean(axis=1) >= least
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(near)), batch.column("b").filter(pa.array(near))], names=["a", "b"])

    return both.select("a", "b", "a_sketch", "b_sketch").mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Those pairs(a, b) of doc_ids whose full sets are linked. Texts are fetched for these documents only.

    The end of a pair that is in more pairs is its hub. A hub's text goes once to each share of its
    pairs (BLOCK of them), not once to each pair, so a hub of millions costs as many small tasks.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    counts = cut(ends.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "near-ids")
    texts = cut(docs.select(F.col("doc_id").alias("id"), "text").join(small(counts.select("id")), "id"), "near-texts")
    of = lambda x: small(counts).select(F.col("id").alias(x), F.col("n").alias(f"{x}_n"))
    both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    first = F.col("a_n") >= F.col("b_n")
    hub, spoke = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    share = F.pmod(F.xxhash64(spoke), F.ceil(F.greatest("a_n", "b_n") / BLOCK)).cast("int")
    turned = cut(both.select(hub.alias("hub"), spoke.alias("spoke"), share.alias("share")), "near-shares")
    hubs = texts.join(turned.select("hub", "share").distinct(), F.col("id") == F.col("hub")).select("hub", "share", F.lit(None).cast("long").alias("spoke"), "text")
    spokes = texts.join(turned, F.col("id") == F.col("spoke")).select("hub", "share", "spoke", "text")
    rows = hubs.unionByName(spokes).repartition("hub", "share").sortWithinPartitions("hub", "share", F.asc_nulls_first("spoke"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A hub's own rows (versions of one id) come before those of its spokes."""
        now, own = None, []
        for batch in batches:
            a, b = [], []
            with np.errstate(over="ignore"):
                for *key, spoke, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if key != now:
                        now, own = key, []
                    if spoke is None:
                        own.append(shingles(text))
                    elif any(linked(x, other, threshold) for other in [shingles(text)] for x in own):
                        a.append(min(key[0], spoke))
                        b.append(max(key[0], spoke))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.mapInArrow(run, "a long, b long")  # twice where an id's versions are linked twice


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every id in links(a, b), by alternating stars.

    A large star joins each id's larger neighbours to the smallest id next to it, a small star the
    smaller ones; when nothing but stars is left, each around the smallest id of its component, this ends.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star-edges")
    while True:
        both = edges.union(edges.select("v", "u"))
        first = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(first, F.col("u") == F.col("w")).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "star-large")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"), "star-least")
        joined = large.join(least, F.col("u") == F.col("w"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.toDF("u", "v"))
        last, edges = edges, cut(small.distinct(), "star-small")
        discard(last, large, least)
        ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
        seen = ends.groupBy("id").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
        if seen.where("up > 1 or up = 1 and least = 0").isEmpty():  # no id has two smaller neighbours, or a smaller and a larger one
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _block_pairs(members: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """a and b of pairs of members(key, rep, component, n, sketch, bands) that share a bucket, are of different components and may be linked.

    A pair comes from the bucket of the first band in which it agrees. All buckets of such a pair are
    here, since each holds two components.
    """
    spark = members.sparkSession
    bounded_batches(spark, rows=4096)
    least = least_agreement(threshold)
    # sizes of a link lie in one step or in two next to each other: the smaller one is copied to the step above
    step = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / threshold) * (1 + 1e-9))).cast("int")
    members = members.withColumn("own", step).withColumn("step", F.explode(F.array("own", F.col("own") + 1)))
    counts = members.groupBy("key", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.min("component").alias("least"), F.max("component").alias("most"), F.max("own").alias("top"))
    counts = counts.where("least < most and top = step").select("key", "step", "blocks")  # else no pair of this step has two components
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = members.join(cut(counts, "near-blocks"), ["key", "step"]).withColumn("block", block)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    placed = placed.select("key", "step", low.alias("i"), high.alias("j"), "block", "own", "rep", "component", "n", "sketch", "bands")
    placed = placed.repartition("key", "step", "i", "j").sortWithinPartitions("key", "step", "i", "j")

    def compared(group: pa.Table, key: int, step: int, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        rep, comp, n, block, own = (group.column(c).to_numpy() for c in ("rep", "component", "n", "block", "own"))
        marks = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        bands = np.concatenate([c.flatten().to_numpy() for c in group.column("bands").chunks]).reshape(-1, BANDS)
        firsts, seconds = [], []
        inside = np.flatnonzero(block == i) if i != j else np.arange(len(rep))
        others = np.flatnonzero(block == j) if i != j else inside
        for x in inside:
            may = others[(comp[others] != comp[x]) & (np.maximum(own[others], own[x]) == step) & (100 * np.minimum(n[others], n[x]) >= threshold * np.maximum(n[others], n[x]))]
            may = may[rep[may] > rep[x]] if i == j else may
            if len(may):
                may = may[(marks[may] == marks[x]).mean(axis=1) >= least]
                may = may[bands[x][(bands[may] == bands[x]).argmax(axis=1)] == key]
                firsts.append(np.minimum(rep[may], rep[x]))
                seconds.append(np.maximum(rep[may], rep[x]))
        none = np.empty(0, np.int64)
        return np.concatenate([none, *firsts]), np.concatenate([none, *seconds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: one block pair after the other, each at most two blocks and a little."""
        held: list[pa.RecordBatch] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                a, b = compared(pa.Table.from_batches(held), *now)
                held.clear()
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "step", "i", "j")], axis=1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else []
            for s, e in zip(starts, [*starts[1:], len(keys)], strict=True):
                if tuple(keys[s]) != now:
                    yield from flush()
                    now = tuple(int(k) for k in keys[s])
                held.append(batch.slice(s, e - s))
        yield from flush()

    return placed.mapInArrow(run, "a long, b long").distinct()


def _most_shared(members: DataFrame, to: tuple[str, ...]) -> DataFrame:
    """Each rep with that member of its buckets, of each kind in `to`, that it meets in most of them; a rep has at most BANDS rows."""
    met = members.groupBy("rep").agg(*(F.mode(c, True).alias(c) for c in to))
    return met.select("rep", F.explode(F.array(*to)).alias("to"))


def _between_versions(rows: DataFrame, named: DataFrame) -> DataFrame | None:
    """Links a and b between the classes of each id whose rows(doc_id, set1, ...) differ; None if no id has such rows."""
    sets = ["set1", "set2", "n_shingles"]
    versions = rows.where("n_shingles > 0 and doc_id is not null").select("doc_id", *sets)
    several = cut(versions.groupBy("doc_id").agg(F.min(F.struct(*sets)).alias("a"), F.max(F.struct(*sets)).alias("b")).where("a <> b").select("doc_id"), "near-versions")
    if several.isEmpty():
        return None
    own = versions.join(small(several), "doc_id", "left_semi").distinct().join(named, sets)
    least = cut(own.groupBy("doc_id").agg(F.min("rep").alias("a")), "near-least")
    return own.join(small(least), "doc_id").where("a < rep").select("a", F.col("rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs(doc_id, text); pairs are linked from a similarity of threshold percent on."""
    with scratch() as kept:
        return _near_duplicates(docs, threshold, kept)


def _near_duplicates(docs: DataFrame, threshold: int, kept: list[DataFrame]) -> DataFrame:
    rows = cut(sketched(docs), "near-sketches")
    sets = ["set1", "set2", "n_shingles"]
    named = cut(rows.where("n_shingles > 0").groupBy(*sets).agg(F.min("doc_id").alias("rep")), "near-classes")
    # a class is represented by the rows of its smallest id
    reps = named.where("rep is not null").select(*(F.col(c).alias(f"_nd_{c}") for c in sets), "rep")
    same = [F.col(c) == F.col(f"_nd_{c}") for c in sets]
    classes = rows.join(reps, [F.col("doc_id") == F.col("rep"), *same]).select("rep", "n_shingles", "sketch", "bands")

    entries = classes.select("rep", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    members = cut(entries.join(cut(buckets, "near-buckets"), "key"), "near-members")
    classes = cut(classes.join(members.select("rep"), "rep", "left_semi"), "near-represented")

    pairs = _most_shared(members, ("low", "high"))
    pairs = pairs.where("rep <> to").select(F.least("rep", "to").alias("a"), F.greatest("rep", "to").alias("b")).distinct()
    stars = cut(confirmed(cut(_pairs_by_sketch(pairs, classes, threshold), "near-stars"), docs, threshold), "near-links")
    versions = _between_versions(rows, named)
    stars = stars if versions is None else stars.unionByName(versions)
    found = cut(components(stars), "near-components")

    placed = members.join(found, F.col("rep") == F.col("id"), "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    open_ = placed.groupBy("key").agg(F.min("component").alias("first"), F.max("component").alias("last")).where("first < last")
    rest = cut(placed.join(cut(open_.select("key"), "near-open"), "key"), "near-rest")
    rest = rest.join(classes.select("rep", F.col("n_shingles").alias("n"), "sketch", "bands"), "rep")
    more = cut(confirmed(cut(_block_pairs(rest, threshold), "near-pairs"), docs, threshold), "near-more")

    named = named.join(found, F.col("rep") == F.col("id"), "left").select(*(F.col(c).alias(f"_nd_{c}") for c in sets), F.coalesce("component", "rep").alias("component"))
    if not more.isEmpty():  # these link components, which are joined as wholes
        of = lambda x: found.select(F.col("id").alias(x), F.col("component").alias(f"{x}_of"))
        between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b"))
        joined = cut(components(between).toDF("id", "whole"), "near-joined")
        named = named.join(small(joined), F.col("component") == F.col("id"), "left").withColumn("component", F.coalesce("whole", "component")).drop("id", "whole")
    named = cut(named, "near-named")
    kept += [rows, named]
    joined = rows.select("doc_id", *sets).join(named, same, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("component_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id")))


def op4_fast_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
