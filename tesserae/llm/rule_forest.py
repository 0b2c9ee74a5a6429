"""Quality rules by an isolation forest on rule statistics.

Each text is measured once, whole, by the statistics that quality rules look at. Two hard rules fail a
document by themselves (too few words, too many repeated ones). What passes them is judged by an
isolation forest: trees of random splits, in which a document that few others resemble is alone after
few of them. Its score is 2 ** (-mean path length / expected path length), as usual; it is dropped above a
threshold that is calibrated on labelled rows.

The forest is fitted on all labelled rows that pass the rules: as the method has it, each tree is grown on
SAMPLE rows of its own, drawn from all of them. All labelled rows calibrate the threshold, each scored only by
trees that haven't seen it. The statistics are written once, a short row a document; labelled rows are numbered and
scored in their partitions, and only the rows drawn for the trees (TREES * SAMPLE at most) are gathered. The trees
(some hundred kB) are broadcast, and every document is scored where it lies, without a shuffle. The forest splits by few statistics: each one in which junk and good documents are
alike costs it precision, so repeated lines and windows, capitals and digits were left to the rules.

The threshold is that of the labelled scores where bad rows dropped less COST times the good rows
dropped, as shares, is greatest; between two scores it is their middle.

Defined results: a null or empty text has no words and fails the rules; labels that are null or not 0 or
1 or whose document isn't there aren't used; of several labels of one document the worst counts; rows of
one id are documents each, and each is judged by its own text; without usable labels of both kinds
nothing is dropped but by the rules; a score at the threshold is kept; documents of equal texts have
equal rows but for their ids; an empty table gives no rows; further columns go, whatever their names;
labelled rows are numbered by a hash of the id, then by the id and the statistics.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, picked, table

SYMBOLS = b"#*$%&|<>"
FEWEST_WORDS, MOST_REPEATED = 20, 30  #: the rules: words, and percent of words in repeated windows
WINDOW = 8
TREES, SAMPLE, SEED = 200, 256, 12
COST = 5  #: a share of good documents dropped weighs as much as so many times that share of bad ones
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: per word, so that long and short documents are alike: what the forest splits by
SHARES = ("word_length", "symbols", "stutters", "marks", "stops", "distinct")
_MARKS, _STOPS, _BLANKS = b"!?", b".,;:", bytes([32, *range(9, 14)])


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows of so many (a power of two) words that are found twice or more.

    Windows are told apart exactly: words are numbered, then pairs of neighbours, then pairs of these.
    """
    if len(words) <= window:
        return 0
    known: dict[bytes, int] = {}
    at = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    step = 1
    while step < window:
        at = np.unique((at[:-step] << 32) | at[step:], return_inverse=True)[1]
        step *= 2
    starts = np.flatnonzero(np.bincount(at)[at] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def statistics(text: str | None) -> tuple[float, ...]:
    """COUNTS and SHARES of a whole text."""
    raw = (text or "").encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    without = lambda marks: len(raw) - len(raw.translate(None, marks))
    n, chars = len(words), len(text or "") - without(_BLANKS)
    symbols, dup = without(SYMBOLS), len(lines) - len(set(lines))
    again = sum(map(bytes.__eq__, words, words[1:]))
    distinct = len(set(words)) / max(1, n) ** 0.8  # distinct words grow more slowly in number than words
    return n, chars, symbols, dup, repeated(words), *(x / max(1, n) for x in (chars, symbols, again, without(_MARKS), without(_STOPS))), distinct


def measured(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, COUNTS and SHARES of each document."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*map(statistics, b.column(1).to_pylist()), strict=True)) or [()] * len(COUNTS + SHARES)
            made = [pa.array(x, pa.int64() if i < len(COUNTS) else pa.float64()) for i, x in enumerate(found)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["doc_id", *COUNTS, *SHARES])

    own = picked(docs, id, text).toDF("doc_id", "text")
    columns = [f"{c} long" for c in COUNTS] + [f"{c} double" for c in SHARES]
    return own.mapInArrow(run, ", ".join([f"doc_id {own.schema['doc_id'].dataType.simpleString()}", *columns]))


def failed() -> Column:
    """Whether the rules alone fail a document."""
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def expected(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees as flat arrays: for each node its statistic, split and left child (the right one is next), or its path length.

    rows are the fitted rows, or a function that gives, of n rows in all, those of the numbers it is called with, in that order.
    """

    def __init__(self, rows: np.ndarray | Callable[[np.ndarray], np.ndarray], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED, n: int | None = None) -> None:
        rng = np.random.default_rng(seed)
        n = len(rows) if n is None else n
        self.seen = [rng.choice(n, min(sample, n), replace=False) for _ in range(trees)]
        self.depth = max(1, int(np.ceil(np.log2(max(2, min(sample, n))))))
        self.norm = float(expected(min(sample, n))) or 1.0
        drawn, at = np.unique(np.concatenate(self.seen), return_inverse=True)
        own = rows(drawn) if callable(rows) else rows[drawn]
        self.trees = [self._grown(own[s], rng) for s in np.split(at, trees)]

    def _grown(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        by, split, left, path = [0], [np.inf], [0], [0.0]
        todo = [(0, rows, 0)]
        while todo:
            at, own, depth = todo.pop()
            low, high = (own.min(axis=0), own.max(axis=0)) if len(own) else (0, 0)
            varied = np.flatnonzero(np.atleast_1d(high > low))
            if depth >= self.depth or len(own) < 2 or not len(varied):
                left[at], path[at] = at, depth + float(expected(len(own)))
                continue
            by[at] = int(rng.choice(varied))
            split[at] = float(rng.uniform(low[by[at]], high[by[at]]))
            left[at] = len(by)
            for side in (own[own[:, by[at]] <= split[at]], own[own[:, by[at]] > split[at]]):
                todo.append((len(by), side, depth + 1))
                by, split, left, path = by + [0], split + [np.inf], left + [0], path + [0.0]
        return np.array(by), np.array(split), np.array(left), np.array(path)

    def paths(self, rows: np.ndarray) -> np.ndarray:
        """Path length of each row in each tree."""
        found, all_rows = np.empty((len(rows), len(self.trees))), np.arange(len(rows))
        for k, (by, split, left, path) in enumerate(self.trees):
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                at = left[at] + (rows[all_rows, by[at]] > split[at])  # a leaf is its own left child and splits at infinity
            found[:, k] = path[at]
        return found

    def scores(self, rows: np.ndarray, fitted: np.ndarray | None = None) -> np.ndarray:
        """Anomaly of each row, from 0 to 1; fitted[i] is row i's place among the fitted rows (or -1): trees that hold it don't judge it."""
        paths = self.paths(rows)
        if fitted is None:
            return 2 ** (-paths.mean(axis=1) / self.norm)
        unseen = np.stack([~np.isin(fitted, s) for s in self.seen], axis=1)
        few = ~unseen.any(axis=1)
        unseen[few] = True
        return 2 ** (-(paths * unseen).sum(axis=1) / unseen.sum(axis=1) / self.norm)


def threshold(scores: np.ndarray, good: np.ndarray, cost: float = COST) -> float:
    """The score above which bad rows go and good ones don't, as the docstring of this module says."""
    order = np.argsort(-scores, kind="stable")
    scores, good = scores[order], good[order]
    gain = np.cumsum(~good) / max(1, (~good).sum()) - cost * np.cumsum(good) / max(1, good.sum())
    ends = np.flatnonzero(np.r_[scores[1:] != scores[:-1], True])  # equal scores go together
    best = ends[np.argmax(gain[ends])]
    if gain[best] <= 0:
        return float("inf")
    return float((scores[best] + scores[best + 1]) / 2) if best + 1 < len(scores) else float("-inf")


def rows_before(rows: DataFrame, n: str, *order: Column) -> DataFrame:
    """rows, written by range of this order, with `_before`, the sum of n over the rows before; n 1 numbers them from 0."""
    placed = cut(rows.repartitionByRange(*order), "rules-ordered").withColumn("_file", F.col("_metadata.file_name"))
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_file").agg(F.sum(n).alias("_n")).select("_file", F.coalesce(F.sum("_n").over(until(Window.orderBy("_file"))), F.lit(0)).alias("_files"))  # a row a file
    within = F.coalesce(F.sum(n).over(until(Window.partitionBy("_file").orderBy(*order))), F.lit(0))
    return placed.withColumn("_within", within).join(F.broadcast(sums), "_file").withColumn("_before", F.col("_files") + F.col("_within")).drop("_file", "_files", "_within")


def threshold_of(scored: DataFrame, cost: float = COST) -> float:
    """threshold() of scored(score, good), by sums over ranges of scores: no task holds more than a range."""
    by_score = scored.groupBy((-F.col("score")).alias("_key")).agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    by_score = cut(by_score, "rules-scores")
    all_good, all_bad = (max(1, x or 0) for x in by_score.agg(F.sum("g"), F.sum("b")).first())
    goods = rows_before(by_score, "g", F.col("_key")).withColumn("_g", F.col("_before") + F.col("g")).drop("_before")
    both = rows_before(goods, "b", F.col("_key")).withColumn("_b", F.col("_before") + F.col("b"))
    gain = F.col("_b").cast("double") / F.lit(float(all_bad)) - F.lit(float(cost)) * F.col("_g") / F.lit(float(all_good))
    best = both.select("_key", gain.alias("gain")).agg(F.max_by(F.struct("_key", "gain"), F.struct("gain", (-F.col("_key")).alias("first"))).alias("x")).first()["x"]
    if best is None or best["gain"] <= 0:
        return float("inf")
    after = by_score.where(F.col("_key") > F.lit(best["_key"])).agg(F.min("_key")).first()[0]
    return (-best["_key"] - after) / 2 if after is not None else float("-inf")


def fit(stats: DataFrame, labels: DataFrame) -> tuple[Forest, float] | None:
    """A forest and its threshold from stats, as measured() gives them, and labels(doc_id, quality); None without good and bad rows."""
    marks = picked(labels, "doc_id", "quality").select("doc_id", F.col("quality").cast("int").alias("quality"))
    marks = marks.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rated = stats.where(~failed()).join(marks, "doc_id").select("doc_id", "quality", *SHARES, F.lit(1).alias("one"))
    rated = cut(rows_before(rated, "one", F.xxhash64("doc_id"), F.col("doc_id"), *map(F.col, SHARES)).select(F.col("_before").alias("place"), "quality", *SHARES), "rules-rated")
    n, good = rated.agg(F.count(F.lit(1)), F.count_if(F.col("quality") == 1)).first()
    if good in (0, n):
        return None

    def drawn(places: np.ndarray) -> np.ndarray:
        wanted = rated.sparkSession.createDataFrame([(int(p),) for p in places], "place long")
        found = sorted(map(tuple, rated.join(F.broadcast(wanted), "place").select("place", *SHARES).collect()))  # TREES * SAMPLE rows at most
        return np.array([r[1:] for r in found], np.float64)

    forest = Forest(drawn, n=n)
    shared = rated.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.column_stack([b.column(2 + i).to_numpy() for i in range(len(SHARES))])
            scores = shared.value.scores(rows, b.column(0).to_numpy()) if len(rows) else np.empty(0)
            yield pa.RecordBatch.from_arrays([pa.array(scores, pa.float64()), pa.array(b.column(1).to_numpy() == 1)], names=["score", "good"])

    return forest, threshold_of(rated.mapInArrow(run, "score double, good boolean"))


def judged(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, COUNTS, SHARES, base_failed, anomaly (0 to 1; null without a forest) and kept of each document."""
    spark = docs.sparkSession
    stats = cut(measured(docs, id, text), "rules-statistics")
    made = fit(stats, labels)
    flagged = stats.withColumn("base_failed", failed())
    if made is None:
        return flagged.withColumn("anomaly", F.lit(None).cast("double")).withColumn("kept", ~F.col("base_failed"))
    forest, limit = made
    shared = spark.sparkContext.broadcast(forest)
    first, names = 1 + len(COUNTS), [*flagged.columns, "anomaly"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.column_stack([b.column(first + i).to_numpy() for i in range(len(SHARES))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.scores(rows))], names=names)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    scored = flagged.mapInArrow(run, flagged.withColumn("anomaly", F.lit(0.0)).schema)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(limit)))


def op12_rule_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")
