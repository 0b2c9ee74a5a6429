"""A quality classifier by ordinal cumulative-link regression on graded ratings.

The grade of a rated document is its quality label plus one if it is not toxic: 0, 1 or 2. One
vector of hashed-text weights w is shared by all grades, with ordered thresholds t1 < t2:
P(grade >= k) = sigmoid(w.x - tk). The model is fitted by a quasi-Newton descent: each step is a Spark
job in which tasks sum gradients over their rows and the driver adds up one vector per task. At
most `MAX_RATED` rated rows are used (the lowest by a hash of doc_id): the size of the fit does not
grow with the corpus. The weights (2**17 floats) are broadcast and every document is scored where
it lies, on its whole text.

Defined results: null and empty texts have only the features of an empty text and are scored like
any other; ratings with a null or without a document are not used; with no usable ratings every
document has the same score and is kept, with any the score decides (of very few, by the grades' shares alone); of several ratings of one document the worst counts;
ties at the bound of the sample are broken by doc_id; a document at the threshold itself is kept;
repeated rows stay repeated; whole texts are read, however long; an empty table gives no rows;
further columns pass through unless a result column has their name in any case.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from .common import bounded_batches, cut, lowest, map_batches, table

BITS = 17
GRADES = 3
MAX_RATED = 20_000  #: the bound of the sample of rated rows
STEPS, RIDGE, PARTS, MEMORY, LEAST_ROWS = 30, 1e-3, 12, 8, 10
#: LEAST_ROWS: features that fewer rated rows have get no weight, so that none is learnt from a handful of documents
KEEP_AT = 0.5  #: a document is kept if P(grade >= 2) is at least this
_PUNCTUATION = [bytes([b]) for b in b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"]
_EDGES = bytes(b for b in range(128) if not chr(b).isalnum())


def features(text: str | None) -> np.ndarray:
    """Distinct hashed features of a whole text: its words, their beginnings, and how
    it is written (marks, case, variety)."""
    raw = (text or "").encode()
    words = raw.split()
    distinct = {w.strip(_EDGES) for w in set(raw.lower().split())}
    length, n = max(1, len(raw)), max(1, len(words))
    level = lambda share: round(3 * math.log2(1 + 255 * share))
    shares = [raw.count(p) / n for p in _PUNCTUATION]
    shares += [sum(map(bytes.isupper, words)) / n, len(set(words)) / n, len(words) / length, raw.count(b"\n") / n]
    style = [b"%d:%d" % (i, level(min(1.0, x))) for i, x in enumerate(shares)]
    mask = (1 << BITS) - 1
    stems = {w[:4] for w in distinct if len(w) > 4}
    at = [xxh3_64_intdigest(w) & mask for w in distinct]
    at += [xxh3_64_intdigest(s, 1) & mask for s in style] + [xxh3_64_intdigest(s, 2) & mask for s in stems]
    return np.unique(np.array(at, np.int32))


def tails(margin: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k from 1, one column each."""
    return 1 / (1 + np.exp(np.clip(thresholds[None, :] - margin[:, None], -40, 40)))


def gradient(rows: list[np.ndarray], grades: np.ndarray, weights: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Summed gradient of the negative log likelihood over rows, and its value."""
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    of = np.repeat(np.arange(len(rows)), sizes)
    margin = np.bincount(of, weights[flat], len(rows))
    upper = np.hstack([np.ones((len(rows), 1)), tails(margin, thresholds), np.zeros((len(rows), 1))])
    i = np.arange(len(rows))
    p = np.maximum(upper[i, grades] - upper[i, grades + 1], 1e-12)
    slope = upper * (1 - upper)  # of each tail by the margin
    by_margin = -(slope[i, grades] - slope[i, grades + 1]) / p
    by_threshold = np.zeros(len(thresholds))
    for k in range(len(thresholds)):
        by_threshold[k] = np.sum((slope[:, k + 1] / p)[grades == k + 1]) - np.sum((slope[:, k + 1] / p)[grades == k])
    return np.bincount(flat, np.repeat(by_margin, sizes), len(weights)), by_threshold, float(-np.log(p).sum())


def minimise(value_and_gradient: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int) -> np.ndarray:
    """A limited-memory quasi-Newton descent with backtracking."""
    value, slope = value_and_gradient(x)
    pairs: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=MEMORY)
    for _ in range(steps):
        way, shares = -slope, []
        for moved, turned in reversed(pairs):
            shares.append(moved @ way / (turned @ moved))
            way = way - shares[-1] * turned
        way = way * (pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.abs(slope).sum()))
        for (moved, turned), share in zip(pairs, reversed(shares), strict=True):
            way = way + moved * (share - turned @ way / (turned @ moved))
        length = 1.0
        while True:
            next_value, next_slope = value_and_gradient(x + length * way)
            if next_value <= value + 1e-4 * length * (slope @ way):
                break
            length *= 0.4
            if length < 1e-4:
                return x
        moved, turned = length * way, next_slope - slope
        if moved @ turned > 1e-12:
            pairs.append((moved, turned))
        x, value, slope = x + moved, next_value, next_slope
        if np.abs(slope).max() < 1e-6:
            break
    return x


def thresholds_of(x: np.ndarray) -> np.ndarray:
    """The first threshold and the logarithms of the gaps to the next stand at the end of x."""
    return x[-(GRADES - 1)] + np.concatenate([[0.0], np.cumsum(np.exp(x[len(x) - GRADES + 2 :]))])


def fit(rated: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Weights, thresholds and the number of rows from rated(text, grade)."""
    spark = rated.sparkSession
    bounded_batches(spark)
    size = 1 << BITS

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([features(x) for x in b.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([found, b.column("grade")], names=["at", "grade"])

    rows = cut(rated.repartition(PARTS).mapInArrow(hashed, "at array<int>, grade int"), "quality-features")

    def summed(of: Callable[[list[np.ndarray], np.ndarray], tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray, float]:
        """Sums over all rows: one sparse vector, one short vector and one number from each task."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, short, value = np.zeros(size), np.zeros(GRADES - 1), 0.0
            for b in batches:
                lists, offsets = b.column("at"), b.column("at").offsets.to_numpy()
                flat = lists.values.to_numpy(zero_copy_only=False)
                if b.num_rows:
                    more = of([flat[x:y] for x, y in zip(offsets, offsets[1:], strict=False)], b.column("grade").to_numpy(zero_copy_only=False))
                    total, short, value = total + more[0], short + more[1], value + more[2]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"at": pa.array([some.astype(np.int32)], pa.list_(pa.int32())), "g": pa.array([total[some]], pa.list_(pa.float64())), "t": pa.array([short], pa.list_(pa.float64())), "v": pa.array([value])})

        total, short, value = np.zeros(size), np.zeros(GRADES - 1), 0.0
        for at, g, t, v in rows.mapInArrow(run, "at array<int>, g array<double>, t array<double>, v double").collect():
            total[np.array(at, np.int64)] += g
            short += t
            value += v
        return total, short, value

    met, _, n = summed(lambda own, grades: (np.bincount(np.concatenate(own), minlength=size), np.zeros(GRADES - 1), float(len(own))))
    x = np.zeros(size + GRADES - 1)
    x[size] = -1.0
    if not n:
        return x[:size], thresholds_of(x), 0
    used = met >= LEAST_ROWS

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, t = x[:size], thresholds_of(x)
        shared = spark.sparkContext.broadcast((w, t))
        g, gt, v = summed(lambda own, grades: gradient(own, grades, *shared.value))
        shared.destroy()
        gaps = np.diff(t, prepend=t[0] - 1)
        return v / n + RIDGE / 2 * float(w @ w), np.concatenate([np.where(used, g / n + RIDGE * w, 0), np.cumsum(gt[::-1])[::-1] * gaps / n])

    x = minimise(loss, x, STEPS)
    return x[:size], thresholds_of(x), int(n)


def rated_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_RATED) -> DataFrame:
    """text and grade of at most `most` rated documents, the lowest by a hash of doc_id; of rows of one id the least text."""
    marks = (
        labels.select("doc_id", F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("x"))
        .where("doc_id is not null and q in (0, 1) and x in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("q").alias("q"), F.max("x").alias("x"))
    )
    marks = cut(marks.select("doc_id", (F.col("q") + 1 - F.col("x")).cast("int").alias("grade")), "quality-marks")
    marks = cut(lowest(marks, most, "doc_id"), "quality-ratings")
    return docs.select("doc_id", "text").join(marks, "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("text", "grade")


def score(docs: DataFrame, weights: np.ndarray, thresholds: np.ndarray, prefix: str = "") -> DataFrame:
    """Add `expected_grade`, `p_ge1` and `p_ge2`, their names begun with prefix, to docs, from the column `text`."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), thresholds))
    names = [prefix + x for x in ("expected_grade", "p_ge1", "p_ge2")]
    schema = T.StructType([f for f in docs.schema.fields if f.name.lower() not in names] + [T.StructField(x, T.DoubleType()) for x in names])

    passed, at = [docs.columns.index(f.name) for f in schema.fields[:-3]], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t = shared.value
        for b in batches:
            margin = np.array([w[features(x)].sum(dtype=np.float64) for x in b.column(at).to_pylist()])
            tail = tails(margin, t)
            made = [tail.sum(axis=1), tail[:, 0], tail[:, 1]]
            yield pa.RecordBatch.from_arrays([*map(b.column, passed), *map(pa.array, made)], names=schema.names)

    return map_batches(docs, run, schema)


def classify(docs: DataFrame, labels: DataFrame, prefix: str = "") -> DataFrame:
    """docs with expected_grade, p_ge1, p_ge2 and `keep`; prefix begins these names, so that docs may have columns of the bare ones."""
    weights, thresholds, n = fit(rated_rows(docs, labels))
    return score(docs, weights, thresholds, prefix).withColumn(f"{prefix}keep", F.col(f"{prefix}p_ge2") >= KEEP_AT if n else F.lit(True))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).drop("text")
