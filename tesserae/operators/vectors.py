"""Filtered cosine search and the retrieval strategies over a table of vectors.

Vectors are rows (id, vector array<float>, chunk_source, ticker, section_id, accession_number, ...).
Filters and column pruning reach the scan; the score is one expression; top-k is a limit that each
task applies to its own rows before anything moves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine of a vector column with one query, in double precision, rounded to 6 places."""
    q = F.array(*(F.lit(float(x)) for x in query))
    norm = math.sqrt(sum(float(x) ** 2 for x in query))
    return F.round(dot(vector, q) / (F.sqrt(dot(vector, vector)) * F.lit(norm)), 6)


def search(vectors: DataFrame, query: Sequence[float], limit: int, ticker: str | None = None, section: str | None = None, accessions: Sequence[str] | None = None, source: str | None = None) -> DataFrame:
    """The `limit` best vectors under filters; an empty list of accessions finds nothing."""
    if ticker is not None:
        vectors = vectors.where(F.col("ticker") == ticker.upper())
    if section is not None:
        vectors = vectors.where(F.col("section_id") == section.upper())
    if accessions is not None:
        vectors = vectors.where(F.col("accession_number").isin(*accessions) if accessions else F.lit(False))
    if source is not None:
        vectors = vectors.where(F.col("chunk_source") == source)
    return vectors.withColumn("score", cosine(F.col("vector"), query)).orderBy(F.desc("score"), F.asc("id")).limit(limit)


def count_points(vectors: DataFrame, *by: str, **equal: object) -> DataFrame:
    """points, the number of vectors with these values, for each value of the columns `by`; 0 in all where there are none."""
    for name, value in equal.items():
        vectors = vectors.where(F.col(name) == value)
    return vectors.groupBy(*by).agg(F.count(F.lit(1)).alias("points"))


def vector_ids(vectors: DataFrame, accession: str | None = None, document_id: int | None = None) -> DataFrame:
    """Ids of the vectors of one filing or one document."""
    own = F.col("accession_number") == accession if accession is not None else F.col("document_id") == document_id
    return vectors.where((F.col("chunk_source") == ("sec_filing" if accession is not None else "document")) & own).select("id")


def _rank(*by: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("id")))


def _scored(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    return vectors.withColumn("score", cosine(F.col("vector"), query)).drop("vector")


def dedupe(hits: DataFrame) -> DataFrame:
    """One row of each (chunk_source, id), the best; sorted by score."""
    return hits.withColumn("_rank", _rank("chunk_source", "id")).where("_rank = 1").drop("_rank")


def retrieve(vectors: DataFrame, query: Sequence[float], limit: int, tickers: Sequence[str] = (), sections: Sequence[str] = (), accessions: Sequence[str] | None = None, intent: str = "summary", time_scope: str = "latest", by_ticker: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Hits for a plan: balanced by ticker for comparisons, by filing for trends and periods, else mixed."""
    if intent == "comparison" and len(tickers) > 1:
        return retrieve_comparison(vectors, query, limit, tickers, sections, accessions, by_ticker)
    if accessions and len(accessions) > 1 and (intent == "trend" or time_scope in ("all_available", "latest_and_previous")):
        return retrieve_period(vectors, query, limit, tickers, sections, accessions)
    return retrieve_mixed(vectors, query, limit, tickers, sections, accessions)


def _within(tickers: Sequence[str], sections: Sequence[str], accessions: Sequence[str] | None) -> Column:
    """What a plan takes: filings in its tickers, sections and accessions, documents in its tickers alone."""
    of = lambda c, xs: F.col(c).isin(*xs) if xs else F.lit(True)
    inside = of("ticker", tickers)
    filed = of("section_id", sections)
    if accessions is not None:
        filed = filed & (F.col("accession_number").isin(*accessions) if accessions else F.lit(False))
    return inside & ((F.col("chunk_source") == "document") | filed)


def _best(vectors: DataFrame, query: Sequence[float], within: Column) -> DataFrame:
    """Vectors within a plan's scope, each scored once; the filter reaches the scan."""
    return _scored(vectors.where(within), query)


def retrieve_mixed(vectors: DataFrame, query: Sequence[float], limit: int, tickers: Sequence[str], sections: Sequence[str], accessions: Sequence[str] | None) -> DataFrame:
    """The best chunks per ticker and section, and documents per ticker whatever their section; the best `limit` of all.

    A hit below rank `limit` in its own group can't be among the best of all, so one limit will do.
    """
    return _best(vectors, query, _within(tickers, sections, accessions)).orderBy(F.desc("score"), F.asc("id")).limit(limit)


def retrieve_period(vectors: DataFrame, query: Sequence[float], limit: int, tickers: Sequence[str], sections: Sequence[str], accessions: Sequence[str]) -> DataFrame:
    """Of each filing its share of the limit, and the best documents of each ticker; the total may exceed the limit."""
    share = max(1, math.ceil(limit / len(accessions)))
    web = F.col("chunk_source") == "document"
    group = F.when(web, F.col("ticker") if tickers else F.lit("")).otherwise(F.col("accession_number"))
    ranked = _best(vectors, query, _within(tickers, sections, accessions)).withColumn("_group", group).withColumn("_rank", _rank("chunk_source", "_group"))
    return ranked.where((web & (F.col("_rank") <= limit)) | (~web & (F.col("_rank") <= share))).drop("_group", "_rank").orderBy(F.desc("score"), F.asc("id"))


def retrieve_comparison(vectors: DataFrame, query: Sequence[float], limit: int, tickers: Sequence[str], sections: Sequence[str], accessions: Sequence[str] | None, by_ticker: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Of each ticker its share of the limit, filings and documents together; the total may exceed the limit."""
    share = max(1, math.ceil(limit / len(tickers)))
    within = _within(tickers, sections, accessions if by_ticker is None else None)
    if by_ticker is not None:
        inside = F.col("chunk_source") == "document"
        for t in tickers:
            own = by_ticker.get(t)
            inside = inside | ((F.col("ticker") == t) & (F.lit(True) if own is None else F.col("accession_number").isin(*own) if own else F.lit(False)))
        within = within & inside
    ranked = _best(vectors, query, within).withColumn("_rank", _rank("ticker"))
    return ranked.where(F.col("_rank") <= share).drop("_rank").orderBy(F.desc("score"), F.asc("id"))


CASES_A_BLOCK, ROWS_A_BATCH = 1024, 4096


def plan_of(case: dict) -> list[tuple[str, str, int]]:
    """How retrieve() would take a case's hits: (corpus or "", group, hits of each group); the group is a column or "" for all."""
    limit, accessions = case["limit"], case["accessions"]
    if case["intent"] == "comparison" and len(case["tickers"]) > 1:
        return [("", "ticker", max(1, math.ceil(limit / len(case["tickers"]))))]
    if accessions and len(accessions) > 1 and (case["intent"] == "trend" or case["time_scope"] in ("all_available", "latest_and_previous")):
        return [("sec_filing", "accession_number", max(1, math.ceil(limit / len(accessions)))), ("document", "ticker" if case["tickers"] else "", limit)]
    return [("", "", limit)]


def retrieve_many(vectors: DataFrame, cases: DataFrame, columns: Sequence[str] = ("id", "chunk_source", "ticker", "section_id", "accession_number")) -> DataFrame:
    """case, score and columns of the hits of every case, as retrieve() gives them for one.

    cases(case, query, limit, tickers, sections, accessions, intent, time_scope, by_ticker), the last a map of ticker to
    accessions or null, are taken in blocks of CASES_A_BLOCK, whose queries are sent to all tasks as one matrix. A task scores
    each batch of vectors against the whole block and hands on the best of each group of each case; these
    few rows are merged. So the index is scanned once a block, and what moves grows with cases and tasks, not with vectors.
    """
    n = max(1, -(-cases.count() // CASES_A_BLOCK))
    needed = list(dict.fromkeys([*columns, "id", "chunk_source", "ticker", "section_id", "accession_number"]))
    kind = cases.schema["case"].dataType.simpleString()
    whole = None
    for i in range(n):
        rows = [r.asDict(recursive=True) for r in cases.where(F.pmod(F.xxhash64("case"), F.lit(n)) == i).collect()]  # a block
        if rows:
            found = _block_hits(vectors.select(*needed, "vector"), rows, kind)
            whole = found if whole is None else whole.unionByName(found)
    if whole is None:
        return vectors.select(F.lit(None).cast(kind).alias("case"), F.lit(0.0).alias("score"), *columns).limit(0)
    best = F.row_number().over(Window.partitionBy("case", "_rule", "_group").orderBy(F.desc("score"), F.asc("id")))
    most = max(int(x) for x in [1, cases.agg(F.max("limit")).first()[0] or 1])
    return whole.withColumn("_rank", best).where((F.col("_rank") <= most) & (F.col("_rank") <= F.col("_share"))).select("case", "score", *columns)


def _block_hits(vectors: DataFrame, cases: list[dict], kind: str) -> DataFrame:
    """Of each task the best rows of each group of each case: case, score, _rule, _group, _share and the columns of vectors but the vector."""
    spark = vectors.sparkSession
    matrix = np.array([c["query"] for c in cases], np.float64)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    shared = spark.sparkContext.broadcast((cases, matrix, [plan_of(c) for c in cases]))
    names = [c for c in vectors.columns if c != "vector"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_A_BATCH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, queries, plans = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("vector")
            own = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            scores = np.round((own @ queries.T) / np.sqrt((own * own).sum(axis=1))[:, None], 6)
            codes, known = {}, {}
            for c in ("chunk_source", "ticker", "section_id", "accession_number"):
                d = b.column(c).dictionary_encode()
                known[c] = [*d.dictionary.to_pylist(), None]
                codes[c] = np.asarray(d.indices.fill_null(len(known[c]) - 1))
            of = lambda c, xs: np.array([v is not None and v in xs for v in known[c]], bool)[codes[c]]  # noqa: B023, E731
            ids = np.empty(b.num_rows, np.int64)
            ids[np.array(pa.compute.sort_indices(b.column("id")))] = np.arange(b.num_rows)
            web = of("chunk_source", {"document"})
            picked: list[tuple[int, int, str, int, np.ndarray]] = []
            for k, case in enumerate(asked):
                inside = of("ticker", set(case["tickers"])) if case["tickers"] else np.ones(b.num_rows, bool)
                filed = of("section_id", set(case["sections"])) if case["sections"] else np.ones(b.num_rows, bool)
                comparing = plans[k][0][1] == "ticker" and plans[k][0][0] == ""
                if comparing and case["by_ticker"] is not None:
                    mine = np.zeros(b.num_rows, bool)
                    for ticker in case["tickers"]:
                        accessions = case["by_ticker"].get(ticker)
                        mine |= of("ticker", {ticker}) & (True if accessions is None else of("accession_number", set(accessions)))
                    filed = filed & mine
                elif case["accessions"] is not None:
                    filed = filed & of("accession_number", set(case["accessions"]))
                inside &= web | filed
                for rule, (corpus, group, share) in enumerate(plans[k]):
                    at = np.flatnonzero(inside & of("chunk_source", {corpus}) if corpus else inside)
                    at = at[np.lexsort((ids[at], -scores[at, k]))]
                    for code in np.unique(codes[group][at]) if group else [None]:
                        best = (at if code is None else at[codes[group][at] == code])[:share]
                        picked.append((k, rule, "" if code is None else str(known[group][code]), share, best))
            rows = np.concatenate([x[4] for x in picked]) if picked else np.empty(0, np.int64)
            repeat = [len(x[4]) for x in picked]
            told = lambda i: np.repeat(np.array([x[i] for x in picked]), repeat)  # noqa: B023, E731
            at = told(0).astype(int)
            made = [pa.array([asked[k]["case"] for k in at.tolist()], types[0]), pa.array(scores[rows, at]), pa.array(told(1).astype(np.int32)), pa.array(told(2).astype(object), pa.string()), pa.array(told(3).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*made, *(b.column(c).take(pa.array(rows)) for c in names)], names=out)

    out = ["case", "score", "_rule", "_group", "_share", *names]
    types = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]]
    shape = ", ".join([f"case {kind}, score double, _rule int, _group string, _share int", *(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in names)])
    return vectors.where("vector is not null").mapInArrow(run, shape)


DIMENSIONS = 64


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(text: pd.Series) -> pd.Series:
    """The default embedder, deterministic: hashed words with signs, to unit length. Another `text -> array<float>` may take its place."""
    import xxhash

    def of(x: str | None) -> list[float] | None:
        if x is None:
            return None
        v = np.zeros(DIMENSIONS)
        for word in x.lower().split():
            h = xxhash.xxh3_64_intdigest(word)
            v[h % DIMENSIONS] += 1.0 if h >> 63 else -1.0
        return (v / (np.linalg.norm(v) or 1.0)).astype(np.float32).tolist()

    return text.map(of)


def check_dimensions(vectors: DataFrame, size: int) -> DataFrame:
    """vectors, of which one of another size raises when it is read."""
    message = F.concat(F.lit(f"vector size must be {size}, not "), F.size("vector").cast("string"))
    return vectors.withColumn("vector", F.when(F.size("vector") == size, F.col("vector")).otherwise(F.raise_error(message)))
