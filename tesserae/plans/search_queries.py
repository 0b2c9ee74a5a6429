"""Registered vector searches and retrieval strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate
from ..operators import vectors as v
from .domain import Domain, sql
from .registry import query

_DOT = "list_sum(list_transform(list_zip(CAST(v.vector AS DOUBLE[]), CAST(q.vector AS DOUBLE[])), lambda p: p[1] * p[2]))"
_NORM = "sqrt(list_sum(list_transform(CAST({}.vector AS DOUBLE[]), lambda x: x * x)))"
_SCORED = f"s AS (SELECT v.id, v.chunk_source, v.ticker, v.section_id, v.accession_number, round({_DOT} / ({_NORM.format('v')} * {_NORM.format('q')}), 6) AS score FROM vectors v, (SELECT vector FROM vectors WHERE id = 0) q)"
_OUT = ["id", "chunk_source", "ticker", "section_id", "accession_number", "score"]
_BEST = "ORDER BY score DESC, id LIMIT"


@query(sql(f"{{T}} , {_SCORED} SELECT * FROM s {_BEST} 20"))
def semantic_search_topk(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return v.search(d.vectors, d.query_vector(), 20).select(_OUT)


@query(sql(f"{{T}} , {_SCORED} SELECT * FROM s WHERE ticker = 'T1' AND section_id = '1A' AND chunk_source = 'sec_filing' {_BEST} 5"))
def semantic_search_filtered(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return v.search(d.vectors, d.query_vector(), 5, ticker="t1", section="1a", source="sec_filing").select(_OUT)


@query(sql(f"{{T}} , {_SCORED} SELECT * FROM s WHERE accession_number IN ('A1', 'A5') {_BEST} 10"))
def semantic_search_in_list(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return v.search(d.vectors, d.query_vector(), 10, accessions=["A1", "A5"]).select(_OUT)


@query(sql(f"{{T}} , {_SCORED} SELECT * FROM s WHERE false"))
def semantic_search_empty_scope(spark, sf_dir):
    """An empty list of accession numbers finds nothing."""
    d = Domain(spark, sf_dir)
    return v.search(d.vectors, d.query_vector(), 10, accessions=[]).select(_OUT)


@query(sql("{T} SELECT ticker, chunk_source, count(*) AS points FROM vectors GROUP BY ALL"))
def count_points(spark, sf_dir):
    return v.count_points(Domain(spark, sf_dir).vectors, "ticker", "chunk_source")


@query(sql(f"""{{T}} , {_SCORED}, h AS (SELECT *, row_number() OVER (PARTITION BY ticker, section_id {_BEST.replace(' LIMIT', '')}) AS k FROM s WHERE ticker IN ('T1', 'T2') AND section_id IN ('1', '1A')
  UNION ALL SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY score DESC, id) FROM s WHERE ticker IN ('T1', 'T2') AND chunk_source = 'document')
  SELECT DISTINCT * EXCLUDE (k) FROM h WHERE k <= 7 {_BEST} 7"""))  # fmt: skip
def retrieve_mixed(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return v.retrieve(d.vectors, d.query_vector(), 7, ["T1", "T2"], ["1", "1A"]).select(_OUT)


@query(sql(f"""{{T}} , {_SCORED}, a AS (SELECT *, row_number() OVER (PARTITION BY accession_number ORDER BY score DESC, id) AS k FROM s WHERE ticker IN ('T1', 'T2', 'T3') AND section_id IN ('1', '1A', '7') AND accession_number IN ('A1', 'A2', 'A4')),
  b AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY score DESC, id) AS k FROM s WHERE ticker IN ('T1', 'T2', 'T3') AND chunk_source = 'document')
  SELECT DISTINCT * EXCLUDE (k) FROM (SELECT * FROM a WHERE k <= 2 UNION ALL SELECT * FROM b WHERE k <= 5)"""))  # fmt: skip
def retrieve_period_balanced(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return v.retrieve(d.vectors, d.query_vector(), 5, ["T1", "T2", "T3"], ["1", "1A", "7"], ["A1", "A2", "A4"], intent="trend").select(_OUT)


@query(sql(f"""{{T}} , {_SCORED}, u AS (SELECT DISTINCT * FROM s WHERE ticker IN ('T0', 'T4') AND (chunk_source = 'document' OR section_id IN ('1', '7'))),
  k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY score DESC, id) AS k FROM u) SELECT * EXCLUDE (k) FROM k WHERE k <= 3"""))  # fmt: skip
def retrieve_comparison_balanced(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return v.retrieve(d.vectors, d.query_vector(), 5, ["T0", "T4"], ["1", "7"], intent="comparison").select(_OUT)


@query(sql(f"{{T}} , {_SCORED} SELECT * FROM s WHERE ticker IN ('T1', 'T2')"))
def dedupe_results(spark, sf_dir):
    """Hits found by two searches, each kept once."""
    d = Domain(spark, sf_dir)
    scored = d.vectors.withColumn("score", v.cosine(F.col("vector"), d.query_vector())).where("ticker in ('T1', 'T2')")
    return v.dedupe(scored.unionByName(scored.where("chunk_source = 'document'"))).select(_OUT)


#: One case a twentieth vector: its scope follows from its number.
_CASES = """c AS (SELECT id AS case_id, vector, 1 + id % 5 AS k, CASE (id // 20) % 4 WHEN 0 THEN [] WHEN 1 THEN ['T1'] ELSE ['T2', 'T3'] END AS tickers, CASE WHEN (id // 20) % 3 = 0 THEN ['1', '1A'] ELSE [] END AS sections,
  CASE (id // 20) % 5 WHEN 0 THEN NULL WHEN 1 THEN [] ELSE ['A1', 'A2', 'A4'] END AS accessions, CASE (id // 20) % 4 WHEN 2 THEN 'comparison' WHEN 3 THEN 'trend' ELSE 'summary' END AS intent FROM vectors WHERE id % 20 = 0)"""


def _cases(d: Domain):
    k = F.floor(F.col("id") / 20)
    none = F.array().cast("array<string>")
    text = lambda *xs: F.array(*map(F.lit, xs))
    return d.vectors.where("id % 20 = 0").select(
        F.col("id").alias("case"), F.col("vector").alias("query"), (1 + F.col("id") % 5).cast("int").alias("limit"), F.when(k % 4 == 0, none).when(k % 4 == 1, text("T1")).otherwise(text("T2", "T3")).alias("tickers"),
        F.when(k % 3 == 0, text("1", "1A")).otherwise(none).alias("sections"), F.when(k % 5 == 1, none).when(k % 5 > 1, text("A1", "A2", "A4")).alias("accessions"),
        F.when(k % 4 == 2, "comparison").when(k % 4 == 3, "trend").otherwise("summary").alias("intent"), F.lit("latest").alias("time_scope"), F.lit(None).cast("map<string,array<string>>").alias("by_ticker"),
    )


@query(sql(f"""{{T}} , {_CASES}, s AS (SELECT c.*, v.id, v.chunk_source, v.ticker, v.section_id, v.accession_number, round({_DOT.replace('q.', 'c.')} / ({_NORM.format('v')} * {_NORM.format('c')}), 6) AS score FROM vectors v, c
  WHERE (len(tickers) = 0 OR v.ticker IN (SELECT unnest(tickers))) AND (v.chunk_source = 'document' OR ((len(sections) = 0 OR list_contains(sections, v.section_id)) AND (accessions IS NULL OR list_contains(accessions, v.accession_number))))),
  g AS (SELECT *, CASE WHEN intent = 'comparison' THEN ticker WHEN intent = 'trend' AND len(accessions) > 1 AND chunk_source = 'document' THEN 'd' || ticker WHEN intent = 'trend' AND len(accessions) > 1 THEN accession_number ELSE '' END AS part,
  CASE WHEN intent = 'comparison' THEN ceil(k / 2.0) WHEN intent = 'trend' AND len(accessions) > 1 AND chunk_source <> 'document' THEN ceil(k / 3.0) ELSE k END AS share FROM s),
  r AS (SELECT *, row_number() OVER (PARTITION BY case_id, part ORDER BY score DESC, id) AS place FROM g)
  SELECT case_id AS "case", id, chunk_source, ticker, section_id, accession_number, score FROM r WHERE place <= share"""))  # fmt: skip
def retrieve_batch(spark, sf_dir):
    """Hits of a case for each twentieth vector, of every strategy and scope, in one scan."""
    d = Domain(spark, sf_dir)
    return v.retrieve_many(d.vectors, _cases(d)).select("case", *_OUT)


_READY = "f AS (SELECT * FROM (VALUES ('T0', 'A0', '2023-02-01'), ('T1', 'A1', '2022-02-01'), ('T1', 'A5', '2024-02-01'), ('T2', 'A2', '2023-05-01'), ('T2', 'A4', '2024-05-01'), ('T3', 'A7', '2024-01-01')) AS t(ticker, accession_number, filing_date))"
_EXPECTED = """e AS (SELECT id AS case_id, vector, 4 AS k, CASE (id // 20) % 4 WHEN 0 THEN ['T1'] WHEN 1 THEN ['T2'] WHEN 2 THEN ['T2', 'T3'] ELSE ['T4'] END AS tickers, ['latest', 'all_available', 'specific_years'][CAST((id // 20) % 3 AS INT) + 1] AS scope,
  CASE (id // 20) % 6 WHEN 2 THEN [2024] ELSE [] END AS wanted, CASE (id // 20) % 4 WHEN 2 THEN 'comparison' WHEN 1 THEN 'trend' ELSE 'summary' END AS intent FROM vectors WHERE id % 20 = 0)"""


def _expected(d: Domain):
    k = F.floor(F.col("id") / 20)
    text = lambda *xs: F.array(*map(F.lit, xs))
    return d.vectors.where("id % 20 = 0").select(
        F.col("id").alias("case"), F.col("vector").alias("query"), F.lit(4).alias("limit"), F.when(k % 4 == 0, text("T1")).when(k % 4 == 1, text("T2")).when(k % 4 == 2, text("T2", "T3")).otherwise(text("T4")).alias("tickers"),
        F.array().cast("array<string>").alias("sections"), F.when(k % 6 == 2, F.array(F.lit(2024))).otherwise(F.array().cast("array<int>")).alias("filing_years"),
        F.when(k % 4 == 2, "comparison").when(k % 4 == 1, "trend").otherwise("summary").alias("intent"), F.get(text("latest", "all_available", "specific_years"), (k % 3).cast("int")).alias("time_scope"),
    )


def _ready(spark):
    rows = [("T0", "A0", "2023-02-01"), ("T1", "A1", "2022-02-01"), ("T1", "A5", "2024-02-01"), ("T2", "A2", "2023-05-01"), ("T2", "A4", "2024-05-01"), ("T3", "A7", "2024-01-01")]
    return spark.createDataFrame(rows, "ticker string, accession_number string, filing_date string")


_SCOPES = f"""{_READY}, {_EXPECTED}, x AS (SELECT case_id, unnest(tickers) AS ticker, scope, wanted FROM e),
  y AS (SELECT *, CAST(substr(filing_date, 1, 4) AS INT) AS year, dense_rank() OVER (PARTITION BY ticker ORDER BY substr(filing_date, 1, 4) DESC) AS age FROM f),
  z AS (SELECT x.case_id, y.ticker, accession_number, year FROM x JOIN y USING (ticker) WHERE scope = 'all_available' OR (scope = 'latest' AND age = 1) OR (scope = 'specific_years' AND list_contains(wanted, year))),
  n AS (SELECT e.case_id, coalesce(list_sort(list(DISTINCT accession_number) FILTER (accession_number IS NOT NULL)), []) AS accessions, coalesce(list_sort(list(DISTINCT year) FILTER (year IS NOT NULL)), []) AS years FROM e LEFT JOIN z USING (case_id) GROUP BY e.case_id)"""
_HITS = f"""s AS (SELECT e.*, n.accessions, n.years, v.id, v.chunk_source, v.ticker, v.accession_number, round({_DOT.replace('q.', 'e.')} / ({_NORM.format('v')} * {_NORM.format('e')}), 6) AS score FROM e JOIN n USING (case_id), vectors v
  WHERE len(accessions) > 0 AND list_contains(tickers, v.ticker) AND (v.chunk_source = 'document' OR CASE WHEN intent = 'comparison' THEN EXISTS (SELECT 1 FROM z WHERE z.case_id = e.case_id AND z.ticker = v.ticker AND z.accession_number = v.accession_number) ELSE list_contains(accessions, v.accession_number) END)),
  g AS (SELECT *, len(accessions) > 1 AND (intent = 'trend' OR scope = 'all_available') AS periodic FROM s),
  p AS (SELECT *, CASE WHEN intent = 'comparison' THEN ticker WHEN periodic AND chunk_source = 'document' THEN 'd' || ticker WHEN periodic THEN accession_number ELSE '' END AS part,
  CASE WHEN intent = 'comparison' THEN ceil(k / 2.0) WHEN periodic AND chunk_source <> 'document' THEN ceil(k / CAST(len(accessions) AS DOUBLE)) ELSE k END AS share FROM g),
  r AS (SELECT *, row_number() OVER (PARTITION BY case_id, part ORDER BY score DESC, id) AS place FROM p),
  h AS (SELECT r.*, CAST(substr(f.filing_date, 1, 4) AS INT) AS year FROM r LEFT JOIN f ON f.accession_number = r.accession_number WHERE place <= share)"""


@query(sql(f"""{{T}} , {_SCOPES}, {_HITS}, t AS (SELECT case_id, count(*) AS hit_count, list(DISTINCT ticker) AS found, coalesce(list(DISTINCT year) FILTER (year IS NOT NULL), []) AS met, count(*) FILTER (scope = 'specific_years' AND NOT coalesce(list_contains(years, year), false)) AS outside FROM h GROUP BY case_id)
  SELECT e.case_id AS "case", len(accessions) = 0 AND NOT (scope = 'specific_years' AND len(wanted) = 0) AS out_of_scope, coalesce(hit_count, 0) AS hit_count, coalesce(outside, 0) AS outside_count,
  array_to_string(CASE WHEN len(accessions) > 0 AND intent = 'comparison' THEN list_sort(list_filter(tickers, lambda x: NOT list_contains(coalesce(found, []), x))) ELSE [] END, ',') AS missing_tickers,
  array_to_string(CASE WHEN len(accessions) > 0 AND (intent = 'trend' OR scope = 'all_available') THEN list_sort(list_filter(years, lambda x: NOT list_contains(coalesce(met, []), x))) ELSE [] END, ',') AS missing_years
  FROM e JOIN n USING (case_id) LEFT JOIN t USING (case_id)"""))  # fmt: skip
def retrieval_evaluation(spark, sf_dir):
    """Verdicts on the hits of a case for each twentieth vector, against the scope that its plan expects."""
    d = Domain(spark, sf_dir)
    verdicts, _ = evaluate.evaluate_retrieval(_expected(d), d.vectors, _ready(spark))
    listed = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("missing_tickers", "missing_years")}
    return verdicts.withColumns(listed)


@query(sql(f"""{{T}} , {_SCOPES}, {_HITS}, l AS (SELECT case_id, count(*) AS n, 'Retrieved evidence:' || chr(10) || string_agg('[' || i || '] ' || ticker || ': text of ' || id, chr(10) ORDER BY i) AS answer FROM
  (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, id) AS i FROM h) GROUP BY case_id)
  SELECT e.case_id AS "case", coalesce(n, 0) AS hit_count, sha256(coalesce(answer, CASE WHEN scope = 'specific_years' AND len(wanted) = 0 THEN 'The requested filing year is not available in the local filing index. Available filing years are ' ||
  array_to_string(list_transform(tickers, lambda x: x || ': ' || CASE x WHEN 'T1' THEN '2024, 2022' WHEN 'T2' THEN '2024, 2023' WHEN 'T3' THEN '2024' ELSE 'no available filing years' END), ', ') || '.'
  ELSE 'I could not answer from the local SEC filing index because retrieval returned no matching chunks for the requested scope.' END)) AS answer,
  array_to_string(CASE WHEN scope = 'specific_years' AND len(wanted) = 0 THEN CASE WHEN coalesce(n, 0) > 0 THEN ['retrieved chunks'] ELSE [] END ELSE list_filter([CASE WHEN intent = 'comparison' AND n IS NULL THEN 'comparison tickers' WHEN intent = 'comparison' AND
  len(list_filter(tickers, lambda x: NOT contains(answer, x))) > 0 THEN 'comparison tickers' END, CASE WHEN intent = 'trend' AND len(list_filter(years, lambda x: NOT contains(coalesce(answer, ''), CAST(x AS VARCHAR)))) > 0 THEN 'trend years' END], lambda x: x IS NOT NULL) END, ',') AS failures
  FROM e JOIN n USING (case_id) LEFT JOIN l USING (case_id)"""))  # fmt: skip
def answer_evaluation(spark, sf_dir):
    """Extractive answers to the same cases, and what they lack."""
    d = Domain(spark, sf_dir)
    cases = evaluate.case_scopes(_expected(d), _ready(spark))
    _, hits = evaluate.evaluate_retrieval(_expected(d), d.vectors, _ready(spark))
    years = F.create_map(*(x for t, ys in (("T0", [2023]), ("T1", [2024, 2022]), ("T2", [2024, 2023]), ("T3", [2024])) for x in (F.lit(t), F.array(*map(F.lit, ys)))))
    label = F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] "), "ticker")
    answers = evaluate.extractive_answers(cases, hits.withColumn("text", F.concat(F.lit("text of "), F.col("id").cast("string"))), label, years)
    failures = evaluate.evaluate_answers(cases.select("case", "tickers", "years", "intent", "time_scope", "filing_years"), answers)
    told = answers.join(failures, "case")
    return told.select("case", "hit_count", F.sha2("answer", 256).alias("answer"), F.array_join("failures", ",").alias("failures"))
