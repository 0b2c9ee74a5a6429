"""Registered labels, answers and evaluators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import answers as a
from ..operators import evaluate
from .domain import Domain, sql
from .registry import query

_LABEL = """CASE WHEN chunk_source = 'document' THEN '[' || i || '] ' || coalesce(nullif(source_name, ''), ticker, 'Web document') || ', ' || coalesce(substr(published_at, 1, 10), 'undated') || ', "' || coalesce(nullif(title, ''), 'Untitled') || '"'
  ELSE '[' || i || '] ' || ticker || ' ' || CASE WHEN regexp_matches(substr(coalesce(filing_date, ''), 1, 4), '^\\d+$') THEN substr(filing_date, 1, 4) ELSE 'unknown' END || ' 10-K Item ' || coalesce(section_id, 'None') || ' chunk ' || i END"""
_HITS = """h AS (SELECT id AS i, chunk_source, ticker, section_id, CASE WHEN id % 4 = 0 THEN 'Newsroom' END AS source_name, CASE WHEN id % 5 = 0 THEN '2024-03-01T00:00:00' END AS published_at, CASE WHEN id % 7 = 0 THEN '' ELSE 'Title ' || id END AS title,
  CASE WHEN id % 2 = 0 THEN '2023-05-05' END AS filing_date FROM vectors)"""


def _hits(d: Domain):
    of = lambda k, v: F.when(F.col("id") % k == 0, v)
    return d.vectors.select(
        F.col("id").alias("i"), "chunk_source", "ticker", "section_id", of(4, "Newsroom").alias("source_name"), of(5, "2024-03-01T00:00:00").alias("published_at"),
        of(7, "").otherwise(F.concat(F.lit("Title "), F.col("id").cast("string"))).alias("title"), of(2, "2023-05-05").alias("filing_date"), F.lit("10-K").alias("form_type"), F.col("id").alias("chunk_index"), F.lit(None).cast("string").alias("url"),
    )


@query(sql(f"{{T}} , {_HITS} SELECT i, {_LABEL} AS label FROM h"))
def source_labels(spark, sf_dir):
    hits = _hits(Domain(spark, sf_dir))
    return hits.select("i", a.source_label(F.col("i"), F.struct(*hits.columns)).alias("label"))


@query(r"""SELECT conv_id, 'Retrieved evidence:' || chr(10) || string_agg('[' || (turn + 1) || '] ' || CASE WHEN length(t) > 500 THEN substr(t, 1, 497) || '...' ELSE t END, chr(10) ORDER BY turn) AS answer
  FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations) GROUP BY conv_id""")
def extractive_answer(spark, sf_dir):
    """Of each conversation its turns as cited evidence, in order."""
    turns = Domain(spark, sf_dir).table("conversations")
    line = F.concat(F.lit("["), (F.col("turn") + 1).cast("string"), F.lit("] "), a.quote(F.col("text")))
    lines = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return lines.select("conv_id", F.concat(F.lit("Retrieved evidence:\n"), F.array_join(F.col("lines.line"), "\n")).alias("answer"))


@query(sql(r"""{T} SELECT id, CASE WHEN length(t) > 180 THEN substr(t, 1, 179) || '...' ELSE t END AS preview FROM (SELECT id, trim(regexp_replace(answer_text, '\s+', ' ', 'g')) AS t FROM query_runs)"""))
def answer_preview(spark, sf_dir):
    return Domain(spark, sf_dir).query_runs.select("id", a.answer_preview(F.col("answer_text")).alias("preview"))


@query("""SELECT c_custkey AS id, concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'tickers' END, CASE WHEN c_custkey % 3 = 0 THEN 'sections' END, CASE WHEN c_custkey % 5 = 0 THEN 'intent' END) AS failures FROM customer""")
def compare_plan(spark, sf_dir):
    """Fields in which made-up plans differ from what is expected of them."""
    base = Domain(spark, sf_dir).table("customer").select(F.col("c_custkey").alias("id"), F.array(F.lit("A"), F.lit("B")).alias("tickers"), F.array(F.lit("1")).alias("sections"), F.array(F.lit(2020)).alias("filing_years"), F.lit("latest").alias("time_scope"), F.lit("fact").alias("intent"))
    k = lambda n: F.col("id") % n == 0
    changes = {"tickers": F.when(k(2), F.array(F.lit("A"))).otherwise(F.array(F.lit("B"), F.lit("A"))), "sections": F.when(k(3), F.array(F.lit("7"))).otherwise(F.col("sections")), "intent": F.when(k(5), "trend").otherwise(F.col("intent"))}
    return evaluate.compare_plans(base, base.withColumns(changes)).select("id", F.array_join("failures", ",").alias("failures"))


@query(sql("""{T} , h AS (SELECT label AS id, ticker, section_id, CAST(2020 + id % 5 AS VARCHAR) || '-01-01' AS filing_date FROM vectors)
  SELECT id, count(*) AS hit_count, array_to_string(list_filter(['T0', 'T1'], lambda t: NOT list_contains(list(ticker), t)), ',') AS missing_tickers, count(*) FILTER (ticker NOT IN ('T0', 'T1') OR section_id IS NULL OR section_id NOT IN ('1', '7')) AS outside_count FROM h GROUP BY id"""))  # fmt: skip
def retrieval_scope_eval(spark, sf_dir):
    """Per label the tickers of a comparison without a hit, and the hits outside its scope."""
    v = Domain(spark, sf_dir).vectors
    hits = v.select(F.col("label").alias("id"), "ticker", "section_id", F.concat((2020 + F.col("id") % 5).cast("string"), F.lit("-01-01")).alias("filing_date"))
    wanted = hits.select("id").distinct().select("id", F.array(F.lit("T0"), F.lit("T1")).alias("tickers"), F.array(F.lit("1"), F.lit("7")).alias("sections"), F.array().cast("array<int>").alias("years"), F.lit("comparison").alias("intent"), F.lit("latest").alias("time_scope"))
    return evaluate.scope_failures(wanted, hits).select("id", "hit_count", F.array_join("missing_tickers", ",").alias("missing_tickers"), "outside_count")


@query(r"""SELECT conv_id, turn, concat_ws(',', CASE WHEN turn > 0 AND NOT regexp_matches(t, '\[\d+\]') THEN 'no citation labels' END, CASE WHEN NOT (contains(upper(t), 'NVDA') AND contains(upper(t), 'AMD')) THEN 'comparison tickers' END) AS failures
  FROM (SELECT conv_id, turn, coalesce(text, '') || CASE turn % 3 WHEN 0 THEN ' [1] nvda' WHEN 1 THEN ' AMD and Nvda' ELSE ' [2] amd NVDA' END AS t FROM conversations)""")
def answer_quality(spark, sf_dir):
    """What made-up comparison answers lack."""
    k = F.col("turn") % 3
    t = F.concat(F.coalesce("text", F.lit("")), F.when(k == 0, " [1] nvda").when(k == 1, " AMD and Nvda").otherwise(" [2] amd NVDA"))
    failures = evaluate.answer_failures(t, F.col("turn") > 0, F.array(F.lit("NVDA"), F.lit("AMD")), F.array().cast("array<int>"), F.lit("comparison"), F.lit(False))
    return Domain(spark, sf_dir).table("conversations").select("conv_id", "turn", F.array_join(failures, ",").alias("failures"))


_FIELDS = {"company_name": "'Company ' || ticker", "source_type": "'newsroom'", "ownership": "'official'", "trust_level": "'high'", "document_type": "'article'", "form_type": "'10-K'", "section_title": "'Section ' || section_id"}
_TOLD = f"(SELECT *, i AS chunk_index, i % 100 AS score, {', '.join(f'{v} AS {k}' for k, v in _FIELDS.items())}, CASE WHEN chunk_source = 'document' THEN i END AS document_id, CASE WHEN chunk_source = 'document' THEN i + 1 END AS document_chunk_id, 7 AS source_id, CAST(NULL AS VARCHAR) AS url, CASE WHEN chunk_source <> 'document' THEN 'A' || i END AS accession_number FROM h)"
_ALL = "'score', score, 'chunk_source', chunk_source, 'ticker', ticker, 'company_name', company_name, 'chunk_index', chunk_index"


def _told(d: Domain):
    """Hits with all that is told of a chunk."""
    web = F.col("chunk_source") == "document"
    rows = _hits(d).drop("url", "form_type", "chunk_index").withColumns({k: F.expr(v) for k, v in _FIELDS.items()})
    i = F.col("i")
    return rows.withColumns({"chunk_index": i, "score": i % 100, "document_id": F.when(web, i), "document_chunk_id": F.when(web, i + 1), "source_id": F.lit(7), "url": F.lit(None).cast("string"), "accession_number": F.when(~web, F.concat(F.lit("A"), i.cast("string"))), "text": F.lit(None).cast("string")})


@query(sql(f"""{{T}} , {_HITS}, t AS {_TOLD} SELECT i, {_LABEL} AS label, CASE WHEN chunk_source = 'document' THEN json_object({_ALL}, 'document_id', document_id, 'document_chunk_id', document_chunk_id, 'source_id', source_id, 'source_name', source_name,
  'source_type', source_type, 'ownership', ownership, 'trust_level', trust_level, 'url', url, 'title', title, 'published_at', published_at, 'document_type', document_type)
  ELSE json_object({_ALL}, 'filing_date', filing_date, 'form_type', form_type, 'section_id', section_id, 'section_title', section_title, 'accession_number', accession_number) END::VARCHAR AS metadata FROM t"""))  # fmt: skip
def evidence_blocks(spark, sf_dir):
    """Each hit as evidence: label and metadata of its corpus."""
    hits = _told(Domain(spark, sf_dir))
    return hits.select("i", a.evidence(F.col("i"), F.struct(*hits.columns)).alias("e")).select("i", "e.label", "e.metadata")


@query(sql(f"""{{T}} , {_HITS}, t AS {_TOLD} SELECT i, json_object('sources', [json_object('label', {_LABEL}, 'score', score, 'chunk_source', chunk_source, 'ticker', ticker, 'company_name', company_name, 'filing_date', filing_date, 'published_at', published_at,
  'section_id', section_id, 'section_title', section_title, 'chunk_index', chunk_index, 'accession_number', accession_number, 'document_id', document_id, 'source_id', source_id, 'source_name', source_name, 'source_type', source_type, 'url', url, 'title', title)],
  'warnings', ['llm answer generation unavailable'], 'used_fallback', i % 2 = 0, 'planner_error', CASE WHEN i % 2 = 0 THEN 'late' END)::VARCHAR AS metadata FROM t"""))  # fmt: skip
def response_metadata(spark, sf_dir):
    """What a run keeps of a response with one source."""
    hits = _told(Domain(spark, sf_dir))
    even = F.col("i") % 2 == 0
    made = a.response_metadata(F.array(a.source_chunk(F.col("i"), F.struct(*hits.columns))), F.array(F.lit("llm answer generation unavailable")), even, F.when(even, "late"))
    return hits.select("i", made.alias("metadata"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'The requested filing year is not available in the local filing index. Available filing years are NVDA: 2023, 2022, XYZ: no available filing years.'
  WHEN c_custkey % 3 = 0 THEN 'The requested filing year is not available in the local filing index.' WHEN c_custkey % 2 = 1 THEN 'I could not answer from the local SEC filing index because the question did not match an indexed company ticker. Available tickers are AMD, NVDA.'
  ELSE 'I could not answer from the local SEC filing index because retrieval returned no matching chunks for the requested scope.' END AS answer FROM customer""")
def no_evidence_answer(spark, sf_dir):
    """Why there is no answer: the year, the ticker, or nothing found."""
    k = lambda n: F.col("c_custkey") % n == 0
    none = F.array().cast("array<string>")
    plan = F.struct(F.when(k(2), F.array(F.lit("NVDA"), F.lit("XYZ"))).otherwise(none).alias("tickers"), F.when(k(3), "specific_years").otherwise("latest").alias("time_scope"), F.array().cast("array<int>").alias("filing_years"))
    years = F.create_map(F.lit("NVDA"), F.array(F.lit(2023), F.lit(2022)), F.lit("AMD"), F.array(F.lit(2022)))
    return Domain(spark, sf_dir).table("customer").select(F.col("c_custkey").alias("id"), a.no_evidence_answer(plan, years).alias("answer"))


@query("SELECT conv_id, turn, sha256(CASE WHEN length(t) > 500 THEN substr(t, 1, 497) || '...' ELSE t END) AS quote, turn + 1 AS i FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations)")
def evidence_index(spark, sf_dir):
    """Quotes numbered from 1 in each conversation, in order."""
    turns = Domain(spark, sf_dir).table("conversations")
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    return turns.select("conv_id", "turn", F.sha2(a.quote(F.col("text")), 256).alias("quote"), i.alias("i"))
