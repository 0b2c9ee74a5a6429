"""Registered lookups, listings and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import health, vectors
from ..operators import relational as r
from .domain import COLLECTION, MODEL, Domain, sql
from .registry import query

_HERE = f"embedding_model = '{MODEL}' AND vector_collection = '{COLLECTION}'"
_ELIGIBLE = "enabled AND discovery_status IN ('approved', 'manual')"
_LATEST = """(SELECT source_id, status AS last_ingestion_status, completed_at AS last_ingestion_completed_at FROM (SELECT *, row_number() OVER (PARTITION BY source_id
  ORDER BY coalesce(completed_at, started_at) DESC NULLS LAST, id DESC) AS k FROM ingestion_runs) WHERE k = 1)"""
_LISTED = f"""SELECT s.id, s.name, s.url, s.discovery_status, s.enabled, s.confidence_score, c.ticker, c.name AS company_name, coalesce(n, 0) AS document_count, last_ingestion_status, last_ingestion_completed_at
  FROM sources s LEFT JOIN companies c ON c.id = s.company_id LEFT JOIN (SELECT source_id, count(*) AS n FROM articles GROUP BY 1) d ON d.source_id = s.id LEFT JOIN {_LATEST} l ON l.source_id = s.id"""
_LIST = ["id", "name", "url", "discovery_status", "enabled", "confidence_score", "ticker", "company_name", "document_count", "last_ingestion_status", "last_ingestion_completed_at"]
_INDEX = f"""SELECT f.*, coalesce(e.status, 'pending') AS status, coalesce(expected_point_count, 0) AS expected_point_count, coalesce(indexed_point_count, 0) AS indexed_point_count
  FROM filings f LEFT JOIN embedding_runs e ON e.filing_id = f.id AND {_HERE}"""


@query(sql("{T} SELECT id, ticker, name, cik FROM companies WHERE ticker = 'CUSTOMER#000000042'"))
def company_lookup(spark, sf_dir):
    return r.company_by_ticker(Domain(spark, sf_dir).companies, "Customer#000000042").select("id", "ticker", "name", "cik")


@query(sql("{T} SELECT ticker, company_name, cik, filing_date FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC NULLS LAST, id DESC) AS k FROM filings) WHERE k = 1"))
def latest_filing_metadata(spark, sf_dir):
    return r.latest_filing_metadata(Domain(spark, sf_dir).filings)


@query(sql("{T} " + _LISTED))
def list_sources(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return r.list_sources(d.sources, d.companies, d.articles, d.ingestion_runs).select(_LIST)


@query(sql("{T} " + _LISTED + " WHERE s.discovery_status = 'approved' AND s.enabled"))
def list_sources_filtered(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return r.list_sources(d.sources, d.companies, d.articles, d.ingestion_runs, status="approved", enabled=True).select(_LIST)


@query(sql("{T} SELECT s.id, s.name, s.url, c.ticker, c.name AS company_name FROM sources s LEFT JOIN companies c ON c.id = s.company_id WHERE s.id = 7"))
def load_source(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return r.load_source(d.sources, d.companies, 7).select("id", "name", "url", "ticker", "company_name")


@query(sql(f"{{T}} SELECT s.id, s.name, s.url, c.ticker FROM sources s LEFT JOIN companies c ON c.id = s.company_id WHERE {_ELIGIBLE}"))
def approved_sources(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return r.approved_sources(d.sources, d.companies).select("id", "name", "url", "ticker")


@query(sql(f"""{{T}} SELECT c.filing_id, c.section_id, c.chunk_index, c.text, f.accession_number, f.ticker, f.filing_date FROM chunks c JOIN filings f ON f.id = c.filing_id
  LEFT JOIN embedding_runs e ON e.filing_id = f.id AND {_HERE} WHERE e.status IS NULL OR e.status <> 'ready'"""))  # fmt: skip
def pending_filing_chunks(spark, sf_dir):
    d = Domain(spark, sf_dir)
    found = r.pending_filing_chunks(d.chunks, d.filings, d.embedding_runs, MODEL, COLLECTION)
    return found.select("filing_id", "section_id", "chunk_index", "text", "accession_number", "ticker", "filing_date")


@query(sql(f"""{{T}} SELECT k.id, k.document_id, k.chunk_index, k.text, a.source_id, a.url, s.name AS source_name, s.trust_level FROM article_chunks k JOIN articles a ON a.id = k.document_id
  JOIN sources s ON s.id = a.source_id LEFT JOIN article_records e ON e.document_chunk_id = k.id AND {_HERE} WHERE e.document_chunk_id IS NULL AND {_ELIGIBLE}"""))  # fmt: skip
def pending_document_chunks(spark, sf_dir):
    d = Domain(spark, sf_dir)
    found = r.pending_document_chunks(d.article_chunks, d.articles, d.sources, d.article_records, MODEL, COLLECTION)
    return found.select("id", "document_id", "chunk_index", "text", "source_id", "url", "source_name", "trust_level")


_READY = f"SELECT ticker, accession_number, filing_date FROM filings WHERE id IN (SELECT filing_id FROM embedding_runs WHERE status = 'ready' AND {_HERE})"


@query(sql("{T} " + _READY))
def ready_accessions(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return r.ready_accessions(d.filings, d.embedding_runs, MODEL, COLLECTION)


@query(sql("{T} " + _READY + " AND ticker = 'MACHINERY' AND TRY_CAST(substr(filing_date, 1, 4) AS INT) IN (1996, 1998)"))
def ready_accessions_years(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return r.ready_accessions(d.filings, d.embedding_runs, MODEL, COLLECTION, "machinery", [1996, 1998])


@query(sql("{T} " + _READY + " AND false"))
def ready_accessions_no_years(spark, sf_dir):
    """An empty list of years finds nothing."""
    d = Domain(spark, sf_dir)
    return r.ready_accessions(d.filings, d.embedding_runs, MODEL, COLLECTION, years=[])


@query(sql("{T} SELECT DISTINCT ticker, company_name, filing_date, section_id FROM filings f JOIN chunks c ON c.filing_id = f.id"))
def planner_metadata(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return r.planner_metadata(d.filings, d.chunks)


@query(sql("""{T} , m AS (SELECT DISTINCT ticker, company_name, filing_date, section_id FROM filings f JOIN chunks c ON c.filing_id = f.id)
  SELECT ticker, array_to_string(list_sort(list(DISTINCT TRY_CAST(substr(filing_date, 1, 4) AS INT)), 'DESC'), ',') AS years, count(DISTINCT company_name) AS names,
  array_to_string(list_filter(['1', '1A', '7', '7A'], lambda s: list_contains(list(DISTINCT section_id), s)), ',') AS sections FROM m GROUP BY ticker"""))  # fmt: skip
def planner_context(spark, sf_dir):
    d = Domain(spark, sf_dir)
    found = r.planner_context(r.planner_metadata(d.filings, d.chunks), ("1", "1A", "7", "7A"))
    return found.select("ticker", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"), F.size("names").cast("long").alias("names"), F.array_join("sections", ",").alias("sections"))


@query(sql("{T} " + _INDEX))
def index_metadata(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return r.index_metadata(d.filings, d.embedding_runs, MODEL, COLLECTION)


@query(sql("{T} SELECT ticker, section_id, count(*) AS chunk_count FROM filings f JOIN chunks c ON c.filing_id = f.id GROUP BY ALL"))
def section_counts(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return r.section_counts(d.filings, d.chunks)


@query(sql("""{T} SELECT ticker, string_agg(section_id || '=' || n, ',' ORDER BY section_id) AS sections FROM (SELECT ticker, section_id, count(*) AS n FROM filings f JOIN chunks c ON c.filing_id = f.id GROUP BY ALL) GROUP BY ticker"""))
def ticker_sections_nested(spark, sf_dir):
    d = Domain(spark, sf_dir)
    found = r.ticker_sections(r.section_counts(d.filings, d.chunks))
    return found.select("ticker", F.array_join(F.transform("sections", lambda s: F.concat_ws("=", s["section_id"], s["chunk_count"].cast("string"))), ",").alias("sections"))


_COUNTS = f"""SELECT (SELECT count(*) FROM chunks) AS sec_expected_points, (SELECT CAST(coalesce(sum(expected_point_count), 0) AS BIGINT) FROM embedding_runs WHERE status = 'ready' AND {_HERE}) AS sec_ready_points,
  (SELECT count(*) FROM filing_records WHERE {_HERE}) AS sec_embedding_records, (SELECT count(*) FROM article_chunks k JOIN articles a ON a.id = k.document_id JOIN sources s ON s.id = a.source_id WHERE {_ELIGIBLE}) AS document_expected_points,
  (SELECT count(*) FROM article_records WHERE {_HERE}) AS document_embedding_records"""


def _counts(d: Domain):
    return r.health_counts(d.chunks, d.embedding_runs, d.filing_records, d.article_chunks, d.articles, d.sources, d.article_records, MODEL, COLLECTION)


@query(sql("{T} " + _COUNTS))
def health_counts(spark, sf_dir):
    return _counts(Domain(spark, sf_dir))


@query(sql("{T} , n AS (" + _COUNTS + """), p AS (SELECT count(*) FILTER (chunk_source = 'sec_filing') AS a, count(*) FILTER (chunk_source = 'document') AS b FROM vectors),
  c AS (SELECT sec_expected_points AS expected, sec_ready_points AS ready, sec_embedding_records AS records, a AS points FROM n, p UNION ALL SELECT document_expected_points, document_embedding_records, document_embedding_records, b FROM n, p)
  SELECT CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(ready) AS BIGINT) AS ready, CAST(sum(records) AS BIGINT) AS records, CAST(sum(points) AS BIGINT) AS points, CAST(sum(greatest(0, records - points)) AS BIGINT) AS missing,
  CAST(sum(greatest(0, points - records)) AS BIGINT) AS extra, bool_and(expected = ready AND expected = records) AS complete, bool_and(records = points) AS consistent,
  CASE WHEN sum(expected) = 0 AND sum(points) = 0 THEN 'empty' WHEN NOT bool_and(records = points) THEN 'degraded' WHEN NOT bool_and(expected = ready AND expected = records) THEN 'building' ELSE 'healthy' END AS status FROM c"""))  # fmt: skip
def index_health_status(spark, sf_dir):
    d = Domain(spark, sf_dir)
    points = {x["chunk_source"]: x["count"] for x in d.vectors.groupBy("chunk_source").count().collect()}  # two rows
    return health.index_status(health.corpora_from_counts(_counts(d), points.get("sec_filing", 0), points.get("document", 0)), True)


@query(sql("{T} SELECT id, session_key, status, started_at FROM query_runs ORDER BY started_at DESC, id DESC LIMIT 50"))
def recent_query_runs(spark, sf_dir):
    return r.recent_query_runs(Domain(spark, sf_dir).query_runs, 50).select("id", "session_key", "status", "started_at")


@query(sql("{T} SELECT id, session_key, status, started_at FROM query_runs WHERE session_key = '3' ORDER BY started_at DESC, id DESC LIMIT 50"))
def session_query_runs(spark, sf_dir):
    return r.recent_query_runs(Domain(spark, sf_dir).query_runs, 50, "3").select("id", "session_key", "status", "started_at")


@query(sql("{T} , i AS (" + _INDEX + """) SELECT ticker, count(*) AS filing_count, CAST(sum(expected_point_count) AS BIGINT) AS expected_points, CAST(sum(indexed_point_count) AS BIGINT) AS indexed_points,
  count(DISTINCT substr(filing_date, 1, 4)) AS year_count, CAST(CASE WHEN sum(expected_point_count) > 0 THEN least(greatest(round(100 * sum(indexed_point_count) / sum(expected_point_count)), 0), 100) ELSE 0 END AS INT) AS progress,
  CASE WHEN bool_and(status = 'ready') THEN 'ready' ELSE 'mixed' END AS state FROM i GROUP BY ticker"""))  # fmt: skip
def ticker_rollup(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return r.ticker_rollup(r.index_metadata(d.filings, d.embedding_runs, MODEL, COLLECTION))


@query(sql("{T} , i AS (" + _INDEX + "), l AS (" + _LISTED + f""") SELECT (SELECT count(*) FROM i WHERE status = 'ready' AND expected_point_count > 0 AND indexed_point_count >= expected_point_count) AS indexed_filing_count,
  (SELECT count(*) FROM l WHERE {_ELIGIBLE}) AS approved_source_count, (SELECT count(*) FROM l WHERE discovery_status = 'candidate') AS candidate_source_count, (SELECT CAST(sum(document_count) AS BIGINT) FROM l) AS document_count"""))  # fmt: skip
def index_summary(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return r.index_summary(r.index_metadata(d.filings, d.embedding_runs, MODEL, COLLECTION), r.list_sources(d.sources, d.companies, d.articles, d.ingestion_runs))


@query(sql("{T} SELECT id, session_key, status, started_at FROM query_runs WHERE id = 5003"))
def query_run_lookup(spark, sf_dir):
    return r.query_run(Domain(spark, sf_dir).query_runs, 5003).select("id", "session_key", "status", "started_at")


@query("SELECT conv_id AS id, CAST(conv_id AS VARCHAR) AS session_key, count(*) AS turns FROM conversations WHERE conv_id = 7 GROUP BY conv_id")
def research_session_lookup(spark, sf_dir):
    d = Domain(spark, sf_dir)
    sessions = d.query_runs.groupBy("session_key").agg(F.count(F.lit(1)).alias("turns")).withColumn("id", F.col("session_key").cast("long"))
    return r.research_session(sessions, "7").select("id", "session_key", "turns")


@query(sql("{T} " + _LISTED + " WHERE NOT s.enabled"))
def list_sources_disabled(spark, sf_dir):
    """Sources by the text of an enabled filter."""
    d = Domain(spark, sf_dir)
    return r.list_sources(d.sources, d.companies, d.articles, d.ingestion_runs, enabled=r.enabled_filter("No")).select(_LIST)


@query(sql("{T} SELECT id AS vector_id FROM vectors WHERE chunk_source = 'sec_filing' AND accession_number = 'A5'"))
def vector_ids_of_filing(spark, sf_dir):
    return vectors.vector_ids(Domain(spark, sf_dir).vectors, accession="A5").select(F.col("id").alias("vector_id"))


@query(sql("{T} SELECT id AS vector_id FROM vectors WHERE chunk_source = 'document' AND id // 6 = 2"))
def vector_ids_of_document(spark, sf_dir):
    """Ids of the vectors of one document; six ids in a row are of one."""
    v = Domain(spark, sf_dir).vectors.withColumn("document_id", F.floor(F.col("id") / 6))
    return vectors.vector_ids(v, document_id=2).select(F.col("id").alias("vector_id"))
