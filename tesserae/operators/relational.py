"""Lookups, listings and roll-ups over the catalog's relations.

Each takes DataFrames in the catalog's schemas (tesserae.sources.schemas) and returns a DataFrame.
Counts are taken before joins, latest rows by a window of rank 1 (which Spark limits per group
before the shuffle), absent partners by anti-joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ELIGIBLE = ("approved", "manual")


def eligible(enabled: str = "enabled", status: str = "discovery_status") -> Column:
    """Sources that are ingested and indexed."""
    return F.col(enabled) & F.col(status).isin(*ELIGIBLE)


def company_by_ticker(companies: DataFrame, ticker: str) -> DataFrame:
    return companies.where(F.col("ticker") == ticker.upper())


def latest_filing_metadata(filings: DataFrame) -> DataFrame:
    """Of each ticker the company's data in its latest filing."""
    order = Window.partitionBy("ticker").orderBy(F.desc_nulls_last("filing_date"), F.desc("id"))
    return filings.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("ticker", "company_name", "cik", "filing_date")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest ingestion run of each source."""
    order = Window.partitionBy("source_id").orderBy(F.coalesce("completed_at", "started_at").desc_nulls_last(), F.desc("id"))
    latest = runs.withColumn("rank", F.row_number().over(order)).where("rank = 1")
    return latest.select("source_id", F.col("status").alias("last_ingestion_status"), F.col("completed_at").alias("last_ingestion_completed_at"))


def list_sources(sources: DataFrame, companies: DataFrame, documents: DataFrame, runs: DataFrame, ticker: str | None = None, status: str | None = None, enabled: bool | None = None) -> DataFrame:
    """Sources with their company, number of documents and latest run; sorted."""
    if status is not None:
        sources = sources.where(F.col("discovery_status") == status)
    if enabled is not None:
        sources = sources.where(F.col("enabled") == enabled)
    named = companies.select(F.col("id").alias("company_id"), "ticker", F.col("name").alias("company_name"))
    if ticker is not None:
        named = named.where(F.col("ticker") == ticker.upper())
    counts = documents.groupBy("source_id").agg(F.count(F.lit(1)).alias("document_count"))
    listed = sources.join(named, "company_id", "inner" if ticker is not None else "left")
    listed = listed.join(counts.withColumnRenamed("source_id", "id"), "id", "left").join(latest_runs(runs).withColumnRenamed("source_id", "id"), "id", "left")
    listed = listed.withColumn("document_count", F.coalesce("document_count", F.lit(0).cast("long")))
    return listed.orderBy(F.col("ticker").isNull(), "ticker", "discovery_status", F.desc_nulls_last("confidence_score"), "name")


def load_source(sources: DataFrame, companies: DataFrame, source_id: int) -> DataFrame:
    named = companies.select(F.col("id").alias("company_id"), "ticker", F.col("name").alias("company_name"))
    return sources.where(F.col("id") == source_id).join(named, "company_id", "left")


def approved_sources(sources: DataFrame, companies: DataFrame, ticker: str | None = None) -> DataFrame:
    named = companies.select(F.col("id").alias("company_id"), "ticker")
    found = sources.where(eligible()).join(named, "company_id", "left")
    return (found if ticker is None else found.where(F.col("ticker") == ticker.upper())).orderBy("ticker", "name", "id")


def pending_filing_chunks(chunks: DataFrame, filings: DataFrame, runs: DataFrame, model: str, collection: str) -> DataFrame:
    """Chunks of filings that have no ready run of this model and collection."""
    ready = runs.where((F.col("embedding_model") == model) & (F.col("vector_collection") == collection) & (F.col("status") == "ready")).select(F.col("filing_id").alias("id"))
    open_ = filings.join(ready, "id", "left_anti").withColumnRenamed("id", "filing_id")
    return chunks.join(open_, "filing_id")


def pending_document_chunks(chunks: DataFrame, documents: DataFrame, sources: DataFrame, records: DataFrame, model: str, collection: str) -> DataFrame:
    """Chunks of eligible sources' documents that are not recorded as embedded."""
    done = records.where((F.col("embedding_model") == model) & (F.col("vector_collection") == collection)).select(F.col("document_chunk_id").alias("id"))
    own = sources.where(eligible()).select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "trust_level")
    docs = documents.join(own, "source_id").select(F.col("id").alias("document_id"), "source_id", "url", "title", "source_name", "trust_level")
    return chunks.join(done, "id", "left_anti").join(docs, "document_id")


def ready_accessions(filings: DataFrame, runs: DataFrame, model: str, collection: str, ticker: str | None = None, years: Sequence[int] | None = None) -> DataFrame:
    """Accession numbers with a ready run. No years given: all; an empty list: none."""
    ready = runs.where((F.col("embedding_model") == model) & (F.col("vector_collection") == collection) & (F.col("status") == "ready"))
    if ticker is not None:
        filings = filings.where(F.col("ticker") == ticker.upper())
    if years is not None:
        filings = filings.where(F.substring("filing_date", 1, 4).try_cast("int").isin(*years) if years else F.lit(False))
    return filings.join(ready.select(F.col("filing_id").alias("id")), "id", "left_semi").select("ticker", "accession_number", "filing_date")


def planner_metadata(filings: DataFrame, chunks: DataFrame) -> DataFrame:
    sections = chunks.select("filing_id", "section_id").distinct()
    return filings.select(F.col("id").alias("filing_id"), "ticker", "company_name", "filing_date").join(sections, "filing_id").select("ticker", "company_name", "filing_date", "section_id").distinct()


def planner_context(metadata: DataFrame, sections: Sequence[str]) -> DataFrame:
    """Per ticker its years, latest first, its company names, and those of `sections` it has, in their order."""
    year = F.substring("filing_date", 1, 4).try_cast("int")
    found = metadata.groupBy("ticker").agg(
        F.sort_array(F.collect_set(year), asc=False).alias("years"),
        F.sort_array(F.collect_set("company_name")).alias("names"),
        F.collect_set("section_id").alias("own"),
    )
    known = F.array(*map(F.lit, sections))
    return found.select("ticker", "years", "names", F.filter(known, lambda s: F.array_contains("own", s)).alias("sections"))


def index_metadata(filings: DataFrame, runs: DataFrame, model: str, collection: str) -> DataFrame:
    """Filings with the state of their embedding run; one without a run is pending."""
    own = runs.where((F.col("embedding_model") == model) & (F.col("vector_collection") == collection))
    own = own.select(F.col("filing_id").alias("id"), "status", "expected_point_count", "indexed_point_count")
    joined = filings.join(own, "id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    return joined.fillna(0, ["expected_point_count", "indexed_point_count"])


def section_counts(filings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks per ticker and section: counted per filing before the join."""
    per_filing = chunks.groupBy("filing_id", "section_id").agg(F.count(F.lit(1)).alias("n"))
    joined = per_filing.join(filings.select(F.col("id").alias("filing_id"), "ticker"), "filing_id")
    return joined.groupBy("ticker", "section_id").agg(F.sum("n").alias("chunk_count"))


def health_counts(chunks: DataFrame, runs: DataFrame, records: DataFrame, doc_chunks: DataFrame, documents: DataFrame, sources: DataFrame, doc_records: DataFrame, model: str, collection: str) -> DataFrame:
    """One row of five counts, each summed in its own branch and laid side by side by name."""
    here = (F.col("embedding_model") == model) & (F.col("vector_collection") == collection)
    own = documents.join(sources.where(eligible()).select(F.col("id").alias("source_id")), "source_id", "left_semi")
    branches = {
        "sec_expected_points": chunks.agg(F.count(F.lit(1)).alias("n")),
        "sec_ready_points": runs.where(here & (F.col("status") == "ready")).agg(F.coalesce(F.sum("expected_point_count"), F.lit(0)).cast("long").alias("n")),
        "sec_embedding_records": records.where(here).agg(F.count(F.lit(1)).alias("n")),
        "document_expected_points": doc_chunks.join(own.select(F.col("id").alias("document_id")), "document_id", "left_semi").agg(F.count(F.lit(1)).alias("n")),
        "document_embedding_records": doc_records.where(here).agg(F.count(F.lit(1)).alias("n")),
    }
    parts = [df.select(F.lit(k).alias("k"), F.col("n").cast("long")) for k, df in branches.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole.groupBy().agg(*(F.coalesce(F.max(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(k) for k in branches))


def recent_query_runs(runs: DataFrame, limit: int, session: str | None = None) -> DataFrame:
    if limit < 1:
        raise ValueError("limit must be at least 1")
    found = runs if session is None else runs.where(F.col("session_key") == session)
    return found.orderBy(F.desc_nulls_last("started_at"), F.desc("id")).limit(limit)


def query_run(runs: DataFrame, run_id: int) -> DataFrame:
    return runs.where(F.col("id") == run_id)


def research_session(sessions: DataFrame, session_key: str) -> DataFrame:
    return sessions.where(F.col("session_key") == session_key)


def enabled_filter(value: str | None) -> bool | None:
    """`true`, `yes`, `1` and `false`, `no`, `0` in any case; None is no filter."""
    if value is None:
        return None
    found = {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}.get(value.lower())
    if found is None:
        raise ValueError("enabled must be one of: true, false, yes, no, 1, 0")
    return found


def accessions_in_scope(ready: DataFrame, scope: Column, wanted: Column, tickers: Sequence[str] | None = None) -> DataFrame:
    """Of ready(ticker, accession_number, filing_date) those in the years that a plan's time scope takes of each ticker."""
    from ..functions import planner

    own = ready if tickers is None else ready.where(F.col("ticker").isin(*tickers))
    own = own.withColumn("year", F.substring("filing_date", 1, 4).try_cast("int"))
    years = own.groupBy("ticker").agg(F.collect_set("year").alias("years"))
    return own.join(years, "ticker").where(F.array_contains(planner.scope_years(scope, wanted, F.col("years")), F.col("year"))).select("ticker", "accession_number", "year")


def unseen(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """Entries whose url is new for their source and whose content is new everywhere."""
    by_url = entries.join(documents.select("source_id", "url"), ["source_id", "url"], "left_anti")
    return by_url.join(documents.select("content_hash").where("content_hash is not null"), "content_hash", "left_anti")


def discovery_state(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Newly found sources with the state to store: a person's decision stays, all else is an enabled candidate."""
    known = sources.select("url", F.col("discovery_status").alias("was"), F.col("enabled").alias("was_enabled"))
    decided = F.coalesce(F.col("was") != "candidate", F.lit(False))
    joined = found.drop("discovery_status", "enabled").join(known, "url", "left")
    joined = joined.withColumn("discovery_status", F.when(decided, F.col("was")).otherwise("candidate"))
    return joined.withColumn("enabled", F.when(decided, F.col("was_enabled")).otherwise(True)).drop("was", "was_enabled")


def ticker_rollup(index: DataFrame) -> DataFrame:
    """Per ticker the points expected and indexed, years, progress in percent, and whether all is ready; from index_metadata."""
    expected, indexed = F.sum("expected_point_count"), F.sum("indexed_point_count")
    progress = F.when(expected > 0, F.least(F.greatest(F.round(100 * indexed / expected), F.lit(0)), F.lit(100))).otherwise(0)
    return index.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("filing_count"),
        expected.cast("long").alias("expected_points"),
        indexed.cast("long").alias("indexed_points"),
        F.count_distinct(F.substring("filing_date", 1, 4)).alias("year_count"),
        progress.cast("int").alias("progress"),
        F.when(F.bool_and(F.col("status") == "ready"), "ready").otherwise("mixed").alias("state"),
    )


def ticker_sections(counts: DataFrame) -> DataFrame:
    """Per ticker its sections and chunk counts in order, from section_counts."""
    return counts.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("section_id", "chunk_count"))).alias("sections"))


def index_summary(index: DataFrame, listed: DataFrame) -> DataFrame:
    """One row of the index's four counters, from index_metadata and list_sources."""
    done = (F.col("status") == "ready") & (F.col("expected_point_count") > 0) & (F.col("indexed_point_count") >= F.col("expected_point_count"))
    filings = index.agg(F.count_if(done).alias("indexed_filing_count"))
    sources = listed.agg(
        F.count_if(eligible()).alias("approved_source_count"),
        F.count_if(F.col("discovery_status") == "candidate").alias("candidate_source_count"),
        F.coalesce(F.sum("document_count"), F.lit(0)).alias("document_count"),
    )
    both = filings.unionByName(sources, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))
