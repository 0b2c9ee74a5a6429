"""Schemas of the catalog's twelve relations and of what filings are parsed into."""

from __future__ import annotations

_STAMPS = "created_at timestamp, updated_at timestamp"

#: In this order a table comes after those that it refers to.
SCHEMAS = {
    "companies": f"id long, ticker string, name string, cik string, website_domain string, {_STAMPS}",
    "filings": f"id long, accession_number string, ticker string, cik string, company_name string, form_type string, filing_date string, period_of_report string, raw_path string, raw_sha256 string, clean_text_path string, {_STAMPS}",
    "sources": f"id long, url string, company_id long, name string, source_type string, ownership string, trust_level string, discovery_status string, enabled boolean, confidence_score double, discovery_reason string, {_STAMPS}",
    "documents": f"id long, source_id long, url string, title string, author string, published_at string, fetched_at timestamp, clean_text_path string, content_hash string, document_type string, metadata_json string, {_STAMPS}",
    "chunks": "id long, filing_id long, section_id string, section_title string, chunk_index int, text string, char_count int",
    "document_chunks": "id long, document_id long, chunk_index int, text string, char_count int",
    "chunk_embeddings": "chunk_id long, embedding_model string, vector_collection string, vector_id string, embedded_at timestamp",
    "document_chunk_embeddings": "document_chunk_id long, embedding_model string, vector_collection string, vector_id string, embedded_at timestamp",
    "embedding_runs": "filing_id long, embedding_model string, vector_collection string, status string, expected_point_count long, indexed_point_count long, error_message string, started_at timestamp, completed_at timestamp",
    "source_ingestion_runs": "id long, source_id long, status string, started_at timestamp, completed_at timestamp, discovered_count long, inserted_count long, skipped_count long, error_message string",
    "research_sessions": f"id long, session_key string, title string, metadata_json string, {_STAMPS}",
    "query_runs": f"id long, research_session_id long, question string, status string, planner_model string, answer_model string, embedding_model string, vector_collection string, planned_query_json string, retrieval_metadata_json string, answer_text string, error_message string, started_at timestamp, completed_at timestamp, {_STAMPS}",
}
#: Kept beside the relations: clean texts, what a cycle couldn't take in, and health and planner context as of some versions.
WORKING = {
    "clean_texts": "path string, text string",
    "_failures": "owner string, attempts int, next_at timestamp, dead boolean, error string, entry string",
    "_context": "versions string, ticker string, years array<int>, names array<string>, sections array<string>",
    "_health": "versions string, name string, expected long, ready long, records long, points long",
}
#: Natural keys.
KEYS = {
    "companies": ("ticker",),
    "filings": ("accession_number",),
    "chunks": ("filing_id", "section_id", "chunk_index"),
    "chunk_embeddings": ("chunk_id", "embedding_model", "vector_collection"),
    "embedding_runs": ("filing_id", "embedding_model", "vector_collection"),
    "sources": ("url",),
    "documents": ("source_id", "url"),
    "document_chunks": ("document_id", "chunk_index"),
    "document_chunk_embeddings": ("document_chunk_id", "embedding_model", "vector_collection"),
    "source_ingestion_runs": ("id",),
    "research_sessions": ("session_key",),
    "query_runs": ("id",),
    "clean_texts": ("path",),
    "_failures": ("owner",),
}
WITH_ID = tuple(name for name, schema in SCHEMAS.items() if schema.startswith("id "))
#: In this order bases are written, so that readers of a few owners skip most of a table.
CLUSTERED = {
    "filings": ("ticker", "accession_number"),
    "chunks": ("filing_id", "section_id", "chunk_index"),
    "documents": ("source_id", "url"),
    "document_chunks": ("document_id", "chunk_index"),
}
