"""Registered readers of filing submissions, over submissions made of the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as t
from ..sources import filings
from ..sources.shared import shared_dir
from .domain import Domain
from .registry import query

#: The text of a submission's main document: of every document its words, without marks that HTML or the reader would change.
_BODY = "regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g')"


def _submissions(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    body = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " ")
    head = F.concat(
        F.lit("<SEC-HEADER>\nACCESSION NUMBER:\told\nACCESSION NUMBER:\t\tacc-"), key, F.lit("\nCONFORMED SUBMISSION TYPE:\t10-K\nCONFORMED PERIOD OF REPORT:\t20260125\nFILED AS OF DATE:\t\t2026"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"),
        F.lit("15\nCENTRAL INDEX KEY:\t\t"), key, F.lit("\nCOMPANY CONFORMED NAME:\t Name "), F.coalesce("source", F.lit("none")), F.lit(" \n</SEC-HEADER>\n"),
    )
    docs = F.concat(F.lit("<DOCUMENT>\n<TYPE>EX-1\n<DESCRIPTION>first\n<DESCRIPTION>last\n<TEXT>other</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>GRAPHIC\n</DOCUMENT>\n<document>\n<type>10-k\n<FILENAME>f"), key, F.lit(".htm\n<TEXT>\n"), body, F.lit("\n</TEXT>\n</document>"))
    return Domain(spark, sf_dir).table("documents").select("doc_id", body.alias("body"), F.concat(head, docs).alias("submission"))


@query("SELECT doc_id, 'acc-' || doc_id AS accession_number, CAST(doc_id AS VARCHAR) AS cik, 'Name ' || coalesce(source, 'none') AS company_name, '10-K' AS form_type, '2026-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-15' AS filing_date, '2026-01-25' AS period_of_report FROM documents")
def submission_metadata(spark, sf_dir):
    """Header fields of submissions; of fields told twice the last counts."""
    return _submissions(spark, sf_dir).select("doc_id", filings.metadata(F.col("submission")).alias("m")).select("doc_id", "m.*")


@query(f"SELECT doc_id, unnest([0, 1]) AS k, unnest(['EX-1', '10-k']) AS form_type, unnest([NULL, 'f' || doc_id || '.htm']) AS filename, unnest(['last', NULL]) AS description, unnest([sha256('other'), sha256(trim({_BODY}))]) AS text FROM documents")
def submission_documents(spark, sf_dir):
    """Documents of submissions in order; one without a text is left out."""
    found = _submissions(spark, sf_dir).select("doc_id", F.posexplode(filings.documents(F.col("submission"))).alias("k", "d"))
    return found.select("doc_id", "k", "d.form_type", "d.filename", "d.description", F.sha2("d.text", 256).alias("text"))


@query(f"SELECT doc_id, sha256(trim({_BODY})) AS text, sha256(trim({_BODY})) AS clean FROM documents")
def primary_document(spark, sf_dir):
    """The main document's text, by its form in any case, and cleaned."""
    text = filings.primary_text(F.col("submission"))
    return _submissions(spark, sf_dir).select("doc_id", F.sha2(text, 256).alias("text"), F.sha2(filings.clean_text(F.col("submission")), 256).alias("clean"))


@query(f"""SELECT doc_id, section_id, title AS section_title, sha256(trim('about ' || section_id || ' ' || b)) AS text FROM (SELECT doc_id, trim({_BODY}) AS b FROM documents), (VALUES ('1', 'Business'), ('1A', 'Risk Factors'), ('7A', 'Quantitative and Qualitative Disclosures About Market Risk')) s(section_id, title) WHERE length('about ' || section_id || ' ' || b) >= 1000""")
def filing_sections(spark, sf_dir):
    """Sections by their headings: of an item's occurrences the longest, short ones left out, other items not taken."""
    part = lambda item: F.concat(F.lit(f"\n\nItem {item}. about {item} "), F.trim("body"))
    text = F.concat(F.lit("Item 1. Business\nItem 1A. Risk Factors\nItem 7A: more"), part("1"), part("1A"), part("2"), part("7A"))
    read = _submissions(spark, sf_dir).select(F.col("doc_id").cast("string").alias("accession_number"), F.lit("<p>no index</p>").alias("html"), text.alias("text"))
    return filings.sections(read).select(F.col("accession_number").cast("long").alias("doc_id"), "section_id", "section_title", F.sha2("text", 256).alias("text"))


_SOURCE_SQL = f"SELECT doc_id, unnest(['EX-1', '10-k']) AS form_type, unnest(['e', 'f']) || doc_id || '.htm' AS filename, unnest(['first', NULL]) AS description, unnest([sha256('a <DOCUMENT> of ' || doc_id), sha256(trim({_BODY}))]) AS text FROM documents"


def _written(spark, sf_dir):
    """Two documents of each of the table's, as lines of text for files of very many of them; one names a document's tag in its text."""
    key, body = F.col("doc_id").cast("string"), F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " ")
    first = F.concat(F.lit("<DOCUMENT>\n<TYPE>EX-1\n<FILENAME>e"), key, F.lit(".htm\n<DESCRIPTION>first\n<TEXT>\na <DOCUMENT> of "), key, F.lit("\n</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>GRAPHIC\n</DOCUMENT>\n"))
    second = F.concat(F.lit("<document>\n<type>10-k\n<FILENAME>f"), key, F.lit(".htm\n<TEXT>\n"), body, F.lit("\n</TEXT>\n</document>"))
    return Domain(spark, sf_dir).table("documents").select("doc_id", F.concat(first, second).alias("value"))


def _read(rows):
    found = filings.source_documents(rows)
    return found.select(F.regexp_extract("filename", r"(\d+)", 1).cast("long").alias("doc_id"), "form_type", "filename", "description", F.sha2("text", 256).alias("text"))


@query(_SOURCE_SQL)
def submission_source(spark, sf_dir):
    """Documents from large files, cut into splits that begin and end inside them."""
    root = f"{shared_dir(spark)}/submissions-{uuid.uuid4().hex}"
    _written(spark, sf_dir).select("value").write.text(root)
    return _read(filings.source(spark, path=root, name="part-*.txt", split_bytes=100_000))


@query(_SOURCE_SQL)
def submission_stream(spark, sf_dir):
    """The same files in three deliveries, by a stream that is started anew for each and goes on where it ended."""
    root = f"{shared_dir(spark)}/submissions-{uuid.uuid4().hex}"
    written = _written(spark, sf_dir)
    for k in range(3):
        written.where(F.col("doc_id") % 3 == k).select("value").write.mode("append").text(f"{root}/in")
        rows = filings.source(spark, stream=True, path=f"{root}/in", name="part-*.txt", split_bytes=1_000_000, settle_seconds=0)
        _read(rows).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query(r"""SELECT doc_id, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS line FROM documents""")
def strip_text(spark, sf_dir):
    return Domain(spark, sf_dir).table("documents").select("doc_id", t.strip_text(F.col("text")).alias("line"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS moment FROM events")
def entry_datetime(spark, sf_dir):
    return Domain(spark, sf_dir).table("events").select("event_id", t.entry_datetime(F.col("ts")).alias("moment"))
