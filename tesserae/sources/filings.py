"""From filing submissions to sections and chunks: narrow maps over one row a filing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from . import submissions

# Sections in order, with their titles.
TITLES = {
    "1": "Business",
    "1A": "Risk Factors",
    "7": "Management's Discussion and Analysis",
    "7A": "Quantitative and Qualitative Disclosures About Market Risk",
}
LEAST_SECTION_CHARS = 1000


def scan(spark: SparkSession, raw_dir: str, ticker: str, form: str = "10-K", limit: int | None = None) -> DataFrame:
    """path, modificationTime, raw_sha256 and submission of downloaded filings, newest first."""
    glob = f"{raw_dir}/sec-edgar-filings/{ticker.upper()}/{form}/*/full-submission.txt"
    files = spark.read.format("binaryFile").load(glob).orderBy(F.desc("modificationTime"), "path")
    files = files if limit is None else files.limit(limit)
    return files.select("path", "modificationTime", F.sha2("content", 256).alias("raw_sha256"), F.decode("content", "UTF-8").alias("submission"))


def _last(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.nullif(t.strip(F.try_element_at(found, F.lit(-1))), F.lit(""))


def metadata(submission: Column) -> Column:
    """struct of the header's fields; the last one of a name counts."""
    head = F.regexp_extract(submission, r"(?is)<SEC-HEADER>(.*?)</SEC-HEADER>", 1)
    head = F.when(submission.rlike(r"(?is)<SEC-HEADER>.*?</SEC-HEADER>"), head).otherwise(F.substring(submission, 1, 20_000))
    field = lambda name: _last(head, rf"(?m)^[ \t]*{name.replace(' ', '[ \t]+')}[ \t]*:[ \t]*(\S.*?)\s*$")
    return F.struct(
        field("ACCESSION NUMBER").alias("accession_number"),
        field("CENTRAL INDEX KEY").alias("cik"),
        field("COMPANY CONFORMED NAME").alias("company_name"),
        F.coalesce(field("CONFORMED SUBMISSION TYPE"), field("FORM TYPE")).alias("form_type"),
        t.sec_date(field("FILED AS OF DATE")).alias("filing_date"),
        t.sec_date(field("CONFORMED PERIOD OF REPORT")).alias("period_of_report"),
    )


def _has_text(document: Column) -> Column:
    return document.rlike(r"(?is)<TEXT>.*?</TEXT>")


def document_fields(document: Column) -> Column:
    """struct(form_type, filename, description, text) of what is between a document's tags."""
    field = lambda name: _last(document, rf"(?im)^\s*<{name}>[ \t]*(.*)$")
    return F.struct(
        F.coalesce(field("TYPE"), F.lit("")).alias("form_type"),
        field("FILENAME").alias("filename"),
        field("DESCRIPTION").alias("description"),
        t.strip(F.regexp_extract(document, r"(?is)<TEXT>\s*(.*?)\s*</TEXT>", 1)).alias("text"),
    )


def documents(submission: Column) -> Column:
    """array of struct(form_type, filename, description, text); those without a text are left out."""
    raw = F.regexp_extract_all(submission, F.lit(r"(?is)<DOCUMENT>(.*?)</DOCUMENT>"), F.lit(1))
    return F.transform(F.filter(raw, _has_text), document_fields)


def primary_text(submission: Column, form: str = "10-K") -> Column:
    """Text of the first document of this form; the whole submission if it has no documents at all; else an error with the forms there are."""

    def of(docs: Column) -> Column:
        own = F.filter(docs, lambda d: F.upper(d["form_type"]) == form.upper())
        forms = F.array_join(F.transform(F.slice(docs, 1, 10), lambda d: d["form_type"]), ", ")
        error = F.raise_error(F.concat(F.lit(f"No {form} document found. Available document types: "), forms)).cast("string")
        return F.when(F.size(own) > 0, F.get(own, 0)["text"]).when(F.size(docs) > 0, error).otherwise(t.strip(submission))

    return t.bind(documents(submission), of)


def clean_text(submission: Column, form: str = "10-K") -> Column:
    return t.clean_filing_html(primary_text(submission, form))


def heading_sections(text: Column) -> Column:
    """array of struct(section_id, text) by `Item N.` headings: of an item's occurrences the longest, as a table of contents repeats them."""
    heading = r"(?im)^[ \t]*item[ \t]+(\d{1,2}[a-z]?)[ \t]*[.:\-]"
    ids = F.transform(F.regexp_extract_all(text, F.lit(heading), F.lit(1)), lambda x: F.upper(x))
    bodies = F.slice(F.split(text, heading, -1), F.lit(2), F.greatest(F.size(ids), F.lit(0)))
    found = F.arrays_zip(ids.alias("section_id"), F.transform(bodies, t.strip).alias("text"))

    def longest(item: str) -> Column:
        own = F.filter(found, lambda s: s["section_id"] == item)
        best = F.array_max(F.transform(own, lambda s: F.struct(F.length(s["text"]).alias("n"), s["text"].alias("text"))))
        return F.struct(F.lit(item).alias("section_id"), best["text"].alias("text"))

    return F.array(*map(longest, TITLES))


def sections(filings: DataFrame, least_chars: int = LEAST_SECTION_CHARS) -> DataFrame:
    """filing key, section_id, section_title and text of filings(accession_number, html, text).

    What a cross-reference index says of an item goes before the item's heading; short sections are left out.
    """
    titles = F.create_map(*(F.lit(x) for pair in TITLES.items() for x in pair))
    by_heading = filings.select("accession_number", F.explode(heading_sections(F.col("text"))).alias("s")).select("accession_number", "s.section_id", F.col("s.text").alias("by_heading"))
    indexed = filings.select("accession_number", F.explode(t.in_small_batches(t.indexed_items, F.col("html"))).alias("i"))
    indexed = indexed.select("accession_number", F.col("i.item").alias("section_id"), t.clean_filing_html(F.col("i.html")).alias("by_index")).where(F.length("by_index") >= least_chars)
    joined = by_heading.join(indexed, ["accession_number", "section_id"], "left").withColumn("text", F.coalesce("by_index", "by_heading"))
    return joined.where(F.length("text") >= least_chars).select("accession_number", "section_id", F.element_at(titles, F.col("section_id")).alias("section_title"), "text")


def chunk_sections(found: DataFrame, size: int = 4000, overlap: int = 500) -> DataFrame:
    """accession_number, section_id, section_title, chunk_index, text and char_count, numbered from 0 in each section."""
    cut = found.select("accession_number", "section_id", "section_title", F.posexplode(t.chunks(F.col("text"), size, overlap)).alias("chunk_index", "text"))
    return cut.withColumn("char_count", F.length("text"))


def ingest(scanned: DataFrame, form: str = "10-K") -> DataFrame:
    """One row a filing: header fields, hash, path, primary HTML and clean text; the folder's name where the header has no accession number."""
    return _filings(scanned.withColumn("html", primary_text(F.col("submission"), form)), form)


def _filings(found: DataFrame, form: str, *more: str) -> DataFrame:
    m = found.withColumn("m", metadata(F.col("submission")))
    folder = F.try_element_at(F.split("path", "/"), F.lit(-2))
    return m.select(
        F.coalesce("m.accession_number", folder).alias("accession_number"),
        "m.cik",
        "m.company_name",
        F.coalesce("m.form_type", F.lit(form)).alias("form_type"),
        "m.filing_date",
        "m.period_of_report",
        F.col("path").alias("raw_path"),
        "raw_sha256",
        "html",
        t.clean_filing_html(F.col("html")).alias("text"),
        *more,
    )


def source(spark: SparkSession, stream: bool = False, **options) -> DataFrame:
    """Rows of the data source of submissions (its options are told there), as a batch or a stream."""
    spark.dataSource.register(submissions.Submissions)
    reader = spark.readStream if stream else spark.read
    return reader.format("submissions").options(**options).load()


def source_documents(rows: DataFrame) -> DataFrame:
    """path, position, accession_number, form_type, filename, description and text of the documents among rows of the data source; those without a text are left out."""
    own = rows.where(F.col("position").isNotNull() & _has_text(F.col("document"))).withColumn("d", document_fields(F.col("document")))
    return own.select("path", "position", metadata(F.col("header"))["accession_number"].alias("accession_number"), "d.*")


def ingest_source(rows: DataFrame, form: str = "10-K") -> DataFrame:
    """As ingest() gives them, filings of rows of the data source with `files`: each filing's documents meet, but only the main one's text moves.

    `error` tells of a filing with documents of which none has this form, with the forms there are; it has no text.
    """
    rows = rows.withColumn("d", F.when(F.col("position").isNotNull() & _has_text(F.col("document")), document_fields(F.col("document"))))
    ours = F.upper("d.form_type") == form.upper()
    rows = rows.select(
        "path",
        F.when(F.col("position").isNull(), F.struct(F.col("header").alias("header"), F.col("raw_sha256").alias("raw_sha256"), t.strip(F.col("document")).alias("whole"))).alias("file"),
        F.when(ours, F.struct("position", F.col("d.text").alias("text"))).alias("main"),
        F.when(F.col("d").isNotNull(), F.struct("position", "d.form_type")).alias("told"),
    )
    met = rows.groupBy("path").agg(F.max("file").alias("file"), F.min("main").alias("main"), F.sort_array(F.collect_list("told")).alias("told"))
    forms = F.array_join(F.transform(F.slice("told", 1, 10), lambda d: d["form_type"]), ", ")
    none = F.col("main").isNull() & (F.size("told") > 0)
    error = F.when(none, F.concat(F.lit(f"No {form} document found. Available document types: "), forms))
    html = F.when(F.col("main").isNotNull(), F.col("main.text")).when(~none, F.col("file.whole"))
    found = met.select("path", F.col("file.raw_sha256").alias("raw_sha256"), F.col("file.header").alias("submission"), html.alias("html"), error.alias("error"))
    return _filings(found, form, "error")
