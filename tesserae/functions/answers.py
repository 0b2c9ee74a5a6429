"""Labels, previews and extractive answers: column expressions over retrieved chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import single_line

QUOTE_CHARS, PREVIEW_CHARS = 500, 180


def source_label(index: Column, payload: Column) -> Column:
    """How an answer cites a chunk: by source, date and title, or by ticker, year and item."""
    date = F.coalesce(F.substring(payload["published_at"], 1, 10), F.lit("undated"))
    title = F.coalesce(F.nullif(payload["title"], F.lit("")), F.nullif(payload["url"], F.lit("")), F.lit("Untitled"))
    source = F.coalesce(F.nullif(payload["source_name"], F.lit("")), payload["ticker"], F.lit("Web document"))
    web = F.concat(F.lit("["), index.cast("string"), F.lit("] "), source, F.lit(", "), date, F.lit(', "'), title, F.lit('"'))
    head = F.substring(F.coalesce(payload["filing_date"], F.lit("")), 1, 4)
    year = F.when(head.rlike(r"^\d+$"), head).otherwise("unknown")
    form = F.when(F.coalesce(payload["form_type"], F.lit("")) != "", F.concat(F.lit(" "), payload["form_type"])).otherwise("")
    text = lambda c: F.coalesce(payload[c].cast("string"), F.lit("None"))
    filing = F.concat(F.lit("["), index.cast("string"), F.lit("] "), text("ticker"), F.lit(" "), year, form, F.lit(" Item "), text("section_id"), F.lit(" chunk "), text("chunk_index"))
    return F.when(payload["chunk_source"] == "document", web).otherwise(filing)


def quote(text: Column) -> Column:
    """A chunk's text on one line, cut to QUOTE_CHARS."""
    line = single_line(F.coalesce(text, F.lit("")))
    return F.when(F.length(line) > QUOTE_CHARS, F.concat(F.substring(line, 1, QUOTE_CHARS - 3), F.lit("..."))).otherwise(line)


def answer_preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    line = single_line(text)
    return F.when(F.length(line) > chars, F.concat(F.substring(line, 1, chars - 1), F.lit("..."))).otherwise(line)


# What is told of a chunk in an answer, of both corpora, then of each.
_OF_ALL = ("score", "chunk_source", "ticker", "company_name", "chunk_index")
_OF_DOCUMENTS = ("document_id", "document_chunk_id", "source_id", "source_name", "source_type", "ownership", "trust_level", "url", "title", "published_at", "document_type")
_OF_FILINGS = ("filing_date", "form_type", "section_id", "section_title", "accession_number")
_OF_SOURCES = (
    "label", "score", "chunk_source", "ticker", "company_name", "filing_date", "published_at", "section_id", "section_title", "chunk_index", "accession_number", "document_id", "source_id", "source_name", "source_type", "url", "title",
)


def evidence_metadata(payload: Column) -> Column:
    """JSON of what is told of a chunk: fields of its own corpus only, nulls included."""
    shape = lambda names: F.to_json(F.struct(*(payload[c].alias(c) for c in _OF_ALL + names)), {"ignoreNullFields": "false"})
    return F.when(payload["chunk_source"] == "document", shape(_OF_DOCUMENTS)).otherwise(shape(_OF_FILINGS))


def evidence(index: Column, payload: Column) -> Column:
    """struct(label, metadata, text) of a retrieved chunk."""
    return F.struct(source_label(index, payload).alias("label"), evidence_metadata(payload).alias("metadata"), F.coalesce(payload["text"], F.lit("")).alias("text"))


def source_chunk(index: Column, payload: Column, with_text: bool = False) -> Column:
    """struct of a chunk as a response names it, with its label; the text only where it is asked for."""
    fields = [source_label(index, payload).alias("label"), *(payload[c].alias(c) for c in _OF_SOURCES[1:])]
    return F.struct(*fields, *([payload["text"].alias("text")] if with_text else []))


def response_metadata(sources: Column, warnings: Column, used_fallback: Column, planner_error: Column) -> Column:
    """JSON that a query run keeps of its response: sources without texts, warnings, and whether the planner failed."""
    return F.to_json(F.struct(sources.alias("sources"), warnings.alias("warnings"), used_fallback.alias("used_fallback"), planner_error.alias("planner_error")), {"ignoreNullFields": "false"})


def no_evidence_answer(plan: Column, years: Column) -> Column:
    """Why there is no answer. years: map of ticker to its available years."""
    # The sentences.
    of = lambda t: F.coalesce(F.element_at(years, t), F.array().cast("array<int>"))
    listed = F.transform(plan["tickers"], lambda t: F.concat(t, F.lit(": "), F.when(F.size(of(t)) > 0, F.array_join(of(t).cast("array<string>"), ", ")).otherwise("no available filing years")))
    tickers = F.array_join(F.sort_array(F.map_keys(years)), ", ")
    absent = F.lit("The requested filing year is not available in the local filing index.")
    by_year = F.when(F.size(plan["tickers"]) == 0, absent).otherwise(F.concat(absent, F.lit(" Available filing years are "), F.array_join(listed, ", "), F.lit(".")))
    by_ticker = F.when(F.size(F.map_keys(years)) == 0, "No supported company ticker is available in the local filing index.").otherwise(
        F.concat(F.lit("I could not answer from the local SEC filing index because the question did not match an indexed company ticker. Available tickers are "), tickers, F.lit("."))
    )
    unavailable = (plan["time_scope"] == "specific_years") & (F.size(plan["filing_years"]) == 0)
    nothing = F.lit("I could not answer from the local SEC filing index because retrieval returned no matching chunks for the requested scope.")
    return F.when(unavailable, by_year).when(F.size(plan["tickers"]) == 0, by_ticker).otherwise(nothing)
