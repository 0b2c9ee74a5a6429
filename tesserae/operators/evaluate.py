"""Evaluators: what differs between expected and actual plans, scopes and answers, per case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _differs(a: Column, b: Column) -> Column:
    """Arrays differ as sets."""
    return (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)


def compare_plans(expected: DataFrame, actual: DataFrame, sets: tuple[str, ...] = ("tickers", "sections", "filing_years"), scalars: tuple[str, ...] = ("time_scope", "intent")) -> DataFrame:
    """id and `failures`, the fields in which the plans of a case differ; a case without an actual plan fails as a whole."""
    joined = expected.alias("e").join(actual.withColumn("_made", F.lit(True)).alias("a"), "id", "left")
    none = lambda s, f: F.coalesce(F.col(f"{s}.{f}"), F.array().cast("array<string>"))
    tests = [F.when(_differs(none("e", f).cast("array<string>"), none("a", f).cast("array<string>")), f) for f in sets]
    tests += [F.when(~F.col(f"e.{f}").eqNullSafe(F.col(f"a.{f}")), f) for f in scalars]
    return joined.select("id", F.when(F.col("_made").isNull(), F.array(F.lit("missing"))).otherwise(F.array_compact(F.array(*tests))).alias("failures"))


def evaluate_plans(cases: DataFrame) -> DataFrame:
    """id and failures of cases(id, question, context, expected): the rules' plan of each question against the expected one."""
    from ..functions import planner

    fields = ("tickers", "sections", "time_scope", "intent", "filing_years")
    actual = cases.select("id", F.explode(F.array(planner.local_plan(F.col("question"), F.col("context")))).alias("p")).select("id", *(F.col(f"p.{f}").alias(f) for f in fields))
    return compare_plans(cases.select("id", *(F.col(f"expected.{f}").alias(f) for f in fields)), actual)


def scope_failures(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """id with missing tickers and years, and the number of hits outside the expected scope.

    expected(id, tickers, sections, years, intent, time_scope); hits(id, ticker, section_id, filing_date).
    """
    year = F.substring("filing_date", 1, 4).try_cast("int")
    found = hits.groupBy("id").agg(F.collect_set("ticker").alias("_tickers"), F.collect_set(year).alias("_years"), F.count(F.lit(1)).alias("hit_count"))
    wanted = expected.select("id", "tickers", "sections", "years", "time_scope")
    outside = hits.join(wanted, "id").where(
        ((F.size("tickers") > 0) & ~F.array_contains("tickers", F.col("ticker")))
        | ((F.size("sections") > 0) & ~F.coalesce(F.array_contains("sections", F.col("section_id")), F.lit(False)))
        | ((F.col("time_scope") == "specific_years") & ~F.coalesce(F.array_contains("years", year), F.lit(False)))
    )
    outside = outside.groupBy("id").agg(F.count(F.lit(1)).alias("outside_count"))
    joined = expected.join(found, "id", "left").join(outside, "id", "left")
    tickers, years = F.coalesce("_tickers", F.array().cast("array<string>")), F.coalesce("_years", F.array().cast("array<int>"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    by_year = (F.col("intent") == "trend") | F.col("time_scope").isin("all_available", "latest_and_previous")
    return joined.select(
        "id",
        F.coalesce("hit_count", F.lit(0)).alias("hit_count"),
        F.when(F.col("intent") == "comparison", F.sort_array(F.array_except("tickers", tickers))).otherwise(none("string")).alias("missing_tickers"),
        F.when(by_year, F.sort_array(F.array_except("years", years))).otherwise(none("int")).alias("missing_years"),
        F.coalesce("outside_count", F.lit(0)).alias("outside_count"),
    )


def answer_failures(answer: Column, has_chunks: Column, tickers: Column, years: Column, intent: Column, unavailable: Column) -> Column:
    """What an answer lacks: citations, compared tickers, the trend's years, or the reason for having no data."""
    absent = F.array_compact(F.array(F.when(has_chunks, "retrieved chunks"), F.when(~F.contains(F.lower(answer), F.lit("not available")), "missing data not explained")))
    cited = F.when(has_chunks & ~answer.rlike(r"\[\d+\]"), "no citation labels")
    compared = F.when((intent == "comparison") & ~F.forall(tickers, lambda t: F.contains(F.upper(answer), t)), "comparison tickers")
    trend = F.when((intent == "trend") & ~F.forall(years, lambda y: F.contains(answer, y.cast("string"))), "trend years")
    return F.when(unavailable, absent).otherwise(F.array_compact(F.array(cited, compared, trend)))


def case_scopes(cases: DataFrame, ready: DataFrame) -> DataFrame:
    """cases(case, tickers, time_scope, filing_years, ...) with accessions, by_ticker and years: the ready filings in each one's scope.

    ready(ticker, accession_number, filing_date). A case's tickers are few; each meets the filings of its own ticker only.
    """
    from ..functions import planner

    year = F.substring("filing_date", 1, 4).try_cast("int")
    filings = ready.groupBy("ticker").agg(F.sort_array(F.collect_set(F.struct("accession_number", year.alias("year")))).alias("filings"))
    each = cases.select("case", "time_scope", "filing_years", F.explode(F.array_distinct("tickers")).alias("ticker")).join(filings, "ticker", "left")
    own = F.coalesce("filings", F.array().cast("array<struct<accession_number:string,year:int>>"))
    taken = planner.scope_years(F.col("time_scope"), F.col("filing_years"), F.array_distinct(F.transform(own, lambda f: f["year"])))
    each = each.select("case", "ticker", F.filter(own, lambda f: F.array_contains(taken, f["year"])).alias("own"))
    scopes = each.groupBy("case").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("ticker", F.transform("own", lambda f: f["accession_number"]).alias("accessions"))))).alias("by_ticker"),
        F.flatten(F.collect_list("own")).alias("_all"),
    )
    none = lambda t: F.array().cast(f"array<{t}>")
    return cases.join(scopes, "case", "left").select(
        *cases.columns,
        F.coalesce(F.sort_array(F.array_distinct(F.transform("_all", lambda f: f["accession_number"]))), none("string")).alias("accessions"),
        F.coalesce("by_ticker", F.create_map().cast("map<string,array<string>>")).alias("by_ticker"),
        F.coalesce(F.sort_array(F.array_distinct(F.transform("_all", lambda f: f["year"]))), none("int")).alias("years"),
    )


def evaluate_retrieval(cases: DataFrame, vectors: DataFrame, ready: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts and hits of all cases at once: case, out_of_scope (no ready filing, though some are expected), hit_count, missing_tickers, missing_years and outside_count of each.

    cases(case, query, limit, tickers, sections, intent, time_scope, filing_years). A case that asks for years of which
    none is given expects nothing and passes.
    """
    from . import vectors as v

    scoped = case_scopes(cases, ready)
    nothing = F.size("accessions") == 0
    hits = v.retrieve_many(vectors, scoped.where(~nothing), [c for c in vectors.columns if c != "vector"])
    dated = hits if "filing_date" in hits.columns else hits.join(ready.select("accession_number", "filing_date").distinct(), "accession_number", "left")
    told = scope_failures(scoped.where(~nothing).select(F.col("case").alias("id"), "tickers", "sections", "years", "intent", "time_scope"), dated.select(F.col("case").alias("id"), "ticker", "section_id", "filing_date"))
    absent = nothing & ~((F.col("time_scope") == "specific_years") & (F.size("filing_years") == 0))
    none = lambda t: F.array().cast(f"array<{t}>")
    joined = scoped.select("case", absent.alias("out_of_scope")).join(told.withColumnRenamed("id", "case"), "case", "left")
    verdicts = joined.select(
        "case", "out_of_scope", F.coalesce("hit_count", F.lit(0)).alias("hit_count"), F.coalesce("missing_tickers", none("string")).alias("missing_tickers"),
        F.coalesce("missing_years", none("int")).alias("missing_years"), F.coalesce("outside_count", F.lit(0)).alias("outside_count"),
    )
    return verdicts, dated


def extractive_answers(cases: DataFrame, hits: DataFrame, label: Column, years: Column) -> DataFrame:
    """case, answer and hit_count: each case's quotes under their labels, the best first, or why there are none.

    hits(case, score, id, text, ...); label is of a hit numbered `i` in its case; years is a map of ticker to available years, of cases' columns.
    """
    from ..functions import answers as a

    numbered = hits.withColumn("i", F.row_number().over(Window.partitionBy("case").orderBy(F.desc("score"), F.asc("id"))))
    lines = numbered.select("case", F.struct("i", F.concat(label, F.lit(": "), a.quote(F.col("text"))).alias("line")).alias("x")).groupBy("case").agg(F.sort_array(F.collect_list("x")).alias("x"))
    plan = F.struct("tickers", "time_scope", "filing_years")
    # Fixed value: the heading.
    found = F.concat(F.lit("Retrieved evidence:\n"), F.array_join(F.transform("x", lambda x: x["line"]), "\n"))
    return cases.join(lines, "case", "left").select("case", F.when(F.col("x").isNotNull(), found).otherwise(a.no_evidence_answer(plan, years)).alias("answer"), F.coalesce(F.size("x"), F.lit(0)).alias("hit_count"))


def evaluate_answers(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """case and failures of each answer: what answer_failures() finds lacking. cases(case, tickers, years, intent, time_scope, filing_years)."""
    unavailable = (F.col("time_scope") == "specific_years") & (F.size("filing_years") == 0)
    joined = cases.join(answers, "case")
    return joined.select("case", answer_failures(F.col("answer"), F.col("hit_count") > 0, F.col("tickers"), F.col("years"), F.col("intent"), unavailable).alias("failures"))
