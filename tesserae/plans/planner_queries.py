"""Registered planner rules, over every whole text of the conversations as a question."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import planner as p
from ..operators import evaluate, relational
from .domain import COLLECTION, MODEL, Domain, sql
from .registry import query

# Words of the rules are mixed into the texts, so that all rules have work.
_PHRASES = (
    "latest risk factors", "compare revenue versus margins", "how did it change over time from 2021 to 2023", "item 7A", "business overview in 2022", "oldest filing", "what revenue was reported",
    "interest rate and risks", "previous year liquidity", "item 12", "their business",
)
_LIST = "[" + ", ".join(f"'{x}'" for x in _PHRASES) + "]"
_Q = f"(SELECT conv_id, turn, lower(coalesce(text || ' ', '') || {_LIST}[CAST((conv_id + turn) % {len(_PHRASES)} AS INT) + 1]) AS q FROM conversations)"


def _or(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _questions(spark, sf_dir):
    phrase = F.get(F.array(*map(F.lit, _PHRASES)), ((F.col("conv_id") + F.col("turn")) % len(_PHRASES)).cast("int"))
    return Domain(spark, sf_dir).table("conversations").select("conv_id", "turn", F.concat_ws(" ", "text", phrase).alias("q"))


def _context():
    years = F.create_map(F.lit("NVDA"), F.array(*map(F.lit, (2023, 2022, 2021))), F.lit("AMD"), F.array(F.lit(2022)))
    names = F.create_map(F.lit("NVDA"), F.array(F.lit("NVIDIA CORP")), F.lit("AMD"), F.array(F.lit("ADVANCED MICRO DEVICES INC")))
    return F.struct(F.array(F.lit("AMD"), F.lit("NVDA")).alias("tickers"), F.array(*map(F.lit, p.SECTIONS)).alias("sections"), years.alias("years"), names.alias("names"))


def _named(spark, sf_dir):
    """The questions, two thirds of them with a company in it."""
    return _questions(spark, sf_dir).withColumn("q", F.concat("q", F.when(F.col("turn") % 3 == 0, " for Nvidia").when(F.col("turn") % 3 == 1, " (AMD)").otherwise("")))


_SPAN = r"'\b(20\d\d)\b\s+(?:and|to|-|through)\s+\b(20\d\d)\b'"
_Y1, _Y2 = (f"CAST(regexp_extract(q, {_SPAN}, {k}) AS INT)" for k in (1, 2))


@query(rf"""SELECT conv_id, turn, CASE WHEN regexp_matches(q, 'oldest|earliest') THEN '2020' WHEN regexp_matches(q, '\b20\d\d\b\s+(and|to|-|through)\s+\b20\d\d\b') THEN array_to_string(range(least({_Y1}, {_Y2}), greatest({_Y1}, {_Y2}) + 1), ',') ELSE array_to_string(list_filter(y, lambda x, i: NOT list_contains(list_slice(y, 1, i - 1), x)), ',') END AS years FROM (SELECT *, regexp_extract_all(q, '\b(20\d\d)\b', 1) AS y FROM {_Q})""")
def infer_years(spark, sf_dir):
    years = p.infer_years(F.col("q"), F.array(F.lit(2023), F.lit(2020)))
    return _questions(spark, sf_dir).select("conv_id", "turn", F.array_join(years.cast("array<string>"), ",").alias("years"))


_INTENT = f"CASE WHEN {_or('q', p.FACT)} THEN 'fact' WHEN {_or('q', p.TREND)} THEN 'trend' WHEN {_or('q', p.COMPARISON)} THEN 'comparison' ELSE 'summary' END"


@query(f"SELECT conv_id, turn, {_INTENT} AS intent FROM {_Q}")
def infer_intent(spark, sf_dir):
    return _questions(spark, sf_dir).select("conv_id", "turn", p.infer_intent(F.col("q")).alias("intent"))


@query(rf"""SELECT conv_id, turn, CASE WHEN {_or('q', p.OLDEST)} OR regexp_matches(q, '\b20\d\d\b') THEN 'specific_years' WHEN ({_INTENT}) = 'trend' THEN 'all_available' WHEN {_or('q', p.PREVIOUS)} THEN 'latest_and_previous' ELSE 'latest' END AS time_scope FROM {_Q}""")
def infer_time_scope(spark, sf_dir):
    return _questions(spark, sf_dir).select("conv_id", "turn", p.infer_time_scope(F.col("q")).alias("time_scope"))


@query(rf"""SELECT conv_id, turn, CASE WHEN item <> '' THEN CASE WHEN upper(item) IN ('1', '1A', '7', '7A') THEN upper(item) ELSE '' END WHEN len(f) > 0 THEN array_to_string(f, ',') WHEN contains(q, 'business') THEN '1' END AS sections FROM
  (SELECT conv_id, turn, q, regexp_extract(q, '\bitem\s+(\d+[a-z]?)\b', 1) AS item, list_filter([CASE WHEN {_or('q', p.BUSINESS)} THEN '1' END, CASE WHEN {_or('q', p.MARKET_RISK)} THEN '7A' END,
   CASE WHEN contains(q, 'risk factor') OR (contains(q, 'risks') AND NOT {_or('q', p.MARKET_RISK)}) THEN '1A' END, CASE WHEN {_or('q', p.MANAGEMENT)} THEN '7' END], lambda x: x IS NOT NULL) AS f FROM {_Q})""")
def infer_sections(spark, sf_dir):
    return _questions(spark, sf_dir).select("conv_id", "turn", F.array_join(p.infer_sections(F.col("q")), ",").alias("sections"))


@query("""SELECT o_custkey, scope, array_to_string(CASE scope WHEN 'latest' THEN list_slice(y, 1, 1) WHEN 'latest_and_previous' THEN list_slice(y, 1, 2) WHEN 'specific_years' THEN list_filter([1996, 1999], lambda x: list_contains(y, x)) ELSE y END, ',') AS years
  FROM (SELECT o_custkey, list_sort(list(DISTINCT year(o_orderdate)), 'DESC') AS y FROM orders GROUP BY 1), (SELECT unnest(['latest', 'latest_and_previous', 'specific_years', 'all_available']) AS scope)""")
def scope_years(spark, sf_dir):
    """Of each customer's years those that each time scope takes."""
    years = Domain(spark, sf_dir).table("orders").groupBy("o_custkey").agg(F.collect_set(F.year("o_orderdate")).alias("y"))
    scopes = F.array(*map(F.lit, ("latest", "latest_and_previous", "specific_years", "all_available")))
    taken = p.scope_years(F.col("scope"), F.array(F.lit(1996), F.lit(1999)), F.col("y"))
    return years.withColumn("scope", F.explode(scopes)).select("o_custkey", "scope", F.array_join(taken.cast("array<string>"), ",").alias("years"))


_N = rf"(SELECT conv_id, turn, q || CASE turn % 3 WHEN 0 THEN ' for nvidia' WHEN 1 THEN ' (amd)' ELSE '' END AS q FROM {_Q})"
_M = r"' ' || trim(regexp_replace(q, '[^a-z0-9]+', ' ', 'g')) || ' '"
_CONTEXT_SQL = rf"""a AS (SELECT conv_id, turn, q, {_M} AS m, {_INTENT} AS intent, regexp_extract_all(q, '\b(20\d\d)\b', 1) AS y, {_or('q', p.OLDEST)} AS oldest, regexp_matches(q, {_SPAN}) AS spans, regexp_extract(q, '\bitem\s+(\d+[a-z]?)\b', 1) AS item,
   list_filter([CASE WHEN {_or('q', p.BUSINESS)} THEN '1' END, CASE WHEN {_or('q', p.MARKET_RISK)} THEN '7A' END, CASE WHEN contains(q, 'risk factor') OR (contains(q, 'risks') AND NOT {_or('q', p.MARKET_RISK)}) THEN '1A' END,
   CASE WHEN {_or('q', p.MANAGEMENT)} THEN '7' END], lambda x: x IS NOT NULL) AS f FROM {_N}),
  b AS (SELECT *, list_filter(['AMD', 'NVDA'], lambda t: contains(m, ' ' || lower(t) || ' ') OR contains(trim(m), CASE t WHEN 'AMD' THEN 'advanced micro devices' ELSE 'nvidia' END)) AS tickers FROM a),
  c AS (SELECT *, list_filter([2021, 2022, 2023], lambda v: len(tickers) = 0 OR list_contains(tickers, 'NVDA') OR v = 2022) AS have FROM b),
  d AS (SELECT *, CASE WHEN oldest THEN [list_min(have)] WHEN spans THEN range(least({_Y1}, {_Y2}), greatest({_Y1}, {_Y2}) + 1) ELSE list_transform(list_filter(y, lambda x, i: NOT list_contains(list_slice(y, 1, i - 1), x)), lambda x: CAST(x AS INT)) END AS years FROM c)"""


@query(rf"""WITH {_CONTEXT_SQL} SELECT conv_id, turn, array_to_string(tickers, ',') AS tickers,
  array_to_string(CASE WHEN item <> '' THEN list_filter([upper(item)], lambda x: x IN ('1', '1A', '7', '7A')) WHEN len(f) > 0 THEN f WHEN contains(q, 'business') THEN ['1'] ELSE [] END, ',') AS sections,
  CASE WHEN len(years) > 0 THEN 'specific_years' WHEN intent = 'trend' THEN 'all_available' WHEN {_or('q', p.PREVIOUS)} THEN 'latest_and_previous' ELSE 'latest' END AS time_scope, intent,
  array_to_string(list_filter(years, lambda v: list_contains(have, v)), ',') AS years FROM d""")
def local_plans(spark, sf_dir):
    """A plan for every question by the rules alone."""
    planned = _named(spark, sf_dir).withColumn("context", _context()).select("conv_id", "turn", p.local_plan(F.col("q"), F.col("context")).alias("p"))
    return planned.select("conv_id", "turn", F.array_join("p.tickers", ",").alias("tickers"), F.array_join("p.sections", ",").alias("sections"), "p.time_scope", "p.intent", F.array_join(F.col("p.filing_years").cast("array<string>"), ",").alias("years"))


@query(rf"WITH {_CONTEXT_SQL} SELECT conv_id, turn, array_to_string(tickers, ',') AS tickers, array_to_string(list_sort(have), ',') AS years FROM d")
def question_tickers(spark, sf_dir):
    """Tickers that questions name, and the years that these have."""
    made = _named(spark, sf_dir).withColumn("context", _context()).withColumn("t", p.infer_tickers(F.col("q"), F.col("context")))
    years = F.sort_array(p.available_years(F.col("t"), F.col("context.years")))
    return made.select("conv_id", "turn", F.array_join("t", ",").alias("tickers"), F.array_join(years.cast("array<string>"), ",").alias("years"))


@query(rf"""WITH {_CONTEXT_SQL} SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'NVDA' ELSE '' END AS tickers, array_to_string(CASE WHEN item <> '' THEN list_filter([upper(item)], lambda x: x IN ('1', '1A', '7', '7A')) WHEN len(f) > 0 THEN f WHEN contains(q, 'business') THEN ['1'] ELSE ['7A'] END, ',') AS sections,
  CASE WHEN oldest OR len(y) > 0 THEN 'specific_years' WHEN turn % 2 = 0 THEN 'all_available' ELSE 'latest' END AS time_scope, CASE WHEN oldest OR len(y) > 0 THEN '2022' ELSE '' END AS years, CASE WHEN {_or('q', p.FACT)} THEN 'fact' WHEN turn % 2 = 0 THEN 'trend' ELSE 'summary' END AS intent, 20 AS top_k, 4 AS queries FROM d""")
def normalize_plan(spark, sf_dir):
    """Plans of a careless planner made to fit the context: unknown tickers, sections and years go, limits hold, the question comes first."""
    even = F.col("turn") % 2 == 0
    text = lambda *xs: F.array(*map(F.lit, xs))
    given = F.struct(
        F.when(even, text("nvda", "XYZ", "NVDA")).otherwise(text("xyz")).alias("tickers"), text("7A", "9").alias("sections"), text("a", "b", "", "a", "c", "d").alias("semantic_queries"), F.lit("specific_years").alias("time_scope"),
        F.array(F.lit(2022), F.lit(1999)).alias("filing_years"), F.lit(99).alias("top_k"), F.when(even, "trend").otherwise("summary").alias("intent"),
    )
    made = _named(spark, sf_dir).select("conv_id", "turn", p.normalize_plan(F.col("q"), given, _context()).alias("p"))
    join = lambda c: F.array_join(F.col(f"p.{c}").cast("array<string>"), ",")
    return made.select("conv_id", "turn", join("tickers").alias("tickers"), join("sections").alias("sections"), "p.time_scope", join("filing_years").alias("years"), "p.intent", "p.top_k", F.size("p.semantic_queries").alias("queries"))


@query("SELECT conv_id, turn, sha256(trim(text || ' asked')) AS query, 'latest' AS time_scope, 'summary' AS intent, 5 AS top_k, 0 AS scope FROM conversations")
def fallback_plan(spark, sf_dir):
    """The plan where a planner failed."""
    made = Domain(spark, sf_dir).table("conversations").select("conv_id", "turn", p.fallback_plan(F.concat("text", F.lit(" asked"))).alias("p"))
    scope = F.size("p.tickers") + F.size("p.sections") + F.size("p.filing_years")
    return made.select("conv_id", "turn", F.sha2(F.col("p.semantic_queries")[0], 256).alias("query"), "p.time_scope", "p.intent", "p.top_k", scope.alias("scope"))


@query(sql("""{T} , r AS (SELECT ticker, accession_number, CAST(substr(filing_date, 1, 4) AS INT) AS year FROM filings WHERE id IN (SELECT filing_id FROM embedding_runs WHERE status = 'ready')),
  k AS (SELECT *, dense_rank() OVER (PARTITION BY ticker ORDER BY year DESC) AS k FROM r) SELECT ticker, accession_number, year FROM k WHERE k <= 2"""))
def accessions_in_scope(spark, sf_dir):
    """Ready filings of the latest and the previous year of each ticker."""
    d = Domain(spark, sf_dir)
    ready = relational.ready_accessions(d.filings, d.embedding_runs, MODEL, COLLECTION)
    return relational.accessions_in_scope(ready, F.lit("latest_and_previous"), F.array().cast("array<int>"))


@query(rf"""WITH {_CONTEXT_SQL} SELECT conv_id * 1000 + turn AS id, concat_ws(',', CASE WHEN len(tickers) <> 1 OR tickers[1] <> 'AMD' THEN 'tickers' END,
  CASE WHEN len(years) = 0 THEN CASE WHEN (CASE WHEN intent = 'trend' THEN 'all_available' WHEN {_or('q', p.PREVIOUS)} THEN 'latest_and_previous' ELSE 'latest' END) <> 'latest' THEN 'time_scope' END ELSE 'time_scope' END,
  CASE WHEN intent <> 'summary' THEN 'intent' END) AS failures FROM d""")
def planner_evaluation(spark, sf_dir):
    """Of each question as an evaluator's case the fields in which the rules' plan isn't the expected one; sections and years are expected as they are."""
    asked = _named(spark, sf_dir).withColumn("context", _context()).withColumn("own", p.local_plan(F.col("q"), F.col("context")))
    expected = F.struct(F.array(F.lit("AMD")).alias("tickers"), F.col("own.sections").alias("sections"), F.lit("latest").alias("time_scope"), F.lit("summary").alias("intent"), F.col("own.filing_years").alias("filing_years"))
    cases = asked.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("q").alias("question"), "context", expected.alias("expected"))
    return evaluate.evaluate_plans(cases).select("id", F.array_join("failures", ",").alias("failures"))
