"""From a question to a search plan by rules: column expressions over a table of questions.

The context of a plan is struct(tickers, sections, years, names): tickers and sections as arrays,
years as map of ticker to descending years, names as map of ticker to company names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

# Sections in order, and the words that the rules look for.
SECTIONS = ("1", "1A", "7", "7A")
BUSINESS = ("business overview", "business description", "products", "services", "customers", "strategy", "operations")
MARKET_RISK = ("market risk", "interest rate", "foreign currency", "exchange rate", "commodity price", "credit risk", "sensitivity analysis")
MANAGEMENT = (
    "md&a", "management discussion", "financial performance", "revenue", "expenses", "margins", "profitability", "results of operations", "liquidity",
    "capital resources", "cash flows", "management outlook",
)
TREND = ("over time", "trend", "changed", "evolved", "historical")
COMPARISON = ("compare", "comparison", "versus", " vs ", "between")
FACT = ("table", "what revenue", "how much")
PREVIOUS = ("previous", "prior", "year over year")
OLDEST = ("oldest", "earliest")
NAME_SUFFIXES = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "plc", "class a", "common stock")


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def infer_sections(question: Column) -> Column:
    """Sections that the question names; an empty array for an item that is not supported; null if it names none."""

    def found(q: Column, market: Column) -> Column:
        risk = F.contains(q, F.lit("risk factor")) | (F.contains(q, F.lit("risks")) & ~market)
        return F.array_compact(F.array(F.when(_has(q, BUSINESS), "1"), F.when(market, "7A"), F.when(risk, "1A"), F.when(_has(q, MANAGEMENT), "7")))

    def chosen(x: Column) -> Column:
        named = F.when(x["item"].isin(*SECTIONS), F.array(x["item"])).otherwise(F.array().cast("array<string>"))
        fallback = F.when(F.contains(x["q"], F.lit("business")), F.array(F.lit("1")))
        return F.when(x["item"] != "", named).when(F.size(x["found"]) > 0, x["found"]).otherwise(fallback)

    def of(q: Column) -> Column:
        item = F.upper(F.regexp_extract(q, r"\bitem\s+(\d+[a-z]?)\b", 1))
        own = bind(_has(q, MARKET_RISK), lambda market: found(q, market))
        return bind(F.struct(q.alias("q"), item.alias("item"), own.alias("found")), chosen)

    return bind(F.lower(question), of)


def infer_intent(question: Column) -> Column:
    q = F.lower(question)
    return F.when(_has(q, FACT), "fact").when(_has(q, TREND), "trend").when(_has(q, COMPARISON), "comparison").otherwise("summary")


def normalize_intent(question: Column, intent: Column) -> Column:
    """The given intent, unless the question asks for a fact."""
    return F.when(_has(F.lower(question), FACT), "fact").otherwise(intent)


def requests_years(question: Column) -> Column:
    return _has(F.lower(question), OLDEST) | question.rlike(r"\b20\d{2}\b")


def infer_years(question: Column, available: Column) -> Column:
    """The least available year for the oldest; a range of years with blanks around its word; else the years named."""
    q = F.lower(question)
    span = r"\b(20\d{2})\b\s+(?:and|to|-|through)\s+\b(20\d{2})\b"
    first, last = (F.regexp_extract(q, span, k).try_cast("int") for k in (1, 2))
    named = F.array_distinct(F.transform(F.regexp_extract_all(q, F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int")))
    none = F.array().cast("array<int>")
    oldest = F.when(F.size(available) > 0, F.array(F.array_min(available))).otherwise(none)
    return F.when(_has(q, OLDEST), oldest).when(first.isNotNull(), F.sequence(F.least(first, last), F.greatest(first, last))).otherwise(named)


def infer_time_scope(question: Column) -> Column:
    trend = infer_intent(question) == "trend"
    return F.when(requests_years(question), "specific_years").when(trend, "all_available").when(_has(F.lower(question), PREVIOUS), "latest_and_previous").otherwise("latest")


def match_text(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


def company_match_name(name: Column) -> Column:
    """A company's name as questions write it: without the legal suffixes at its end."""
    return F.trim(F.regexp_replace(match_text(name), f"( ({'|'.join(NAME_SUFFIXES)}))+$", ""))


def available_years(tickers: Column, years: Column) -> Column:
    """Distinct years of these tickers, or of all where there are none."""
    chosen = F.when(F.size(tickers) > 0, F.map_filter(years, lambda k, v: F.array_contains(tickers, k))).otherwise(years)
    return F.array_distinct(F.flatten(F.map_values(chosen)))


def infer_tickers(question: Column, context: Column) -> Column:
    """Tickers that the question names as words, or whose company's name it holds."""

    def found(q: Column) -> Column:
        def named(ticker: Column) -> Column:
            names = F.coalesce(F.element_at(context["names"], ticker), F.array().cast("array<string>"))
            by_name = F.exists(F.transform(names, company_match_name), lambda n: (n != "") & F.contains(q, n))
            word = F.concat(F.lit(" "), F.lower(ticker), F.lit(" "))
            return F.contains(q, word) | by_name

        return F.filter(context["tickers"], named)

    return bind(F.concat(F.lit(" "), match_text(question), F.lit(" ")), found)


def normalize_plan(question: Column, plan: Column, context: Column) -> Column:
    """A plan that the context can serve: struct(tickers, sections, semantic_queries, time_scope, filing_years, top_k, intent).

    plan: struct of the same fields as a planner gave them; top_k is kept between 1 and 20, the
    question itself is the first of at most four queries. Each step is a value that the next ones
    share, so the expression stays small.
    """
    none = F.array().cast("array<int>")

    def given(g: Column) -> Column:
        q, plan, context = g["q"], g["plan"], g["context"]
        tickers = F.array_distinct(F.filter(F.transform(plan["tickers"], lambda t: F.upper(t)), lambda t: F.array_contains(context["tickers"], t)))
        return bind(tickers, lambda t: bind(F.struct(t.alias("t"), available_years(t, context["years"]).alias("have"), requests_years(q).alias("asks")), lambda own: with_years(q, plan, context, own)))

    def with_years(q: Column, plan: Column, context: Column, own: Column) -> Column:
        asked = F.when(own["asks"], F.array_distinct(plan["filing_years"])).otherwise(none)
        return bind(asked, lambda x: bind(F.when(F.size(x) > 0, x).otherwise(infer_years(q, own["have"])), lambda years: made(q, plan, context, own, years)))

    def made(q: Column, plan: Column, context: Column, own: Column, years: Column) -> Column:
        wanted = F.coalesce(infer_sections(q), F.transform(plan["sections"], lambda s: F.upper(s)))
        scope = F.when(F.size(years) > 0, "specific_years").when((plan["time_scope"] == "specific_years") & (plan["intent"] == "trend"), "all_available")
        return F.struct(
            own["t"].alias("tickers"),
            F.array_distinct(F.filter(wanted, lambda s: F.array_contains(context["sections"], s))).alias("sections"),
            F.slice(F.array_distinct(F.concat(F.array(F.trim(q)), F.filter(F.transform(plan["semantic_queries"], F.trim), lambda x: x != ""))), 1, 4).alias("semantic_queries"),
            scope.when(plan["time_scope"] == "specific_years", "latest").otherwise(plan["time_scope"]).alias("time_scope"),
            F.when(F.size(years) > 0, F.filter(years, lambda y: F.array_contains(own["have"], y))).otherwise(none).alias("filing_years"),
            F.least(F.greatest(plan["top_k"], F.lit(1)), F.lit(20)).alias("top_k"),
            normalize_intent(q, plan["intent"]).alias("intent"),
        )

    return bind(F.struct(question.alias("q"), plan.alias("plan"), context.alias("context")), given)


def local_plan(question: Column, context: Column, top_k: int = 5) -> Column:
    """The plan of the rules alone; a blank question raises."""
    checked = F.when(F.trim(question) == "", F.raise_error(F.lit("question must not be empty"))).otherwise(question)

    def raw(g: Column) -> Column:
        q, tickers, context = g["q"], g["tickers"], g["context"]
        plan = F.struct(
            tickers.alias("tickers"),
            F.coalesce(infer_sections(q), F.array().cast("array<string>")).alias("sections"),
            F.array(q).alias("semantic_queries"),
            infer_time_scope(q).alias("time_scope"),
            infer_years(q, available_years(tickers, context["years"])).alias("filing_years"),
            F.lit(top_k).alias("top_k"),
            infer_intent(q).alias("intent"),
        )
        return normalize_plan(q, plan, context)

    asked = lambda g: F.struct(g["q"].alias("q"), infer_tickers(g["q"], g["context"]).alias("tickers"), g["context"].alias("context"))
    return bind(F.struct(checked.alias("q"), context.alias("context")), lambda g: bind(asked(g), raw))


def fallback_plan(question: Column) -> Column:
    """The plan where a planner failed: the question itself over the latest filings; a blank question raises."""
    asked = F.when(F.trim(question) == "", F.raise_error(F.lit("question must not be empty"))).otherwise(F.trim(question))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    # The defaults.
    return F.struct(
        none("string").alias("tickers"), none("string").alias("sections"), F.array(asked).alias("semantic_queries"), F.lit("latest").alias("time_scope"), none("int").alias("filing_years"), F.lit(5).alias("top_k"), F.lit("summary").alias("intent")
    )


def scope_years(scope: Column, wanted: Column, years: Column) -> Column:
    """Of a ticker's years, latest first, those that a time scope takes."""
    latest = F.sort_array(F.array_distinct(years), asc=False)
    return (
        F.when(scope == "latest", F.slice(latest, 1, 1))
        .when(scope == "latest_and_previous", F.slice(latest, 1, 2))
        .when(scope == "specific_years", F.filter(wanted, lambda y: F.array_contains(years, y)))
        .otherwise(latest)
    )
