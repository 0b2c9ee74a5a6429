"""Finding a company's web sources: candidates, fetch results, scores, and the best of each url."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as u
from ..functions.text import article_tree_text_once, html_title, in_small_batches, single_line


def alternate_feeds(html: Column, base_url: Column) -> Column:
    """Absolute urls of the alternate feed links of a page, in order."""
    links = F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))
    attribute = lambda tag, name: F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']?([^"'>\s]+(?:\s+[^"'>=]+(?=["']))?)""", 1)
    kind = lambda tag: F.lower(attribute(tag, "type"))
    feeds = F.filter(
        links,
        lambda x: F.contains(F.lower(attribute(x, "rel")), F.lit("alternate")) & (F.contains(kind(x), F.lit("rss")) | F.contains(kind(x), F.lit("atom")) | F.contains(kind(x), F.lit("xml"))) & (attribute(x, "href") != ""),
    )
    return F.array_distinct(F.transform(feeds, lambda x: u.normalize_url(absolute(attribute(x, "href"), base_url))))


def absolute(href: Column, base_url: Column) -> Column:
    """A link on a page as an absolute url."""
    root = F.regexp_extract(base_url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base_url, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_extract(base_url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .otherwise(F.concat(folder, href))
    )


def classify(fetched: DataFrame) -> DataFrame:
    """Sources among fetched(url, final_url, status_code, content_type, text, domain), with score and reasons, and the ticker if fetched has it.

    Left out are gone and unreachable pages, those of no kind or without a sign of a source, and low scores.
    """
    final = F.coalesce(F.nullif(F.col("final_url"), F.lit("")), F.col("url"))
    feed = u.is_feed_response(F.col("content_type"), F.col("text"))
    seen = fetched.withColumns(
        {
            "final_url": final,
            "feeds": F.when(feed, F.array(final)).otherwise(alternate_feeds(F.col("text"), final)),
            "title": html_title(F.col("text")),
            "reachable": F.coalesce(F.col("status_code").between(200, 299), F.lit(False)),
        }
    )
    signal = u.has_source_signal(F.col("url"), F.col("title"), F.col("feeds")) | u.has_source_signal(F.col("final_url"), F.col("title"), F.col("feeds"))
    seen = seen.withColumn("source_type", u.infer_source_type(F.col("url"), F.col("final_url"), F.col("title"))).where(F.col("reachable") & F.col("source_type").isNotNull() & signal)
    words = single_line(in_small_batches(article_tree_text_once, F.col("text")))
    seen = seen.withColumn("content", F.when(feed, F.regexp_extract(F.col("text"), r"(?is)<(item|entry)\b", 1)).otherwise(words))
    selected = u.preferred_source_url(F.col("final_url"), F.col("feeds"), F.col("source_type"))
    judged = F.when(u.is_official_domain(F.col("url"), F.col("domain")), F.col("url")).otherwise(F.col("final_url"))
    extractable = F.when(feed, F.col("content") != "").otherwise(F.length("content") >= 200)
    official = u.is_official_domain(F.col("url"), F.col("domain")) | u.is_official_domain(F.col("final_url"), F.col("domain"))
    scored = seen.withColumn("selected", selected).withColumn("s", u.score_candidate(judged, F.col("selected"), F.col("domain"), F.col("title"), F.col("feeds"), F.col("reachable"), F.coalesce(extractable, F.lit(False))))
    kept = scored.where(F.col("s.score") >= u.LEAST_SCORE)
    return kept.select(
        u.source_name(F.col("final_url"), F.col("title"), F.col("source_type")).alias("name"),
        F.col("selected").alias("url"),
        "final_url",
        F.when(u.is_feed_url(F.col("selected")), "news_feed").otherwise(F.col("source_type")).alias("source_type"),
        F.when(official, "official").otherwise("unknown").alias("ownership"),
        u.trust_level(F.col("s.score")).alias("trust_level"),
        F.round("s.score", 2).alias("confidence_score"),
        F.col("s.reasons").alias("discovery_reason"),
        "status_code",
        "feeds",
        *(c for c in ("ticker",) if c in fetched.columns),
    )


def best_per_url(found: DataFrame) -> DataFrame:
    """Of each company and url the source of the highest score, the first by final url on ties; sorted."""
    company = [c for c in ("ticker",) if c in found.columns]
    order = Window.partitionBy(*company, "url").orderBy(F.desc("confidence_score"), "final_url")
    best = found.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    return best.orderBy(F.desc("confidence_score"), "url", *company)


def one_per_url(found: DataFrame) -> DataFrame:
    """Of each url one source, whatever the company: an official one first, then by score, then by ticker."""
    order = Window.partitionBy("url").orderBy(F.desc(F.col("ownership") == "official"), F.desc("confidence_score"), "ticker")
    return found.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def candidates(companies: DataFrame) -> DataFrame:
    """ticker, domain and url of every place to look at, from companies(ticker, website_domain)."""
    return companies.select("ticker", F.col("website_domain").alias("domain"), F.explode(u.candidate_urls(F.col("website_domain"))).alias("url"))


def resolve_domains(companies: DataFrame, roots: DataFrame) -> DataFrame:
    """companies with their domain: the stored one, else the first candidate by name whose root in roots(domain, status_code) answers."""
    named = companies.where(F.coalesce("website_domain", F.lit("")) == "")
    tried = named.select("ticker", F.posexplode(u.domain_candidates(F.col("name"))).alias("pos", "domain"))
    reached = tried.join(roots.where(u.root_reachable(F.col("status_code"))), "domain").groupBy("ticker").agg(F.min_by("domain", "pos").alias("found"))
    joined = companies.join(reached, "ticker", "left")
    return joined.withColumn("website_domain", F.coalesce(F.nullif(u.normalize_domain(F.col("website_domain")), F.lit("")), F.col("found"))).drop("found")


def discover(companies: DataFrame, fetched: DataFrame) -> DataFrame:
    """Sources of companies(ticker, website_domain) among the fetch results of their candidate urls."""
    return best_per_url(classify(candidates(companies).join(fetched, "url")))
