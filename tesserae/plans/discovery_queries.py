"""Registered url functions and source discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as u
from ..operators import discovery
from ..sources import feeds
from .domain import Domain
from .registry import query

_HOST = "lower(regexp_extract(url, '://([^/?#]*)', 1))"
_PATH = "lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1))"
_TYPE = f"""CASE WHEN regexp_matches({_PATH}, '(\\.xml|\\.rss|/feed|/rss|/atom)$|/feed/') THEN 'news_feed' WHEN contains(hay, 'investor') OR contains(hay, '/ir') OR contains(hay, ' ir ') THEN 'investor_relations'
  WHEN contains(hay, 'blog') THEN 'company_blog' WHEN contains(hay, 'news') OR contains(hay, 'press') OR contains(hay, 'media') THEN 'newsroom' END"""
_PAGES = f"(SELECT page_id, url, {_HOST} || ' ' || rtrim({_PATH}, '/') || '   ' AS hay FROM pages)"


@query("SELECT page_id, lower(regexp_extract(url, '^([^:]*)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_extract(url, '://[^/?#]*([^?#]*)', 1) || regexp_extract(url, '(\\?[^#]*)', 1) AS url FROM pages")
def normalize_url(spark, sf_dir):
    upper = F.concat(F.upper(F.substring("url", 1, 14)), F.expr("substring(url, 15)"))
    return Domain(spark, sf_dir).table("pages").select("page_id", u.normalize_url(upper).alias("url"))


@query(f"SELECT page_id, regexp_replace({_HOST}, '^www\\.', '') AS domain FROM pages")
def normalize_domain(spark, sf_dir):
    return Domain(spark, sf_dir).table("pages").select("page_id", u.normalize_domain(F.col("url")).alias("domain"))


@query(f"SELECT page_id, {_HOST} = 'example.net' OR ends_with({_HOST}, '.example.net') AS official FROM pages")
def official_domain(spark, sf_dir):
    return Domain(spark, sf_dir).table("pages").select("page_id", u.is_official_domain(F.col("url"), F.lit("https://www.example.net/about")).alias("official"))


@query(f"SELECT page_id, {_TYPE} AS source_type FROM {_PAGES}")
def infer_source_type(spark, sf_dir):
    return Domain(spark, sf_dir).table("pages").select("page_id", u.infer_source_type(F.col("url"), F.lit(None), F.lit(None)).alias("source_type"))


# Made-up fetch results: every other page has a telling title, every third a feed, every fifth can't be reached, every seventh has no text.
_SCORE = f"""SELECT page_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_sum(list_transform(told, lambda r: r.w)))) AS score, array_to_string(list_transform(told, lambda r: r.why), ', ') AS reasons FROM (SELECT page_id, list_filter([
   {{'ok': official, 'w': 0.35::DOUBLE, 'why': 'official root domain or known official subdomain'}}, {{'ok': NOT official, 'w': -0.30::DOUBLE, 'why': 'domain mismatch'}}, {{'ok': strong, 'w': 0.20::DOUBLE, 'why': 'path or subdomain strongly matches source type'}},
   {{'ok': page_id % 2 = 0, 'w': 0.15::DOUBLE, 'why': 'page title contains source signal'}}, {{'ok': page_id % 3 = 0, 'w': 0.15::DOUBLE, 'why': 'RSS/Atom link discovered'}}, {{'ok': page_id % 3 = 0, 'w': 0.05::DOUBLE, 'why': 'selected source URL is an RSS/Atom feed'}},
   {{'ok': page_id % 5 > 0, 'w': 0.10::DOUBLE, 'why': 'reachable 2xx after redirects'}}, {{'ok': page_id % 5 = 0, 'w': -0.20::DOUBLE, 'why': 'unreachable or timeout'}}, {{'ok': page_id % 7 > 0, 'w': 0.05::DOUBLE, 'why': 'extractable text or feed entries'}}], lambda r: r.ok) AS told FROM
  (SELECT page_id, {_HOST} = 'example.net' OR ends_with({_HOST}, '.example.net') AS official, list_contains(['blog', 'blogs', 'news', 'newsroom', 'media', 'press', 'investor', 'investors', 'ir'], string_split({_HOST}, '.')[1])
   OR regexp_matches({_PATH}, 'blog|news|press|media|investor|/ir|feed|rss|atom') AS strong FROM pages))"""


def _scored(spark, sf_dir):
    k = lambda n: F.col("page_id") % n == 0
    feeds = F.when(k(3), F.array(F.lit("https://example.net/feed"))).otherwise(F.array().cast("array<string>"))
    url = F.col("url")
    scored = u.score_candidate(url, F.when(k(3), feeds[0]).otherwise(F.lit("https://example.net/x")), F.lit("example.net"), F.when(k(2), "Our Newsroom"), feeds, ~k(5), ~k(7))
    return Domain(spark, sf_dir).table("pages").withColumn("s", scored)


@query(f"SELECT page_id, round(score, 6) AS score, reasons FROM ({_SCORE})")
def score_candidate(spark, sf_dir):
    return _scored(spark, sf_dir).select("page_id", F.round("s.score", 6).alias("score"), F.col("s.reasons").alias("reasons"))


@query(f"SELECT page_id, CASE WHEN score >= 0.80 THEN 'high' WHEN score >= 0.55 THEN 'medium' ELSE 'low' END AS trust_level FROM ({_SCORE})")
def trust_level(spark, sf_dir):
    return _scored(spark, sf_dir).select("page_id", u.trust_level(F.col("s.score")).alias("trust_level"))


_PATHS = "[" + ", ".join(f"'{p}'" for p in ("/", *u.SOURCE_PATHS)) + "]"
_SUBS = "[" + ", ".join(f"'{s}'" for s in u.SOURCE_SUBDOMAINS) + "]"


@query(f"""SELECT 'nation' || n_nationkey || '.com' AS domain, unnest(list_concat(list_transform({_PATHS}, lambda p: 'https://nation' || n_nationkey || '.com' || p),
  list_transform({_PATHS}, lambda p: 'https://www.nation' || n_nationkey || '.com' || p), list_transform({_SUBS}, lambda s: 'https://' || s || '.nation' || n_nationkey || '.com/'))) AS url FROM nation""")
def candidate_urls(spark, sf_dir):
    domain = F.concat(F.lit("nation"), F.col("n_nationkey").cast("string"), F.lit(".com"))
    companies = Domain(spark, sf_dir).table("nation").select(F.lit("").alias("ticker"), domain.alias("website_domain"))
    return discovery.candidates(companies).select("domain", "url")


@query("""SELECT p_partkey, array_to_string(CASE len(t) WHEN 0 THEN [] WHEN 1 THEN [t[1] || '.com'] ELSE [t[1] || '.com', array_to_string(t, '') || '.com', array_to_string(t, '-') || '.com'] END, ',') AS domains FROM
  (SELECT p_partkey, list_filter(regexp_split_to_array(regexp_replace(lower(p_name), '[^a-z0-9& ]+', ' ', 'g'), ' +'), lambda x: x NOT IN ('', 'group', 'inc', 'holdings')) AS t FROM part)""")
def domain_candidates(spark, sf_dir):
    name = F.concat(F.col("p_name"), F.lit(" Holdings, Group INC. B"))
    return Domain(spark, sf_dir).table("part").select("p_partkey", F.array_join(u.domain_candidates(name), ",").alias("domains"))


@query("SELECT source AS url, max(n_chars) AS confidence_score, min(doc_id) FILTER (n_chars = m) AS final_url FROM (SELECT *, max(n_chars) OVER (PARTITION BY source) AS m FROM documents) GROUP BY source")
def best_source_per_url(spark, sf_dir):
    found = Domain(spark, sf_dir).table("documents").select(F.col("source").alias("url"), F.col("n_chars").alias("confidence_score"), F.col("doc_id").alias("final_url"))
    return discovery.best_per_url(found)


@query()
def discover_sources(spark, sf_dir):
    """Sources among all pages, each judged as a fetch result of its own registered domain."""
    pages = Domain(spark, sf_dir).table("pages")
    domain = F.regexp_extract(u.netloc(F.col("url")), r"([^.]+\.[^.]+)$", 1)
    fetched = pages.select("url", F.col("url").alias("final_url"), F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), F.col("html").alias("text"), domain.alias("domain"))
    return discovery.best_per_url(discovery.classify(fetched))


_SIGNS = "blog|news|press|media|investor|/ir|feed|rss|atom"


@query(f"""SELECT page_id, regexp_matches({_PATH}, '(\\.xml|\\.rss|/feed|/rss|/atom)$|/feed/') AS feed, CASE page_id % 3 WHEN 0 THEN true ELSE page_id % 3 = 1 AND regexp_matches(lower(html), '^\\s*<(\\?xml|rss|feed)') END AS response,
  (len(string_split({_HOST}, '.')) > 2 AND list_contains(['blog', 'blogs', 'news', 'newsroom', 'media', 'press', 'investor', 'investors', 'ir'], string_split({_HOST}, '.')[1])) OR regexp_matches({_PATH}, '{_SIGNS}') OR page_id % 4 = 0 AS signal FROM pages""")
def source_signals(spark, sf_dir):
    """Whether urls and responses are feeds, and whether anything speaks for a source."""
    pages, k = Domain(spark, sf_dir).table("pages"), F.col("page_id") % 3
    kind = F.when(k == 0, "Application/RSS+xml; charset=x").otherwise("text/html")
    text = F.when(k == 1, F.col("html")).otherwise(F.lit(""))
    signal = u.has_source_signal(F.col("url"), F.when(F.col("page_id") % 4 == 0, "Press Room"), F.array().cast("array<string>"))
    return pages.select("page_id", u.is_feed_url(F.col("url")).alias("feed"), u.is_feed_response(kind, text).alias("response"), signal.alias("signal"))


@query("SELECT o_orderkey, o_orderkey % 700 AS status, o_orderkey % 700 BETWEEN 200 AND 399 OR o_orderkey % 700 IN (401, 403) AS reachable FROM orders")
def reachable_roots(spark, sf_dir):
    status = F.col("o_orderkey") % 700
    return Domain(spark, sf_dir).table("orders").select("o_orderkey", status.alias("status"), u.root_reachable(status).alias("reachable"))


@query(f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'blog_post' WHEN 1 THEN 'press_release' WHEN 2 THEN 'investor_update' WHEN 3 THEN 'webpage' ELSE 'article' END AS document_type,
  CASE WHEN page_id % 2 = 0 THEN substr(repeat('Title ', 30), 1, 120) ELSE {_HOST} || ' ' || CASE page_id % 5 WHEN 0 THEN 'Company Blog' WHEN 1 THEN 'Newsroom' WHEN 2 THEN 'Investor Relations' WHEN 3 THEN 'Webpage' ELSE 'News Feed' END END AS name,
  CASE WHEN page_id % 5 IN (0, 1, 4) AND page_id % 3 = 0 THEN 'https://f.example/' ELSE url END AS selected, CASE WHEN page_id % 2 = 0 THEN url ELSE 'none' END AS first FROM pages""")
def source_fields(spark, sf_dir):
    """Document type, name and preferred url of sources of each type; and the first value that isn't empty."""
    kind = F.get(F.array(*map(F.lit, ("company_blog", "newsroom", "investor_relations", "webpage", "news_feed"))), (F.col("page_id") % 5).cast("int"))
    feeds = F.when(F.col("page_id") % 3 == 0, F.array(F.lit("https://f.example/"), F.lit("https://g.example/"))).otherwise(F.array().cast("array<string>"))
    even = F.col("page_id") % 2 == 0
    name = u.source_name(F.col("url"), F.when(even, F.repeat(F.lit("Title "), 30)).otherwise(""), kind)
    first = u.first_non_empty(F.lit(None).cast("string"), F.lit(""), F.when(even, F.col("url")), F.lit("none"))
    return Domain(spark, sf_dir).table("pages").select("page_id", u.document_type(kind).alias("document_type"), name.alias("name"), u.preferred_source_url(F.col("url"), feeds, kind).alias("selected"), first.alias("first"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'own' || s_suppkey || '.com' WHEN s_suppkey % 5 > 0 THEN 'supplier' || CASE WHEN s_suppkey % 2 = 0 THEN '-' ELSE '' END || 'n' || s_suppkey || '.com' END AS website_domain FROM supplier""")
def resolve_domains(spark, sf_dir):
    """Domains of companies: the stored one, else the first candidate by name that answers."""
    s, key = Domain(spark, sf_dir).table("supplier"), F.col("s_suppkey").cast("string")
    companies = s.select("s_suppkey", key.alias("ticker"), F.concat(F.lit("Supplier n"), key, F.lit(" Inc. C")).alias("name"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("https://WWW.own"), key, F.lit(".com/x"))).otherwise("").alias("website_domain"))
    dash = F.when(F.col("s_suppkey") % 2 == 0, "-").otherwise("")
    roots = s.select(F.concat(F.lit("supplier"), dash, F.lit("n"), key, F.lit(".com")).alias("domain"), F.when(F.col("s_suppkey") % 5 == 0, 404).otherwise(403).alias("status_code"))
    return discovery.resolve_domains(companies, roots).select("s_suppkey", "website_domain")


@query("""SELECT source_id, url, title, author, published_at, feed_id FROM (SELECT n_nationkey AS source_id, unnest([0, 1]) AS k, n_nationkey, n_name FROM nation), LATERAL (SELECT CASE k WHEN 0 THEN 'https://n' || n_nationkey || '.example/a?b=1' ELSE 'https://n' || n_nationkey || '.example/news/c' END AS url,
  CASE k WHEN 0 THEN n_name || ' & more' END AS title, CASE k WHEN 0 THEN 'Ann' ELSE 'Bo' END AS author, CASE k WHEN 0 THEN '2026-06-01T12:00:00+00:00' ELSE '2026-06-02T08:30:00+00:00' END AS published_at, CASE k WHEN 0 THEN 'g' || n_nationkey END AS feed_id)""")
def feed_entries(spark, sf_dir):
    """Entries of made-up RSS and Atom feeds, the first of each url; links are absolute, times in UTC."""
    n = Domain(spark, sf_dir).table("nation")
    rss = F.format_string('<rss><item><title><![CDATA[%s &amp; more]]></title><link>HTTPS://N%d.example/a?b=1#x</link><dc:creator>Ann</dc:creator><pubDate>Mon, 01 Jun 2026 12:00:00 GMT</pubDate><guid>g%d</guid></item><item><title>again</title><link>https://n%d.example/a?b=1</link></item>'
      '<item><title>no link</title></item><entry><link rel="self" href="/self"/><link rel="alternate" href="c"/><author><name>Bo</name></author><updated>2026-06-02T10:30:00+02:00</updated></entry></rss>', F.col("n_name"), "n_nationkey", "n_nationkey", "n_nationkey")  # fmt: skip
    base = F.format_string("https://n%d.example/news/", F.col("n_nationkey"))
    pages = n.select(F.col("n_nationkey").alias("source_id"), base.alias("url"), F.lit('<html><link rel="alternate" type="application/rss+xml" href="feed.xml"></html>').alias("content"))
    fetched = n.select(F.concat(base, F.lit("feed.xml")).alias("url"), rss.alias("content"))
    return feeds.discover_entries(pages, fetched).select("source_id", "url", "title", "author", "published_at", "feed_id")


@query("SELECT page_id, 'https://x.example/p/rss?a=1,' || split_part(url || 'y', '#', 1) AS feeds FROM pages")
def alternate_feeds(spark, sf_dir):
    """Feed links of a page in order, each once, as absolute urls."""
    html = F.concat(F.lit("""<LINK Type='application/rss+xml' REL="alternate" href="rss?a=1"><link rel=alternate type=text/css href=z><link href='"""), F.col("url"), F.lit("""y' type="application/atom+xml" rel='alternate home'><link rel="alternate" type="application/rss+xml" href="rss?a=1#top">"""))
    found = discovery.alternate_feeds(html, F.lit("https://x.example/p/q.html?r"))
    return Domain(spark, sf_dir).table("pages").select("page_id", F.array_join(found, ",").alias("feeds"))
