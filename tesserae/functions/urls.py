"""URL, domain and source-scoring functions, all column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and weights that results depend on.
LEGAL_SUFFIXES = ("class", "com", "co", "company", "corp", "corporation", "group", "holding", "holdings", "inc", "incorporated", "limited", "llc", "ltd", "plc", "sa")
SOURCE_PATHS = (
    "/blog", "/blogs", "/news", "/newsroom", "/press", "/press-releases", "/media", "/media-center", "/company/news", "/company/newsroom", "/about/news",
    "/about/newsroom", "/investors", "/investor", "/investor-relations", "/ir", "/financials", "/news-releases", "/rss", "/feed", "/atom.xml", "/rss.xml",
    "/feed.xml", "/blog/feed", "/news/feed", "/newsroom/feed", "/press-releases/feed",
)
SOURCE_SUBDOMAINS = ("blog", "blogs", "news", "newsroom", "media", "press", "investor", "investors", "ir")
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/xml", "text/xml")
PATH_SIGNALS = ("blog", "news", "press", "media", "investor", "/ir", "feed", "rss", "atom")
TITLE_SIGNALS = ("blog", "newsroom", "press", "investor relations", "news releases", "media")
TYPE_SIGNALS = (("investor_relations", ("investor", "/ir", " ir ")), ("company_blog", ("blog",)), ("newsroom", ("news", "press", "media")))
DOCUMENT_TYPES = {"company_blog": "blog_post", "newsroom": "press_release", "investor_relations": "investor_update", "webpage": "webpage"}
LEAST_SCORE = 0.45

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _PARTS, k)


def netloc(url: Column) -> Column:
    return F.coalesce(F.lower(_part(url, 2)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.lower(_part(url, 3)), F.lit(""))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, the fragment dropped; a url with neither is only trimmed."""
    bare = F.trim(url)
    scheme = F.when(_part(bare, 1) != "", F.concat(F.lower(_part(bare, 1)), F.lit(":"))).otherwise("")
    host = F.when(_part(bare, 2) != "", F.concat(F.lit("//"), F.lower(_part(bare, 2)))).otherwise("")
    query = F.when(_part(bare, 4) == "?", "").otherwise(_part(bare, 4))
    whole = F.concat(scheme, host, _part(bare, 3), query)
    return F.when((scheme == "") & (host == ""), bare).otherwise(whole)


def normalize_domain(value: Column) -> Column:
    """The host of a url or bare domain, without a leading `www.`."""
    host = F.regexp_extract(F.coalesce(value, F.lit("")), r"^(?:[^:/]*://)?/*([^/?#]*)", 1)
    return F.regexp_replace(F.trim(F.lower(host)), r"^www\.", "")


def is_official_domain(url: Column, domain: Column) -> Column:
    host = F.regexp_replace(F.regexp_replace(netloc(url), "^.*@", ""), ":.*$", "")
    own = normalize_domain(domain)
    return (host == own) | F.endswith(host, F.concat(F.lit("."), own))


def is_feed_url(url: Column) -> Column:
    return path(url).rlike(r"(\.xml|\.rss|/feed|/rss|/atom)$|/feed/")


def is_feed_response(content_type: Column, text: Column) -> Column:
    return _any(F.lower(F.coalesce(content_type, F.lit(""))), FEED_TYPES) | F.lower(F.coalesce(text, F.lit(""))).rlike(r"^\s*<(\?xml|rss|feed)")


def infer_source_type(url: Column, final_url: Column, title: Column) -> Column:
    """By the first group of words that the hosts, paths and title have; null if none."""
    bare = lambda u: F.regexp_replace(path(u), "/+$", "")
    final = F.coalesce(final_url, F.lit(""))
    hay = F.concat_ws(" ", netloc(url), bare(url), netloc(final), bare(final), F.lower(F.coalesce(title, F.lit(""))))
    kind = F.when(is_feed_url(url), "news_feed")
    for name, words in TYPE_SIGNALS:
        kind = kind.when(_any(hay, words), name)
    return kind


def has_path_signal(url: Column) -> Column:
    """The subdomain of a host of three labels or more, or the path, names a kind of source."""
    labels = F.split(netloc(url), r"\.")
    return ((F.size(labels) > 2) & labels[0].isin(*SOURCE_SUBDOMAINS)) | _any(path(url), PATH_SIGNALS)


def has_title_signal(title: Column) -> Column:
    return _any(F.lower(F.coalesce(title, F.lit(""))), TITLE_SIGNALS)


def has_source_signal(url: Column, title: Column, feeds: Column) -> Column:
    return has_path_signal(url) | has_title_signal(title) | (F.size(feeds) > 0) | is_feed_url(url)


def score_candidate(url: Column, selected: Column, domain: Column, title: Column, feeds: Column, reachable: Column, extractable: Column) -> Column:
    """struct(score, reasons): the sum of what speaks for and against a source, between 0 and 1."""
    official = is_official_domain(url, domain)
    # What is true, what it adds, what it says.
    rules = (
        (official, 0.35, "official root domain or known official subdomain"),
        (~official, -0.30, "domain mismatch"),
        (has_path_signal(url), 0.20, "path or subdomain strongly matches source type"),
        (has_title_signal(title), 0.15, "page title contains source signal"),
        (F.size(feeds) > 0, 0.15, "RSS/Atom link discovered"),
        (is_feed_url(selected), 0.05, "selected source URL is an RSS/Atom feed"),
        (reachable, 0.10, "reachable 2xx after redirects"),
        (~reachable, -0.20, "unreachable or timeout"),
        (extractable, 0.05, "extractable text or feed entries"),
    )
    total = reduce(lambda a, r: a + F.when(r[0], r[1]).otherwise(0.0), rules, F.lit(0.0))
    reasons = F.array_compact(F.array(*(F.when(r[0], r[2]) for r in rules)))
    return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).alias("score"), F.array_join(reasons, ", ").alias("reasons"))


def trust_level(score: Column) -> Column:
    """Of the score before it is rounded."""
    return F.when(score >= 0.80, "high").when(score >= 0.55, "medium").otherwise("low")


def preferred_source_url(final_url: Column, feeds: Column, kind: Column) -> Column:
    return F.when(kind.isin("company_blog", "newsroom", "news_feed") & (F.size(feeds) > 0), F.get(feeds, 0)).otherwise(final_url)


def source_name(url: Column, title: Column, kind: Column) -> Column:
    label = F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))
    return F.coalesce(F.nullif(F.substring(title, 1, 120), F.lit("")), F.concat_ws(" ", netloc(url), label))


def document_type(kind: Column) -> Column:
    found = F.lit("article")
    for name, value in DOCUMENT_TYPES.items():
        found = F.when(kind == name, value).otherwise(found)
    return found


def first_non_empty(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def root_reachable(status: Column) -> Column:
    return F.coalesce(status.between(200, 399) | status.isin(401, 403), F.lit(False))


def candidate_urls(domain: Column) -> Column:
    """Where a company's sources may be: paths under the domain with and without www, then subdomains."""
    own = normalize_domain(domain)
    bases = F.array(own, F.concat(F.lit("www."), own))
    paths = F.array(*map(F.lit, ("/", *SOURCE_PATHS)))
    under = F.flatten(F.transform(bases, lambda host: F.transform(paths, lambda p: F.concat(F.lit("https://"), host, p))))
    beside = F.transform(F.array(*map(F.lit, SOURCE_SUBDOMAINS)), lambda s: F.concat(F.lit("https://"), s, F.lit("."), own, F.lit("/")))
    return F.array_distinct(F.concat(under, beside))


def company_name_tokens(name: Column) -> Column:
    """Words of a company's name without legal suffixes and share classes at its end."""
    plain = F.replace(F.lower(F.regexp_replace(name, r"[^a-zA-Z0-9& ]+", " ")), F.lit("&"), F.lit(" and "))
    words = F.filter(F.split(plain, " +"), lambda w: (w != "") & ~w.isin(*LEGAL_SUFFIXES))
    return F.filter(F.split(F.regexp_replace(F.array_join(words, " "), r"(^| )[abc]( [abc])*$", ""), " "), lambda w: w != "")


def domain_candidates(name: Column) -> Column:
    """Domains that a company of this name may have."""
    return F.transform(F.array(company_name_tokens(name)), lambda t: F.when(F.size(t) == 0, F.array().cast("array<string>")).when(
        F.size(t) == 1, F.array(F.concat(t[0], F.lit(".com")))
    ).otherwise(F.array_distinct(F.array(F.concat(t[0], F.lit(".com")), F.concat(F.array_join(t, ""), F.lit(".com")), F.concat(F.array_join(t, "-"), F.lit(".com"))))))[0]
