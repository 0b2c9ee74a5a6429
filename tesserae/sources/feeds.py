"""Feed entries from RSS and Atom texts, as column expressions over a table of fetched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import urls as u
from ..operators import discovery


def _plain(value: Column) -> Column:
    """Without CDATA marks, tags and the common entities; on one line; nothing is null."""
    bare = F.regexp_replace(F.regexp_replace(value, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), r"<[^>]+>", "")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(plain))
    return t.strip_text(bare)


def _tag(entry: Column, *names: str) -> Column:
    return F.coalesce(*(_plain(F.nullif(F.regexp_extract(entry, rf"(?is)<(?:\w+:)?{n}\b[^>]*>(.*?)</(?:\w+:)?{n}>", 1), F.lit(""))) for n in names))


def _moment(value: Column) -> Column:
    """RFC 822 or ISO times as ISO text in UTC."""
    rfc = F.regexp_replace(F.regexp_replace(value, r"^\w{3},\s*", ""), r"\b(GMT|UTC|Z)$", "+0000")
    parsed = F.coalesce(F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(value))
    return t.entry_datetime(parsed)


def entries(fetched: DataFrame) -> DataFrame:
    """Of fetched(source_id, base_url, content) the entries (source_id, url, title, author, published_at, feed_id), the first of each url."""
    found = F.regexp_extract_all("content", F.lit(r"(?is)<(?:item|entry)\b.*?</(?:item|entry)>"), F.lit(0))
    rows = fetched.select("source_id", "base_url", F.posexplode(found).alias("position", "entry"))
    entry = F.col("entry")
    href = F.nullif(F.regexp_extract(entry, r"""(?is)<link\b(?![^>]*rel\s*=\s*["'](?!alternate))[^>]*href\s*=\s*["']([^"']+)""", 1), F.lit(""))
    link = F.coalesce(_tag(entry, "link"), _plain(href))
    url = discovery.absolute(u.normalize_url(link), F.col("base_url"))
    made = rows.withColumn("link", link).where("link is not null").select(
        "source_id",
        "position",
        url.alias("url"),
        _tag(entry, "title").alias("title"),
        F.coalesce(_tag(F.regexp_extract(entry, r"(?is)<author>(.*?)</author>", 1), "name"), _tag(entry, "creator", "author")).alias("author"),
        _moment(_tag(entry, "pubDate", "published", "updated")).alias("published_at"),
        _tag(entry, "guid", "id").alias("feed_id"),
    )
    first = Window.partitionBy("source_id", "url").orderBy("position")
    return made.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def discover_entries(pages: DataFrame, fetched: DataFrame) -> DataFrame:
    """Entries of pages(source_id, url, content): its own, or those of the feeds that it links to, in fetched(url, content)."""
    own = entries(pages.select("source_id", F.col("url").alias("base_url"), "content"))
    bare = pages.join(own.select("source_id").distinct(), "source_id", "left_anti")
    linked = bare.select("source_id", F.explode(discovery.alternate_feeds(F.col("content"), F.col("url"))).alias("url"))
    followed = entries(linked.join(fetched, "url").select("source_id", F.col("url").alias("base_url"), "content"))
    return own.unionByName(followed)
