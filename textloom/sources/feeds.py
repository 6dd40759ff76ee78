"""RSS and Atom feeds that are already fetched, as rows of entries."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field(entry: Column, name: str) -> Column:
    """Text of an entry's first element of this name, CDATA and entities resolved; null if absent or empty."""
    raw = F.regexp_extract(entry, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
    raw = F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(code), F.lit(sign))
    return F.nullif(F.trim(F.regexp_replace(raw, r"^\s+|\s+$", "")), F.lit(""))


def link(entry: Column) -> Column:
    """RSS's link element, else the href of Atom's alternate link, else of its first."""
    tags = F.regexp_extract_all(entry, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))
    main = F.filter(tags, lambda t: ~t.rlike("(?i)\\srel=") | t.rlike("(?i)\\srel=[\"']alternate[\"']"))
    href = lambda t: F.replace(F.nullif(F.regexp_extract(t, "(?is)\\shref=[\"']([^\"']*)[\"']", 1), F.lit("")), F.lit("&amp;"), F.lit("&"))
    return F.coalesce(field(entry, "link"), href(F.get(main, F.lit(0))), href(F.get(tags, F.lit(0))))


def moment(raw: Column) -> Column:
    """RFC 822 or ISO 8601, as a timestamp; null if it is neither."""
    mail = F.regexp_replace(F.regexp_replace(raw, r"^[A-Za-z]{3},\s*", ""), r"\s(GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for c, f in ((mail, "d MMM yyyy HH:mm:ss Z"), (mail, "d MMM yyyy HH:mm Z"), (raw, "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX"), (raw, "yyyy-MM-dd"))))


def entries(feeds: DataFrame, xml: Column, limit: int | None = None) -> DataFrame:
    """feeds' columns with (position, url, title, published_at) of each entry that has a link; the first limit of each feed, if given.

    The date is the first of published, updated and created. A null or empty feed has no entries.
    """
    found = F.regexp_extract_all(xml, F.lit(r"(?is)<(item|entry)\b.*?</\1>"), F.lit(0))
    linked = F.filter(F.transform(found, lambda e: F.struct(
        link(e).alias("url"), field(e, "title").alias("title"), moment(F.coalesce(*(field(e, n) for n in ("pubDate", "published", "dc:date", "updated", "lastBuildDate", "created")))).alias("published_at"),
    )), lambda e: e["url"].isNotNull())
    some = linked if limit is None else F.slice(linked, 1, limit)
    return feeds.select("*", F.posexplode(some).alias("position", "__entry")).select("*", "__entry.*").drop("__entry")
