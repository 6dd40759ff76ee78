"""What a page is: article text by tag stripping, access walls, quality rules, dates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.fixed import BOT_WALL, LOGIN, PAYWALL
from textloom.functions.text import any_of, markers

TAGS = "<[^>]*>"


def visible(html: Column) -> Column:
    """Text without scripts, styles, navigation, footers, comments and tags; blanks single."""
    t = F.regexp_replace(html, "(?is)<!--.*?-->", " ")
    for tag in ("script", "style", "noscript", "svg", "nav", "footer", "header", "head"):
        t = F.regexp_replace(t, f"(?is)<{tag}\\b[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, TAGS, " "), "\\s+", " "))


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def link_text(html: Column) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(html, F.lit("(?is)<a\\b[^>]*>(.*?)</a>"), F.lit(1)), lambda a: F.regexp_replace(a, TAGS, "")), " ")


def density(links: Column, text: Column) -> Column:
    """Characters of links to characters of text, no blanks counted, at most 1."""
    n = lambda c: F.length(F.regexp_replace(c, "\\s+", ""))
    return F.when(n(text) == 0, F.lit(0.0)).otherwise(F.round(F.least(F.lit(1.0), n(links) / n(text)), 4))


def wall(html: Column, status: Column, chars: Column) -> Column:
    """The first that holds: a robot wall (not on a page that reads like an article), a paywall that the page declares, a refusal by status, what short pages say, a shell without text."""
    low = F.lower(html)
    article = (status.isNull() | (status < 400)) & (chars >= 1200)
    password = low.rlike("<input[^>]*type=[\"']?password")
    paid = any_of(low.rlike("article:content_tier[\"'\\s]*content=[\"'](locked|metered)"), low.rlike("\"isaccessibleforfree\"\\s*:\\s*(false|\"false\")"), low.rlike("isaccessibleforfree[\"'\\s]*content=[\"']?false"))
    return (
        F.when((F.size(markers(low, BOT_WALL)) > 0) & ~article, "bot_wall").when(status == 429, "bot_wall").when(paid, "paywall_partial")
        .when((status == 403) & password & (chars < 500), "login_required").when(status.isin(401, 403), F.when(status == 401, "login_required").otherwise("bot_wall"))
        .when((chars < 1500) & (F.size(markers(low, LOGIN)) > 0), "login_required").when((chars < 1500) & (F.size(markers(low, PAYWALL)) > 0), "paywall_partial")
        .when((chars < 500) & password, "login_required").when((chars < 300) & low.rlike("<script|id=[\"']root[\"']"), "extraction_failed")
    )


def failed_rules(chars: Column, link_density: Column, agreement: Column, secondary: Column) -> Column:
    return F.array_compact(F.array(
        F.when(chars < 300, "too_short"), F.when(link_density > 0.35, "high_link_density"), F.when((agreement < 0.5) & (chars < secondary) & (secondary > 300), "extractor_disagreement"),
    ))


def plausible(ts: Column, as_of: Column) -> Column:
    """ts, or null if before 1995 or more than two days after as_of."""
    return F.when((F.year(ts) >= 1995) & (ts <= as_of + F.expr("interval 2 days")), ts)


def parsed(raw: Column) -> Column:
    """Epoch seconds (10 to 12 digits), milliseconds (13 digits), ISO forms, or a day, month and year in words; null if none."""
    digits = raw.rlike("^[0-9]{10,13}$")
    epoch = F.timestamp_seconds(F.when(F.length(raw) == 13, raw.try_cast("bigint") / 1000).otherwise(raw.try_cast("bigint").cast("double")))
    forms = [F.try_to_timestamp(raw, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy")]
    return F.when(digits, epoch).otherwise(F.coalesce(*forms))


def published(df: DataFrame, rungs: dict[str, Column], as_of: Column) -> DataFrame:
    """df with published_at and published_source: the first rung, in order, whose date is plausible."""
    ladder = F.filter(F.array(*(F.struct(plausible(parsed(c), as_of).alias("at"), F.lit(k).alias("source")) for k, c in rungs.items())), lambda x: x["at"].isNotNull())
    return df.withColumn("__first", F.get(ladder, F.lit(0))).withColumns({"published_at": F.col("__first.at"), "published_source": F.col("__first.source")}).drop("__first")
