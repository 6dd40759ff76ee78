"""Queries over documents and pages: cleaning, statuses, duplicates, quality report, chunks."""

import re
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.functions.fixed import STATUS_GROUPS
from textloom.functions.urls import with_canonical
from textloom.operators import chunking, dedupe, pages
from textloom.plans.registry import query
from textloom.sources.tables import table

NORM = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '([^ \t\x{00a0}\n])[ \t\x{00a0}]+', '\1 ', 'g'), '[ \t\x{00a0}]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""
CLEAN = f"WITH clean AS (SELECT doc_id, lang, source, {NORM} AS t FROM documents), "
STATUS = CLEAN + """hashed AS (SELECT doc_id, lang, source, t, length(t) AS chars, sha256(t) AS hash FROM clean),
status AS (SELECT *, CASE WHEN chars = 0 THEN 'extraction_failed' WHEN chars < 300 THEN 'junk' WHEN doc_id > min(CASE WHEN chars >= 300 THEN doc_id END) OVER (PARTITION BY hash) THEN 'duplicate_content' ELSE 'stored' END AS status FROM hashed) """


def set_checkpoints(spark) -> None:
    """The folder that spark.checkpoint.dir names; where it names none, a local session (as in tests) gets one of this machine, and on a cluster that is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not found and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="textloom-"))


def statuses(spark, sf_dir) -> DataFrame:
    """(doc_id, lang, source, chars, hash, status): empty, too short, an exact copy of a text stored before, or stored. Texts are cleaned once; the copies are found among narrow, written rows."""
    set_checkpoints(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", tx.normalised(F.col("text")).alias("t"))
    d = d.select("doc_id", "lang", "source", F.length("t").alias("chars"), F.sha2("t", 256).alias("hash")).checkpoint()
    first = d.where("chars >= 300").groupBy("hash").agg(F.min("doc_id").alias("first"))
    status = F.when(F.col("chars") == 0, "extraction_failed").when(F.col("chars") < 300, "junk").when(F.col("doc_id") > F.col("first"), "duplicate_content").otherwise("stored")
    return d.join(first, "hash", "left").withColumn("status", status)


@query(CLEAN + "x AS (SELECT 1) SELECT doc_id, sha256(t) AS hash, CAST(length(t) AS BIGINT) AS chars, CAST(len(regexp_extract_all(t, '\\S+')) AS BIGINT) AS words FROM clean")
def normalised_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tx.normalised(F.col("text")).alias("t"))
    return d.select("doc_id", F.sha2("t", 256).alias("hash"), F.length("t").cast("long").alias("chars"), F.regexp_count("t", F.lit("\\S+")).cast("long").alias("words"))


@query(STATUS + "SELECT status, count(*) AS n, CAST(round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS DOUBLE) AS pct FROM status GROUP BY status")
def status_histogram(spark, sf_dir):
    counts = statuses(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))
    return counts.select("status", "n", tx.percent(F.col("n"), F.sum("n").over(Window.partitionBy())).alias("pct"))


@query(STATUS + "SELECT source, count(*) AS attempted, count(*) FILTER (status = 'stored') AS stored FROM status GROUP BY source")
def per_source_counts(spark, sf_dir):
    return statuses(spark, sf_dir).groupBy("source").agg(F.count("*").alias("attempted"), F.count_if(F.col("status") == "stored").alias("stored"))


@query(STATUS + "SELECT CAST(round(avg(chars), 2) AS DOUBLE) AS mean, CAST(median(chars) AS DOUBLE) AS median, CAST(min(chars) AS BIGINT) AS least, CAST(max(chars) AS BIGINT) AS most FROM status WHERE status = 'stored'")
def length_stats(spark, sf_dir):
    s = statuses(spark, sf_dir).where("status = 'stored'")
    return s.agg(F.round(F.avg("chars"), 2).alias("mean"), F.median("chars").cast("double").alias("median"), F.min("chars").cast("long").alias("least"), F.max("chars").cast("long").alias("most"))


@query(STATUS + "SELECT doc_id, CAST(chars AS BIGINT) AS chars, row_number() OVER (ORDER BY chars, doc_id) AS rank, substr(t, 1, 600) AS excerpt, chars > 600 AS truncated FROM status WHERE status = 'stored' ORDER BY chars, doc_id LIMIT 5")
def shortest_stored(spark, sf_dir):
    five = statuses(spark, sf_dir).where("status = 'stored'").orderBy("chars", "doc_id").limit(5).select("doc_id", "chars")
    five = table(spark, sf_dir, "documents").join(F.broadcast(five), "doc_id").withColumn("t", tx.normalised(F.col("text")))
    return five.select("doc_id", F.col("chars").cast("long").alias("chars"), F.row_number().over(Window.orderBy("chars", "doc_id")).cast("long").alias("rank"), F.substring("t", 1, 600).alias("excerpt"), (F.col("chars") > 600).alias("truncated"))


GROUPS = ", ".join(f"('{s}', {f'{g!r}' if g else 'NULL'})" for s, g in STATUS_GROUPS.items())


@query(STATUS + f", dim AS (SELECT * FROM (VALUES {GROUPS}) v(status, status_group)) SELECT dim.status, status_group, count(status.status) AS n FROM dim LEFT JOIN status USING (status) GROUP BY dim.status, status_group")
def status_groups(spark, sf_dir):
    dim = spark.createDataFrame(list(STATUS_GROUPS.items()), "status string, status_group string")
    counts = statuses(spark, sf_dir).groupBy("status").agg(F.count("*").alias("c"))
    return dim.join(counts, "status", "left").select("status", "status_group", F.coalesce("c", F.lit(0)).alias("n"))


@query("SELECT sha256(text) AS hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicate_groups(spark, sf_dir):
    return dedupe.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query("SELECT doc_id, CAST(greatest(CASE WHEN len(k) >= 5 THEN len(list_distinct(list_transform(range(1, len(k) - 3), lambda i: array_to_string(k[i:i+4], ' ')))) ELSE len(list_distinct(k)) END, 0) AS BIGINT) AS n_shingles FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS k FROM documents)")
def shingle_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.shingles(F.col("text"))).cast("long").alias("n_shingles"))


@query()
def near_duplicate_pairs(spark, sf_dir):
    """Jaccard pairs of whole texts; SQL over all pairs is too slow.

    Of documents of one shingle set the least id stands for all: each other one has a row (least id, its id, 1.0), and pairs with
    other sets are between least ids. So copies of a pair's ends pair likewise, and n copies give n rows, not n squared.
    """
    set_checkpoints(spark)
    sets = dedupe.shingle_sets(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    found = dedupe.similar_pairs(sets).select("a", "b", F.round("similarity", 6).alias("similarity"))
    same = dedupe.copies(sets)
    return found.unionByName(same.select(F.col("representative").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))


@query()
def greedy_near_duplicates(spark, sf_dir):
    """Whether each document stays; SQL can't express the rounds."""
    set_checkpoints(spark)
    docs = table(spark, sf_dir, "documents")
    sets = dedupe.shingle_sets(docs, "doc_id", F.col("text"))
    return dedupe.resolve_all(docs, "doc_id", dedupe.similar_pairs(sets).checkpoint(), dedupe.copies(sets))


@query("SELECT doc_id, length(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS key_chars, md5(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) AS key_md5 FROM documents")
def match_keys(spark, sf_dir):
    key = tx.match_key(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(key).cast("long").alias("key_chars"), F.md5(key).alias("key_md5"))


@query("""SELECT doc_id, coalesce(quality, -1) AS quality, CAST(length(text) AS BIGINT) AS chars, list_filter([CASE WHEN length(text) < 300 THEN 'too_short' END, CASE WHEN len(regexp_extract_all(text, '\\n')) > length(text) / 20.0 THEN 'mostly_breaks' END], lambda x: x IS NOT NULL) AS rules
FROM documents LEFT JOIN labels USING (doc_id)""")
def quality_rules(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    rules = F.array_compact(F.array(F.when(F.length("text") < 300, "too_short"), F.when(F.regexp_count("text", F.lit("\n")) > F.length("text") / 20.0, "mostly_breaks")))
    return d.join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.length("text").cast("long").alias("chars"), rules.alias("rules"))


@query("SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN length(text) < 300 THEN 'too_short' END, CASE WHEN length(text) > 8000 THEN 'very_long' END], lambda x: x IS NOT NULL)) AS rule FROM documents) GROUP BY rule")
def rule_histogram(spark, sf_dir):
    rules = F.array_compact(F.array(F.when(F.length("text") < 300, "too_short"), F.when(F.length("text") > 8000, "very_long")))
    return table(spark, sf_dir, "documents").select(F.explode(rules).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^http://', 'https://'), '[?&](ref|src|source|utm_[a-z]+)=[^&]*', '', 'g'), '/+$', ''), '(\\.[a-z]+/.*[^?])&', '\\1?') AS canonical,
lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host FROM pages WHERE url NOT LIKE '%?%'""")
def canonical_urls(spark, sf_dir):
    """Of URLs without a query, for the comparison with SQL; canonical_page_urls has all pages."""
    p = with_canonical(table(spark, sf_dir, "pages").where("url not like '%?%'"), F.col("url"))
    return p.select("page_id", F.col("canonical"), "host")


@query()
def canonical_page_urls(spark, sf_dir):
    """Of all pages, tracking parameters stripped; null where the URL is null or refused."""
    return with_canonical(table(spark, sf_dir, "pages"), F.col("url")).select("page_id", "canonical", "host")


@query("SELECT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1")
def pages_per_host(spark, sf_dir):
    return with_canonical(table(spark, sf_dir, "pages"), F.col("url")).groupBy("host").agg(F.count("*").alias("n"))


@query()
def page_articles(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "html", pages.visible(F.col("html")).alias("article"))
    links = pages.density(pages.link_text(F.col("html")), F.col("article"))
    p = p.withColumns({"title": pages.title(F.col("html")), "chars": F.length("article").cast("long"), "link_density": links})
    return p.select("page_id", "title", "chars", "link_density", pages.wall(F.col("html"), F.lit(None).cast("int"), F.col("chars")).alias("wall"), pages.failed_rules(F.col("chars"), links, F.lit(1.0), F.col("chars")).alias("rules"))


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, CAST(len(regexp_extract_all(html, '(?i)<a\\b')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '(?i)<h[1-6]\\b')) AS BIGINT) AS headings, CAST(len(regexp_extract_all(html, '(?i)<li\\b')) AS BIGINT) AS items FROM pages")
def page_structure(spark, sf_dir):
    n = lambda r: F.regexp_count("html", F.lit(r)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", pages.title(F.col("html")).alias("title"), n("(?i)<a\\b").alias("links"), n("(?i)<h[1-6]\\b").alias("headings"), n("(?i)<li\\b").alias("items"))


@query()
def markdown_chunks(spark, sf_dir):
    return chunking.chunked(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def chunk_stats(spark, sf_dir):
    """Count, shortest, upper median and longest chunk, and the share with a heading, in one pass; the exact middle by a count per length."""
    c = chunking.chunked(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy(F.length("text").alias("n")).agg(F.count("*").alias("c"), F.count_if(F.col("heading").isNotNull()).alias("h"))
    c = c.withColumn("upto", F.sum("c").over(Window.orderBy("n"))).withColumn("total", F.sum("c").over(Window.partitionBy()))
    return c.agg(F.max("total").alias("chunks"), F.min("n").cast("long").alias("shortest"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("n"))).cast("long").alias("upper_median"), F.max("n").cast("long").alias("longest"), tx.percent(F.sum("h"), F.max("total")).alias("with_heading_pct"))


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(round(avg(n_chars), 4) AS DOUBLE) AS mean_chars FROM documents GROUP BY lang")
def documents_by_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), 'license')) AS mentions, CASE WHEN position('license' IN lower(text)) > 0 THEN substr(text, greatest(position('license' IN lower(text)) - 300, 1), 607) END AS excerpt FROM documents WHERE contains(lower(text), 'license')")
def mentions(spark, sf_dir):
    at = F.instr(F.lower("text"), "license")
    d = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("license")))
    return d.select("doc_id", F.regexp_count(F.lower("text"), F.lit("license")).cast("long").alias("mentions"), F.when(at > 0, F.substring("text", F.greatest(at - 300, F.lit(1)), F.lit(607))).alias("excerpt"))
