"""Queries over sinks, catalogues, crawl outcomes and conversations."""

from pyspark.sql import functions as F

from textloom.functions.fixed import STATUS_GROUPS
from textloom.operators import crawl, dialogue
from textloom.plans.corpus import GROUPS, STATUS, set_checkpoints, statuses
from textloom.plans.registry import query
from textloom.sources import readers, sinks
from textloom.sources.tables import table


@query("""WITH d AS (SELECT doc_id, left(coalesce(nullif(trim(split_part(text, chr(10), 1), ' '), ''), 'Untitled'), 500) AS title, 'https://store.example/' || md5(text) AS url, left(source, 200) AS source FROM documents)
SELECT doc_id, title, url, source, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY url) THEN 201 ELSE 409 END AS code FROM d""")
def pushed_documents(spark, sf_dir):
    """Documents as the store takes them, under the URL of their content: the first of a text is new, its copies are refused."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.concat(F.lit("https://store.example/"), F.md5("text")).alias("url"), "source")
    return sinks.pushed(d, order="doc_id").select("doc_id", "title", "url", "source", "code")


@query("SELECT sha256(text) AS id, coalesce(max(CASE WHEN doc_id % 3 > 0 THEN doc_id END), max(doc_id)) AS doc_id FROM documents GROUP BY 1")
def content_upsert(spark, sf_dir):
    """Two loads of documents under their content's hash: one row each, the second load's last where it has one, else the first's."""
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("id"), "doc_id")
    old, new = d.where("doc_id % 3 = 0"), d.where("doc_id % 3 > 0")
    return sinks.upserted(old.groupBy("id").agg(F.max("doc_id").alias("doc_id")), new, "id", "doc_id")


PRODUCTS = "SELECT CAST(p_partkey AS VARCHAR) AS asin, p_name AS title, p_brand AS store, p_type AS category, p_retailprice AS price FROM part WHERE p_name <> ''"


def catalogue(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return readers.products(p.select(F.col("p_partkey").cast("string").alias("parent_asin"), F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("categories"), F.col("p_brand").alias("store"), F.col("p_retailprice").cast("string").alias("price")))


@query(PRODUCTS)
def catalogue_products(spark, sf_dir):
    return catalogue(spark, sf_dir).select("asin", "title", "store", "category", "price")


@query(f"""WITH p AS ({PRODUCTS}) SELECT kind, count(*) AS n FROM (SELECT 'product' AS kind, asin FROM p UNION SELECT 'store', store FROM p UNION SELECT 'category', category FROM p UNION ALL SELECT rel, src || '|' || dst FROM (SELECT DISTINCT 'SOLD_BY' AS rel, asin AS src, store AS dst FROM p UNION SELECT 'IN_CATEGORY', asin, category FROM p)) GROUP BY kind""")
def product_graph(spark, sf_dir):
    """How many vertices and edges of each kind the catalogue's graph has."""
    vertices, edges = sinks.graph(catalogue(spark, sf_dir))
    return vertices.select("kind").unionByName(edges.select(F.col("rel").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query(STATUS + f", dim AS (SELECT * FROM (VALUES {GROUPS}) v(status, status_group)), c AS (SELECT dim.status, status_group, count(status.status) AS n FROM dim LEFT JOIN status USING (status) GROUP BY ALL) SELECT *, CAST(round(n * 100.0 / sum(n) OVER (), 1) AS DOUBLE) AS pct FROM c")
def status_report(spark, sf_dir):
    return crawl.report(statuses(spark, sf_dir))


@query(STATUS + f"SELECT count(*) AS rows, (SELECT count(*) FROM documents) AS total, count(*) = (SELECT count(*) FROM documents) AS whole, count(DISTINCT doc_id) AS ids, count(*) FILTER (status IS NULL OR status NOT IN ({', '.join(map(repr, STATUS_GROUPS))})) AS unknown FROM status")
def partition_integrity(spark, sf_dir):
    """Whether every document ends in one known status: rows after the plan, rows before it, ids, and rows of no known status."""
    total = table(spark, sf_dir, "documents").agg(F.count("*").alias("total"))
    found = statuses(spark, sf_dir).agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids"), F.count_if(F.col("status").isNull() | ~F.col("status").isin(list(STATUS_GROUPS))).alias("unknown"))
    return found.crossJoin(total).select("rows", "total", (F.col("rows") == F.col("total")).alias("whole"), "ids", "unknown")  # of one row each


@query()
def crawl_outcomes(spark, sf_dir):
    """The status of every page as if fetched in order of ids, all allowed. SQL can't express the rounds of near duplicates; tests hold the stages to a table of cases."""
    set_checkpoints(spark)
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.lit(True).alias("allowed"), F.lit(True).alias("within_limit"), F.lit(None).cast("int").alias("http_status"), F.lit(None).cast("string").alias("error"), "html", F.lit(None).cast("string").alias("pushed"))
    return crawl.outcomes(pages)


@query("""WITH m AS (SELECT conv_id, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS messages FROM conversations),
c AS (SELECT conv_id, any_value(messages) AS messages, CAST(sum(n) AS BIGINT) // 4 AS est_tokens, max(CASE WHEN role <> 'tool' AND place <= messages - 6 THEN place END) AS split FROM m GROUP BY conv_id)
SELECT conv_id, messages, est_tokens, CASE WHEN messages > 8 AND est_tokens >= 100 AND split > 0 THEN split END AS split FROM c""")
def summary_splits(spark, sf_dir):
    """Where each conversation of a hundred estimated tokens or more may be cut for a summary."""
    return dialogue.split_points(table(spark, sf_dir, "conversations"), "conv_id", "turn", tokens=100)
