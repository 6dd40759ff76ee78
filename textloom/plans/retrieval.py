"""Queries over embeddings and keywords: top-k, floors, centroids, BM25, fusion, recall."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions.text import tokens
from textloom.operators import retrieval as rt
from textloom.plans.corpus import set_checkpoints
from textloom.plans.registry import query
from textloom.sources.tables import table

#: The stated query set: every vector whose id is divisible by 100, against all others.
DOT = "list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(e.embedding[i] AS DOUBLE)))"
SIMS = f"WITH sims AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, q.label AS wanted, round({DOT}, 6) AS similarity FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM sims) "


def ranked(spark, sf_dir, k=12):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), F.col("label").alias("wanted"))
    return rt.vector_top_k(q, e, k)


@query(SIMS + "SELECT query_id, vec_id, label, similarity, rank FROM ranked WHERE rank <= 12")
def vector_top_k(spark, sf_dir):
    return ranked(spark, sf_dir).select("query_id", "vec_id", "label", "similarity", F.col("rank").cast("long").alias("rank"))


@query(SIMS + "SELECT query_id, count(*) FILTER (similarity >= 0.425) AS accepted, count(*) FILTER (similarity < 0.425) AS rejected, max(similarity) AS best, max(similarity) < 0.425 AS refused FROM ranked WHERE rank <= 12 GROUP BY query_id")
def evidence_floor(spark, sf_dir):
    hit = F.col("similarity") >= 0.425
    return ranked(spark, sf_dir).groupBy("query_id").agg(F.count_if(hit).alias("accepted"), F.count_if(~hit).alias("rejected"), F.max("similarity").alias("best"), (F.max("similarity") < 0.425).alias("refused"))


SWEEP = SIMS + """, floors AS (SELECT CAST(round(0.2 + i * 0.025, 3) AS DOUBLE) AS floor FROM range(0, 19) t(i)),
per AS (SELECT floor, query_id, wanted % 2 = 0 AS answerable, bool_or(similarity >= floor AND label = wanted) AS found, bool_or(similarity >= floor) AS evidence FROM ranked, floors WHERE rank <= 12 GROUP BY ALL)
SELECT floor, count(*) FILTER (answerable) AS answerable, count(*) FILTER (answerable AND found) AS correct, count(*) FILTER (NOT answerable) AS unanswerable, count(*) FILTER (NOT answerable AND NOT evidence) AS refused FROM per GROUP BY floor"""


def swept(spark, sf_dir):
    floors = spark.range(19).select(F.round(0.2 + F.col("id") * 0.025, 3).alias("floor"))
    rows = ranked(spark, sf_dir).crossJoin(F.broadcast(floors))
    per = rows.groupBy("floor", "query_id", (F.col("wanted") % 2 == 0).alias("answerable")).agg(F.bool_or((F.col("similarity") >= F.col("floor")) & (F.col("label") == F.col("wanted"))).alias("found"), F.bool_or(F.col("similarity") >= F.col("floor")).alias("evidence"))
    a = F.col("answerable")
    return per.groupBy("floor").agg(F.count_if(a).alias("answerable"), F.count_if(a & F.col("found")).alias("correct"), F.count_if(~a).alias("unanswerable"), F.count_if(~a & ~F.col("evidence")).alias("refused"))


@query(SWEEP)
def floor_sweep(spark, sf_dir):
    return swept(spark, sf_dir)


@query("WITH s AS (" + SWEEP + ") SELECT floor AS best_floor, CAST(round(b, 6) AS DOUBLE) AS balanced FROM (SELECT floor, (coalesce(correct / nullif(answerable, 0)::DOUBLE, 0) + coalesce(refused / nullif(unanswerable, 0)::DOUBLE, 0)) / 2 AS b FROM s) ORDER BY b DESC, floor LIMIT 1")
def best_floor(spark, sf_dir):
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    b = (rate("correct", "answerable") + rate("refused", "unanswerable")) / 2
    return swept(spark, sf_dir).withColumn("b", b).orderBy(F.desc("b"), "floor").limit(1).select(F.col("floor").alias("best_floor"), F.round("b", 6).alias("balanced"))


@query(SIMS + ", first AS (SELECT query_id, min(rank) FILTER (label = wanted) AS r FROM ranked GROUP BY query_id) SELECT count(*) AS queries, count(*) FILTER (r <= 1) AS at_1, count(*) FILTER (r <= 2) AS at_2, count(*) FILTER (r <= 4) AS at_4, count(*) FILTER (r <= 8) AS at_8, count(*) FILTER (r <= 12) AS at_12, CAST(round(avg(coalesce(CASE WHEN r <= 12 THEN round(1.0 / r, 3) END, 0)), 6) AS DOUBLE) AS mrr FROM first")
def recall_at_k(spark, sf_dir):
    first = ranked(spark, sf_dir).groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("wanted"), F.col("rank"))).alias("r"))
    at = [F.count_if(F.col("r") <= k).alias(f"at_{k}") for k in (1, 2, 4, 8, 12)]
    return first.agg(F.count("*").alias("queries"), *at, F.round(F.avg(F.coalesce(F.round(1 / F.col("r"), 3), F.lit(0.0))), 6).alias("mrr"))


@query("WITH c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) t(i) GROUP BY label, i), n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM c GROUP BY label) SELECT e.vec_id, round(sum(CAST(e.embedding[c.i] AS DOUBLE) * c.m) / any_value(n.norm), 6) AS similarity, round(sum(CAST(e.embedding[c.i] AS DOUBLE) * c.m) / any_value(n.norm), 6) >= 0.35 AS allowed FROM embeddings e JOIN c USING (label) JOIN n USING (label) GROUP BY e.vec_id")
def centroid_gate(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroid = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("c"))
    sims = e.join(centroid, "label").select("vec_id", F.round(rt.dot(F.col("embedding"), F.col("c")) / F.sqrt(rt.dot(F.col("c"), F.col("c"))), 6).alias("similarity"))
    return sims.withColumn("allowed", F.col("similarity") >= 0.35)


TERMS = "regexp_extract_all(lower(text), '[a-z0-9'']+')"
BM25 = f"""WITH docs AS (SELECT doc_id, {TERMS} AS terms FROM documents), stats AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM docs),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM docs) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS}) AS term FROM benchmark),
scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), stats GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) """


def keyword_ranked(spark, sf_dir, k=12):
    set_checkpoints(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(tokens(F.col("text"))).alias("term"))
    return rt.bm25(queries, docs, k)


@query(BM25 + "SELECT query_id, doc_id, round(score, 4) AS score FROM ranked WHERE rank <= 3")
def bm25_top_k(spark, sf_dir):
    return keyword_ranked(spark, sf_dir, 3).select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query()
def hybrid_fusion(spark, sf_dir):
    """Reciprocal ranks of keywords (0.7) and of exact containment of the passage (0.3)."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    held = docs.crossJoin(F.broadcast(items.select("item_id", F.col("text").alias("passage")))).where(F.contains("text", "passage")).select(F.col("item_id").alias("query_id"), "doc_id")
    held = held.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    return rt.fuse([(keyword_ranked(spark, sf_dir), 0.7), (held, 0.3)], 4).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("SELECT item_id, count(d.doc_id) AS holders, min(d.doc_id) AS first_doc FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def passages_found(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    held = table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(items), F.contains("text", "passage")).select("item_id", "doc_id")
    return items.join(held, "item_id", "left").groupBy("item_id").agg(F.count("doc_id").alias("holders"), F.min("doc_id").alias("first_doc"))


@query(BM25 + ", packed AS (SELECT query_id, doc_id, rank, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM ranked JOIN documents USING (doc_id) WHERE rank <= 12) SELECT query_id, CAST(count(*) AS BIGINT) AS docs, CAST(max(used) AS BIGINT) AS used FROM packed WHERE rank = 1 OR used <= 8000 GROUP BY query_id")
def context_budget(spark, sf_dir):
    lengths = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    packed = rt.within_budget(keyword_ranked(spark, sf_dir).join(lengths, "doc_id"), "query_id", F.col("n"), 8000)
    return packed.groupBy("query_id").agg(F.count("*").alias("docs"), F.max("used").cast("long").alias("used"))


@query("SELECT CASE WHEN p AND q THEN 'hit' WHEN p THEN 'false_alarm' WHEN q THEN 'miss' ELSE 'pass' END AS outcome, count(*) AS n FROM (SELECT length(text) >= 300 AS p, quality = 1 AS q FROM documents JOIN labels USING (doc_id)) GROUP BY 1")
def gate_accuracy(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select((F.length("text") >= 300).alias("p"), (F.col("quality") == 1).alias("q"))
    return both.groupBy(F.when(F.expr("p and q"), "hit").when(F.expr("p"), "false_alarm").when(F.expr("q"), "miss").otherwise("pass").alias("outcome")).agg(F.count("*").alias("n"))
