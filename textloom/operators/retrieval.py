"""Exact retrieval: vectors, keywords, fusion, evidence floors and context budgets."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import keywords, nearest

RRF = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(pairs: DataFrame, query: str, score: str, tie: str, k: int) -> DataFrame:
    """pairs with rank 1 to k in each query: higher scores first, ties by the lower tie."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), F.asc_nulls_last(tie)))).where(F.col("rank") <= k)


def vector_top_k(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(queries' columns but qv, vec_id, label, similarity, rank) for a stated query set (query_id, qv, more) against all of corpus (vec_id, embedding, label).

    Exact: every query meets every row, in blocks of a matrix product; see nearest. The work is queries times rows, a task's memory is not.
    """
    pairs = nearest.candidates(queries, corpus.select("vec_id", "embedding", "label"), k).withColumn("similarity", F.round("raw", 6)).drop("raw")
    return top_k(pairs, "query_id", "similarity", "vec_id", k)


def bm25(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) by Okapi BM25 of the texts that share a term; queries (query_id, term), docs (doc_id, text). Needs a checkpoint folder."""
    hits = keywords.candidates(queries, docs, k)
    return top_k(hits.select("query_id", "doc_id", F.round("raw", 6).alias("score")), "query_id", "score", "doc_id", k)


def fuse(lists: list[tuple[DataFrame, float]], k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): weighted reciprocal ranks of lists (query_id, doc_id, rank)."""
    rows = None
    for ranked, weight in lists:
        part = ranked.select("query_id", "doc_id", (F.lit(weight) / (RRF + F.col("rank"))).alias("w"))
        rows = part if rows is None else rows.unionByName(part)
    return top_k(rows.groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 9).alias("score")), "query_id", "score", "doc_id", k)


def within_budget(ranked: DataFrame, query: str, length: Column, budget: int) -> DataFrame:
    """The first rows of each query, by rank, whose running length fits the budget; the first always stays."""
    running = F.sum(length).over(Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", running).where((F.col("rank") == 1) | (F.col("used") <= budget))
