"""Sinks: pushed documents, content-addressed chunks, graphs, logs and histories. Each gives the rows to write; swap and append write them."""

import logging
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.fixed import GRAPH_TEXT_CHARS, SOURCE_CHARS, TITLE_CHARS, URL_CHARS


def pushed(rows: DataFrame, existing: DataFrame | None = None, order: str = "id") -> DataFrame:
    """rows (order, title, url, text, source) as the store takes them: fields clipped, Untitled for no title, code 201 for a URL's first row, 409 for one that is there."""
    title = F.substring(F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled")), 1, TITLE_CHARS)
    clipped = rows.withColumns({"title": title, "url": F.substring("url", 1, URL_CHARS), "source": F.substring("source", 1, SOURCE_CHARS)})
    first = clipped.groupBy("url").agg(F.min(order).alias("__first"))
    if existing is not None:
        first = first.join(existing.select("url").distinct(), "url", "left_anti")
    return clipped.join(first, "url", "left").withColumn("code", F.when(F.col(order) == F.col("__first"), 201).otherwise(409)).drop("__first")


def upserted(existing: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: of rows the last by order, else what existing has."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*existing.columns), order).alias("__row")).select("__row.*")
    return last.unionByName(existing.join(rows.select(key), key, "left_anti"))


def graph(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (asin, title, text, price, rating, store, category, also): vertices (kind, name, title, text, price, rating) and edges (src, rel, dst), each once. Products known only as also have no fields."""
    own = products.groupBy("asin").agg(F.min(F.struct("title", F.substring("text", 1, GRAPH_TEXT_CHARS).alias("text"), "price", "rating")).alias("p"))
    edge = lambda rel, dst: products.select(F.col("asin").alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"))
    edges = edge("SOLD_BY", F.col("store")).unionByName(edge("IN_CATEGORY", F.col("category"))).unionByName(edge("ALSO_BOUGHT", F.explode("also"))).where("dst is not null").distinct()
    other = edges.where("rel = 'ALSO_BOUGHT'").select(F.col("dst").alias("asin")).distinct().join(own, "asin", "left_anti")
    bare = lambda df, kind, name: df.select(F.lit(kind).alias("kind"), name.alias("name")).distinct()
    vertices = own.select(F.lit("product").alias("kind"), F.col("asin").alias("name"), "p.*")
    for part in (bare(other, "product", F.col("asin")), bare(edges.where("rel = 'SOLD_BY'"), "store", F.col("dst")), bare(edges.where("rel = 'IN_CATEGORY'"), "category", F.col("dst"))):
        vertices = vertices.unionByName(part, allowMissingColumns=True)
    return vertices, edges


def feed_failures(existing: DataFrame, failures: DataFrame) -> DataFrame:
    """Records (canonical_url, status, detail) with a row per feed that failed, whatever the number of tries: the last detail by attempt."""
    rows = failures.select(F.concat(F.lit("feed:"), "feed_url").alias("canonical_url"), F.lit("fetch_failed").alias("status"), F.col("error").alias("detail"), "attempt")
    return upserted(existing.select("canonical_url", "status", "detail"), rows, "canonical_url", "attempt")


def append_lines(rows: DataFrame, path: str) -> bool:
    """Appends rows as JSON lines; a failure is logged and told, not raised, as a log must not stop the work."""
    try:
        rows.write.mode("append").json(path)
    except Exception:
        logging.getLogger(__name__).exception("could not append to %s", path)
        return False
    return True


def swap(rows: DataFrame, path: str) -> None:
    """Replaces the table at path by rows, which may read it: the new table is whole before the old one goes."""
    spark, fresh = rows.sparkSession, f"{path}-{uuid.uuid4().hex}"
    rows.write.parquet(fresh)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at(path), True)
    if not fs.rename(at(fresh), at(path)):
        raise OSError(f"the new table stays at {fresh}")


def live(history: DataFrame, conversation: str, seq: str, marker: Column) -> DataFrame:
    """The messages of a rolled-back history: those up to the last marker row of their conversation; all where there is none. The log itself keeps every row."""
    last = history.where(marker).groupBy(conversation).agg(F.max(seq).alias("__last"))
    return history.join(last, conversation, "left").where(F.col(seq) <= F.coalesce("__last", F.col(seq))).drop("__last")
