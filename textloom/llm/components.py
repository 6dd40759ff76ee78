"""Connected components: of a few million pairs in memory (numpy), and of any number of them by star contraction (Spark)."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialise


def contract(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a[i]-b[i]: each node's smallest reachable node."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def connected_components(links: DataFrame) -> DataFrame:
    """Of links (a long, b long): one row (node, component) per node, component being the smallest node reachable.

    Large-star and small-star contraction in turn; each round is written to the shared folder. Only minima per node are
    computed, which combine before the shuffle, so a hub of millions of links gathers in no task. Nulls and loops are left out;
    links may repeat. No links: no rows.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    edges = materialise(links.where("a <> b").select(a.alias("a"), b.alias("b")).distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = materialise(small.distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
