"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer any context limit."""

import base64

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import append_columns

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this public vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 128


def encoder(data: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: Column, vocabulary: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of each whole text; null and empty texts have none. vocabulary: a ranks file on the driver, of fixed size, sent to the tasks."""
    with open(vocabulary, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        encode = encoder(data.value).encode_ordinary

        def work(column):
            return [pa.array([len(encode(t)) if t else 0 for t in column.to_pylist()], pa.int64())]

        return work

    return append_columns(df, [text], [T.StructField(name, T.LongType(), False)], make)


def histogram(lengths: DataFrame, length: str = "n_tokens", by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Of one row per document, or per so many as the column weight says: (by, length, n_docs) and, for a context limit of that length, what sums from either end answer.

    total_docs, total_tokens: of all; docs_at_least, tokens_at_least: of documents no shorter; docs_share: the share of
    documents no longer (the smallest length with docs_share >= q is the q-quantile); tokens_within: the tokens left when every document is cut
    to the limit. Lengths are summed in blocks, so a task holds a block or one row per block. Null lengths are left out.
    """
    group = [F.col(c) for c in by]
    counts = lengths.where(F.col(length).isNotNull()).groupBy(*by, F.col(length).cast("long").alias("length")).agg((F.sum(weight) if weight else F.count("*")).cast("long").alias("n_docs"))
    counts = counts.withColumn("__tokens", F.col("length") * F.col("n_docs")).withColumn("__block", F.floor(F.col("length") / BLOCK))
    blocks = counts.groupBy(*by, "__block").agg(F.sum("n_docs").alias("__d"), F.sum("__tokens").alias("__t"))
    after = Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.desc("__block"))
    every = Window.partitionBy(*(group or [F.lit(0)]))
    blocks = blocks.select(*by, "__block", (F.sum("__d").over(after) - F.col("__d")).alias("__d"), (F.sum("__t").over(after) - F.col("__t")).alias("__t"), F.sum("__d").over(every).alias("total_docs"), F.sum("__t").over(every).alias("total_tokens"))
    within = Window.partitionBy(*by, "__block").orderBy(F.desc("length"))
    counts_in = counts.withColumn("__di", F.sum("n_docs").over(within)).withColumn("__ti", F.sum("__tokens").over(within))
    both = counts_in.alias("c").join(blocks.alias("b"), (F.col("c.__block") == F.col("b.__block")) & _same(by))
    docs, tokens = F.col("__di") + F.col("__d"), F.col("__ti") + F.col("__t")
    return both.select(
        *(F.col(f"c.{c}") for c in by), "length", "n_docs", "total_docs", "total_tokens", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"),
        ((F.col("total_docs") - docs + F.col("n_docs")) / F.col("total_docs")).alias("docs_share"), (F.col("total_tokens") - tokens + F.col("length") * docs).alias("tokens_within"),
    )


def _same(by) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"c.{c}").eqNullSafe(F.col(f"b.{c}"))
    return out


def at_limit(table: DataFrame, limit: int) -> dict:
    """For any context limit, of an ungrouped histogram: documents and tokens in all, documents cut, tokens left. Two lookups in the table."""
    above = table.where(F.col("length") > limit).orderBy("length").first()
    total = table.first()
    if total is None:
        return {"docs": 0, "tokens": 0, "docs_cut": 0, "tokens_within": 0}
    cut, beyond = (above.docs_at_least, above.tokens_at_least) if above else (0, 0)
    return {"docs": total.total_docs, "tokens": total.total_tokens, "docs_cut": cut, "tokens_within": total.total_tokens - beyond + limit * cut}
