"""Sharding by a hierarchical weighted hash tree: region, rack and shard are drawn in turn, by built-in functions only.

At each level every child draws -ln(u) / weight, u being a hash of the row's key and the child's path, and the least draw wins: a
child gets rows in proportion to its weight. A draw depends on nothing but key, path and weight, so a changed weight moves
rows only into or out of the subtrees whose weights change; a row whose path avoids them stays.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialise, sums_before, without

#: A slot is numbered within a bucket of about so many rows.
BUCKET_ROWS = 100_000


@dataclass(frozen=True)
class Tree:
    """Regions of racks of (shard, weight). Weights are positive; a region's or rack's is the sum below it."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def of(shards: int, regions: int = 2, racks: int = 2, base: int = 16) -> "Tree":
        """The first base shards in regions of racks; each further shard opens a region of its own, so that it takes rows and no other moves."""
        first = list(range(min(shards, base)))
        per_region = -(-len(first) // regions)
        grid = [first[i : i + per_region] for i in range(0, len(first), per_region)]
        per_rack = [-(-len(g) // racks) for g in grid]
        laid = [tuple(tuple((s, 1.0) for s in g[i : i + n]) for i in range(0, len(g), n)) for g, n in zip(grid, per_rack, strict=True)]
        return Tree((*laid, *((((s, 1.0),),) for s in range(base, shards))))

    def weights(self) -> tuple[list[float], list[list[float]], list[list[list[float]]]]:
        shards = [[[w for _, w in rack] for rack in region] for region in self.regions]
        racks = [[sum(rack) for rack in region] for region in shards]
        return [sum(region) for region in racks], racks, shards


def draw(key: Column, path: Column, weight: Column) -> Column:
    """An exponential draw of the given weight: u is the first 52 bits of an md5, plus one half."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", key, path)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def winner(key: Column, parent: Column, weights: Column) -> Column:
    """The index of the child that draws least; ties go to the first."""
    draws = F.transform(weights, lambda w, i: F.struct(draw(key, F.concat_ws(".", parent, i.cast("string")), w).alias("d"), i.alias("i")))
    return F.array_min(draws)["i"].cast("int")


def literal(value) -> Column:
    return F.array(*(literal(v) for v in value)) if isinstance(value, list) else F.lit(value)


def with_shard(df: DataFrame, tree: Tree, key: Column, name: str = "shard") -> DataFrame:
    """df with the shard of key (any type; as text, null as the empty text); a column of that name is replaced. No shuffle."""
    regions, racks, shards = tree.weights()
    ids = [[[s for s, _ in rack] for rack in region] for region in tree.regions]
    out = df.select(*without(df, [name]), F.coalesce(key.cast("string"), F.lit("")).alias("__key"))
    out = out.withColumn("__region", winner(F.col("__key"), F.lit("r"), literal(regions)))
    out = out.withColumn("__rack", winner(F.col("__key"), F.concat_ws(".", F.lit("r"), F.col("__region").cast("string")), F.get(literal(racks), F.col("__region"))))
    at = lambda table: F.get(F.get(literal(table), F.col("__region")), F.col("__rack"))
    out = out.withColumn("__leaf", winner(F.col("__key"), F.concat_ws(".", F.lit("r"), F.col("__region").cast("string"), F.col("__rack").cast("string")), at(shards)))
    return out.withColumn(name, F.get(at(ids), F.col("__leaf"))).drop("__key", "__region", "__rack", "__leaf")


def with_slot(df: DataFrame, shard: str, order: list[Column], name: str = "slot") -> DataFrame:
    """df with each row's place in its shard, gapless from 0, in buckets of hashes of the order columns.

    Rows are numbered within a bucket of about BUCKET_ROWS rows, then by the number of rows in the shard's buckets before: no
    task holds a shard. Rows that agree in all of order share a bucket and are numbered in any order.
    """
    count = df.count()
    buckets = max(1, -(-count // BUCKET_ROWS))
    placed = df.select(*without(df, [name]), F.pmod(F.xxhash64(*order), F.lit(buckets)).alias("__bucket"), F.struct(*order).alias("__order"))
    before = sums_before(placed.groupBy(shard, "__bucket").agg(F.count("*").alias("__n")), [shard], "__bucket", "__n", "__before").drop("__n")
    numbered = placed.withColumn("__at", F.row_number().over(Window.partitionBy(shard, "__bucket").orderBy("__order")) - 1)
    return numbered.join(before, [shard, "__bucket"]).withColumn(name, (F.col("__at") + F.col("__before")).cast("long")).drop("__bucket", "__order", "__at", "__before")


def shard_documents(documents: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): law key, by doc_id and the number of shards.

    size: UTF-8 bytes of the text (null: none) plus 1; a null text has the CRC of the empty one; a null doc_id is the empty
    key; rows of equal ids share a shard. Empty table: no rows. The result holds these columns only.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("__text"))
    placed = with_shard(with_shard(narrow, Tree.of(shards), F.col("doc_id"), "shard"), Tree.of(shards + 1), F.col("doc_id"), "grown_shard")
    placed = materialise(placed, "shards")
    out = with_slot(placed, "shard", [F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("__text")])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
