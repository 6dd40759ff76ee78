"""The corpus pipeline: toxicity, SimHash near-dedup, benchmark decontamination, mixing to target weights, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs. All
but the last return the columns that docs came with.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, mixing, sharding, simhash, toxicity
from textloom.llm.common import materialise, quoted

#: SQL can't express compression against a dictionary, so there is none for the whole; tests hold each stage against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it learns from labels over docs, as op10 does. With nothing learned that tells the classes apart, all stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.learned_rows())
    scored = toxicity.with_score(docs, model, F.col("text"), "__toxicity")
    return scored.where(~toxicity.rejected(F.col("__toxicity"), model)).select(*map(quoted, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: that of the smallest doc_id, null last; of its repeated rows any one. Components that share an id, or have none, keep a row each."""
    numbered = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"))
    marked = materialise(simhash.with_fingerprints(numbered, F.col("doc.text")), "marked")
    narrow = marked.select("doc.doc_id", "row", "fingerprint")
    of_print = narrow.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    found = simhash.placed(narrow).select("fp", "component")
    keep = of_print.join(found, "fp").groupBy("component").agg(F.min("first").alias("first")).select("first.row")
    return marked.join(keep, "row", "left_semi").select("doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no run of eight words of a benchmark item occurs, nor two items shorter than that; one short item alone is no evidence."""
    found = decontaminate.decontaminate(docs.select(F.col("text"), F.struct("*").alias("doc")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where((F.col("longest_window") < decontaminate.WINDOW) & ~F.col("contaminated")).select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents mixed to the sources' target weights: a row per copy, none to two of each document, at each source's budget to half a document."""
    rows = docs.select(F.struct("*").alias("__row"), F.col("source").alias("__from"), "doc_id", mixing.words(F.col("text")).alias("__words"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("__md5"))
    mixed = mixing.mix(rows, F.col("__from"), F.col("__words"), [F.col("doc_id"), F.col("__md5")])
    copies = F.expr("sequence(1, greatest(__copies, 1))")
    return mixed.withColumn("__copies", mixing.whole_copies(mixed)).where("__copies > 0").withColumn("__copy", F.explode(copies)).select("__row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with shard, 0 to 15, and slot, its place there."""
    placed = materialise(sharding.with_shard(docs, sharding.Tree.of(16), F.col("doc_id")), "sharded")  # else the draws are made thrice
    return sharding.with_slot(placed, "shard", [F.col("doc_id"), F.xxhash64("text")])


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
