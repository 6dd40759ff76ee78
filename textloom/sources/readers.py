"""Readers that fail on bad input: product catalogues, evaluation sets, logs and single rows."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.tables import json_lines, require


def listed(value: Column) -> Column:
    """An array of strings without null and empty ones."""
    return F.filter(F.coalesce(value, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def products(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """(asin, title, text, store, category, price, rating, also) of rows (parent_asin, title, description, features, categories, main_category, store, price,
    average_rating, bought_together): text is the title, the description and the features; the category is the last one. Rows
    without id, title or text go; a price that is no number is null. limit, if given, takes the first rows by id: the feature of a trial load."""
    require(rows, "parent_asin", "title")
    for name, kind in [("description", "array<string>"), ("features", "array<string>"), ("categories", "array<string>"), ("bought_together", "array<string>"), ("main_category", "string"), ("store", "string"), ("price", "string"), ("average_rating", "double")]:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    said, features = F.array_join(listed(F.col("description")), " "), F.array_join(listed(F.col("features")), " ")
    text = F.concat_ws("\n", F.nullif("title", F.lit("")), F.nullif(said, F.lit("")), F.when(features != "", F.concat(F.lit("Features: "), features)))
    category = F.coalesce(F.try_element_at(listed(F.col("categories")), F.lit(-1)), F.nullif("main_category", F.lit("")), F.lit("Unknown"))
    out = rows.select(F.col("parent_asin").alias("asin"), "title", F.trim(text).alias("text"), F.coalesce(F.nullif("store", F.lit("")), F.lit("Unknown")).alias("store"), category.alias("category"), F.col("price").try_cast("double").alias("price"), F.col("average_rating").alias("rating"), listed(F.col("bought_together")).alias("also"))
    out = out.where("asin <> '' and title <> '' and text <> ''")
    return out.orderBy("asin").limit(limit) if limit is not None else out


def evaluation_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(question, expect_sources) and (question, why) of a JSON file with answerable and unanswerable questions; a side that is missing or empty is an error."""
    schema = "answerable array<struct<question string, expect_sources array<string>, note string>>, unanswerable array<struct<question string, why string>>"
    held = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if not (found := held.select(F.size("answerable"), F.size("unanswerable")).first()) or min(x or 0 for x in found) <= 0:
        raise ValueError(f"{path} needs questions of both kinds")
    return held.select(F.explode("answerable").alias("q")).select("q.question", "q.expect_sources"), held.select(F.explode("unanswerable").alias("q")).select("q.question", "q.why")


def session_summaries(spark: SparkSession, path: str, turns: int | None = None) -> DataFrame:
    """(session_id, turns, cost) of a cost log's session summaries, those of so many turns if given; the other lines are calls. Broken lines are left out."""
    rows = json_lines(spark, path, "type string, session_id string, turns int, total_cost double").where("type = 'session_summary'")
    return (rows.where(F.col("turns") == turns) if turns is not None else rows).select("session_id", "turns", F.col("total_cost").alias("cost"))


def lookup(df: DataFrame, key: str, value) -> dict:
    """The row of a unique key, as a dict; LookupError if it isn't there, ValueError if it is there twice."""
    found = df.where(F.col(key) == F.lit(value)).limit(2).collect()
    if not found:
        raise LookupError(f"no {key} {value}")
    if len(found) > 1:
        raise ValueError(f"{key} {value} is there more than once")
    return found[0].asDict(recursive=True)
