"""Scans and sinks: tables, JSON lines, unique inserts, upserts and deletes."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, *columns: str) -> DataFrame:
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    return df


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def insert_unique(existing: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """existing with those of rows whose key is new, the first of each by order."""
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")
    return existing.unionByName(first.join(existing.select(key), key, "left_anti").select(*existing.columns))


def upsert(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows, and what existing has under other keys."""
    return rows.unionByName(existing.join(rows.select(key), key, "left_anti").select(*rows.columns))


def delete(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return existing.join(keys.select(key), key, "left_anti")
