"""The request log as a stream, and first-wins dedupe of URLs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolling_counts(log: DataFrame, window: str = "1 hour", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(host, start, end, requests) of sliding windows over (host, ts), with a watermark."""
    counted = log.withWatermark("ts", late).groupBy("host", F.window("ts", window, slide)).agg(F.count("*").alias("requests"))
    return counted.select("host", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "requests")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    counted = log.withWatermark("ts", late).groupBy("host", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("requests"))
    return counted.select("host", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests")


def first_urls(stream: DataFrame, late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["url"])
