"""Which URLs a host's robots file lets an agent fetch, and how long it asks to wait."""

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REMEMBERED = 10_000


def decisions(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """urls (url, host, more) with allowed and crawl_delay, by robots (host, status, body), one row a host.

    A file that isn't there (404) allows all. One that couldn't be read (401, 403, 5xx, null status) and a host without a row allow nothing.
    Any other answer is read as rules; a null body has none. Rows with a null host are not allowed.
    """

    @F.pandas_udf("allowed boolean, crawl_delay double")
    def judge(url: pd.Series, body: pd.Series) -> pd.DataFrame:
        known: dict[str, RobotFileParser] = {}

        def one(u, b):
            if b not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[b] = RobotFileParser()
                known[b].parse(b.splitlines())
            delay = known[b].crawl_delay(agent)
            return known[b].can_fetch(agent, u), None if delay is None else float(delay)

        return pd.DataFrame([one(u or "", b or "") for u, b in zip(url, body, strict=True)], columns=["allowed", "crawl_delay"]).astype({"crawl_delay": float})

    status = F.col("__status")
    joined = urls.join(robots.select(F.col("host").alias("__host"), F.col("status").alias("__status"), F.col("body").alias("__body")), F.col("host") == F.col("__host"), "left")
    read = joined.withColumn("__said", judge(F.col("url"), F.col("__body")))
    unread = status.isNull() | status.isin(401, 403) | (status >= 500)
    verdict: Column = F.when(unread, False).when(status == 404, True).otherwise(F.col("__said.allowed"))
    return read.select(*urls.columns, verdict.alias("allowed"), F.when(~unread & (status != 404), F.col("__said.crawl_delay")).alias("crawl_delay"))
