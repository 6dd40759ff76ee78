"""Streams against the same rows at once."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from textloom.streaming import rates

START = datetime(2024, 1, 1)
FAR = START + timedelta(days=3)


def streamed(spark, tmp_path, make, batches):
    """Rows that make(stream) gives when each of batches, (host, ts, url) rows, arrives as a file of its own."""
    source, name = str(tmp_path / "in"), f"t{abs(hash(str(tmp_path)))}"
    schema = "host string, ts timestamp, url string"
    for at, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        if at == 0:
            query = make(spark.readStream.schema(schema).parquet(source)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
    query.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def at(minutes, host="a", url="u"):
    return (host, START + timedelta(minutes=minutes), url)


def test_rolling_counts(spark, tmp_path):
    first = [at(0), at(10), at(59), at(5, "b")]
    found = streamed(spark, tmp_path, lambda s: rates.rolling_counts(s, "1 hour", "30 minutes"), [first, [("z", FAR, "u")], [at(1), ("z", FAR, "u")]])
    of_a = {r[1]: r[3] for r in found if r[0] == "a"}
    assert of_a == {START - timedelta(minutes=30): 2, START: 3, START + timedelta(minutes=30): 1}  # the row that came after the watermark is left out
    assert {r[3] for r in found if r[0] == "b"} == {1}


def test_sessions(spark, tmp_path):
    found = streamed(spark, tmp_path, rates.sessions, [[at(0), at(20)], [at(45), at(80)], [("z", FAR, "u")], [("z", FAR, "u")]])
    assert sorted((r[1], r[2], r[3]) for r in found if r[0] == "a") == [(START, START + timedelta(minutes=75), 3), (START + timedelta(minutes=80), START + timedelta(minutes=110), 1)]


def test_first_urls(spark, tmp_path):
    found = streamed(spark, tmp_path, rates.first_urls, [[at(0, url="x"), at(1, url="y")], [at(2, url="x"), at(3, url=None), at(4, url=None)]])
    assert sorted(str(r[2]) for r in found) == ["None", "x", "y"]


def test_batch_and_stream_agree(spark, tmp_path):
    rows = [at(m, h) for m in range(0, 200, 7) for h in "ab"]
    whole = rates.sessions(spark.createDataFrame(rows, "host string, ts timestamp, url string"), "5 minutes").where(F.col("host") == "a").count()
    found = streamed(spark, tmp_path, lambda s: rates.sessions(s, "5 minutes"), [rows, [("z", FAR, "u")], [("z", FAR, "u")]])
    assert whole == len([r for r in found if r[0] == "a"]) == 29
