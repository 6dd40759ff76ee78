"""Sinks, readers, crawl outcomes and dialogues, on rows of their own."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import crawl, dialogue
from textloom.plans.corpus import set_checkpoints
from textloom.sources import readers, sinks
from textloom.sources.tables import table

PROSE = " ".join(f"word{i} of the article number {i * 7 % 31}" for i in range(90))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_crawl_outcomes(spark):
    set_checkpoints(spark)
    page = lambda text: f"<html><body><p>{text}</p></body></html>"
    near, other = PROSE.replace("word3 ", "changed3 "), PROSE.replace("article", "story")
    cases = [
        (1, "https://a.example/1", True, True, 200, None, page(PROSE), None, "stored", None), (2, "https://a.example/1?utm_source=x", True, True, 200, None, page(other), None, "duplicate_url", 1),
        (3, "not a url", True, True, 200, None, page(PROSE), None, "invalid_url", None), (4, "https://a.example/4", False, True, None, None, None, None, "robots_disallowed", None),
        (5, "https://a.example/5", True, False, None, None, None, None, "rate_limited", None), (6, "https://a.example/6", True, True, None, "timeout", None, None, "fetch_failed", None),
        (7, "https://a.example/7", True, True, 401, None, page("no"), None, "login_required", None), (8, "https://a.example/8", True, True, 500, "HTTP 500", page(PROSE), None, "fetch_failed", None),
        (9, "https://a.example/9", True, True, 200, None, "<html><body></body></html>", None, "extraction_failed", None), (10, "https://a.example/10", True, True, 200, None, page("short text"), None, "junk", None),
        (11, "https://a.example/11", True, True, 200, None, page(PROSE), None, "duplicate_content", 1), (12, "https://a.example/12", True, True, 200, None, page(near), None, "duplicate_near", 1),
        (13, "https://a.example/13", True, True, 200, None, page(near), None, "duplicate_near", 1), (14, "https://a.example/14", True, True, 200, None, page(other), "rejected", "api_rejected", None),
        (15, "https://a.example/4", True, True, 200, None, page("x " * 900), None, "duplicate_url", 4), (16, "https://a.example/16", True, True, 200, None, page(PROSE.upper()), None, "duplicate_near", 1),
    ]
    schema = "id long, url string, allowed boolean, within_limit boolean, http_status int, error string, html string, pushed string"
    found = {r.id: r for r in crawl.outcomes(spark.createDataFrame([c[:8] for c in cases], schema)).collect()}
    assert {i: (r.status, r.duplicate_of) for i, r in found.items()} == {c[0]: (c[8], c[9]) for c in cases}
    assert found[10].detail == "[too_short]" and found[10].message == "Extracted text failed the quality checks. ([too_short])" and found[6].message == "Could not fetch the page. (timeout)"
    assert found[11].similarity == 1.0 and 0.85 <= found[12].similarity < 1 and found[16].similarity == 1.0
    report = {r.status: (r.n, r.pct) for r in crawl.report(spark.createDataFrame([(r.status,) for r in found.values()], "status string")).collect()}
    assert len(report) == 14 and report["duplicate_near"] == (3, 18.8) and report["paywall_partial"] == (0, 0.0)
    listed = spark.createDataFrame([("[too_short, high_link_density] text",), ("plain",), (None,)], "d string").select(crawl.rules_of(F.col("d")))
    assert [r[0] for r in listed.collect()] == [["too_short", "high_link_density"], [], []]
    dated = spark.createDataFrame([(1, "stored", "rss", "x"), (2, "stored", None, "bad"), (3, "stored", None, None), (4, "junk", "rss", "x")], "id long, status string, published_source string, published_raw string")
    assert rows(crawl.provenance(dated)) == [("none", 1), ("rss", 1), ("unparseable", 1)]


def test_pushed(spark):
    d = spark.createDataFrame([(1, None, "u1", "t", "s" * 300), (2, "  ", "u1", "t", None), (3, "x" * 600, "u2", "t", "s"), (4, "t", "u3", "t", "s")], "id long, title string, url string, text string, source string")
    found = {r.id: r for r in sinks.pushed(d, spark.createDataFrame([("u3",)], "url string")).collect()}
    assert [found[i].code for i in (1, 2, 3, 4)] == [201, 409, 201, 409] and found[1].title == found[2].title == "Untitled" and len(found[3].title) == 500 and len(found[1].source) == 200


def test_upserts_and_feeds(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert rows(sinks.upserted(old, spark.createDataFrame([("b", 5), ("b", 4), ("c", 9)], "k string, v int"), "k", "v")) == [("a", 1), ("b", 5), ("c", 9)]
    none = spark.createDataFrame([], "canonical_url string, status string, detail string")
    failures = spark.createDataFrame([("f1", "slow", 1), ("f1", "gone", 2), ("f2", "slow", 1)], "feed_url string, error string, attempt int")
    once = sinks.feed_failures(none, failures)
    assert rows(once) == rows(sinks.feed_failures(once, failures)) == [("feed:f1", "fetch_failed", "gone"), ("feed:f2", "fetch_failed", "slow")]


def test_graph(spark):
    p = spark.createDataFrame([("1", "t", "x" * 5000, 2.0, 4.0, "s", "c", ["2", "9", "9"]), ("2", "u", "y", None, None, "s", "d", []), ("1", "t", "x" * 5000, 2.0, 4.0, "s", "c", ["2"])], "asin string, title string, text string, price double, rating double, store string, category string, also array<string>")
    vertices, edges = sinks.graph(p)
    assert [(r.kind, r.name) for r in vertices.orderBy("kind", "name").collect()] == [("category", "c"), ("category", "d"), ("product", "1"), ("product", "2"), ("product", "9"), ("store", "s")]
    assert vertices.where("name = '1'").first().text == "x" * 4000
    assert rows(edges) == [("1", "ALSO_BOUGHT", "2"), ("1", "ALSO_BOUGHT", "9"), ("1", "IN_CATEGORY", "c"), ("1", "SOLD_BY", "s"), ("2", "IN_CATEGORY", "d"), ("2", "SOLD_BY", "s")]


def test_logs_tables_and_histories(spark, tmp_path):
    log = f"{tmp_path}/log"
    calls = spark.createDataFrame([("call", "s1", None, None), ("session_summary", "s1", 10, 0.5), ("session_summary", "s2", 3, 0.1)], "type string, session_id string, turns int, total_cost double")
    assert sinks.append_lines(calls, log) and sinks.append_lines(calls.limit(1), log)
    assert rows(readers.session_summaries(spark, log, 10)) == [("s1", 10, 0.5)] and readers.session_summaries(spark, log).count() == 2
    (tmp_path / "file").write_text("x")
    assert not sinks.append_lines(calls, f"{tmp_path}/file")
    path = f"{tmp_path}/t"
    spark.range(3).write.parquet(path)
    sinks.swap(spark.read.parquet(path).where("id > 0"), path)
    spark.catalog.refreshByPath(path)
    assert rows(spark.read.parquet(path)) == [(1,), (2,)]
    assert readers.lookup(spark.range(3), "id", 2) == {"id": 2}
    with pytest.raises(LookupError):
        readers.lookup(spark.range(3), "id", 7)
    history = spark.createDataFrame([("a", 1, "x"), ("a", 2, "mark"), ("a", 3, "partial"), ("b", 1, "x")], "c string, seq int, m string")
    assert rows(sinks.live(history, "c", "seq", F.col("m") == "mark")) == [("a", 1, "x"), ("a", 2, "mark"), ("b", 1, "x")]


def test_readers(spark, tmp_path):
    schema = "parent_asin string, title string, description array<string>, features array<string>, categories array<string>, main_category string, price string"
    made = spark.createDataFrame([("1", "T", ["d", None, "e"], ["f", ""], ["x", "y"], None, "9.5"), ("2", "T", None, None, [], "M", "none"), ("3", None, ["d"], None, None, None, None), (None, "T", None, None, None, None, None), ("4", "T", None, None, None, "", None)], schema)
    found = rows(readers.products(made).select("asin", "text", "category", "price", "store", "also"))
    assert found == [("1", "T\nd e\nFeatures: f", "y", 9.5, "Unknown", []), ("2", "T", "M", None, "Unknown", []), ("4", "T", "Unknown", None, "Unknown", [])]
    assert [r.asin for r in readers.products(made, 2).collect()] == ["1", "2"]
    with pytest.raises(ValueError, match="missing"):
        readers.products(made.drop("title"))
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"answerable": [{"question": "q", "expect_sources": ["s"]}], "unanswerable": [{"question": "n", "why": "w"}]}, indent=1))
    bad.write_text(json.dumps({"answerable": [{"question": "q"}], "unanswerable": []}))
    one, other = readers.evaluation_set(spark, str(good))
    assert rows(one) == [("q", ["s"])] and rows(other) == [("n", "w")]
    with pytest.raises(ValueError, match="both kinds"):
        readers.evaluation_set(spark, str(bad))


def test_dialogues(spark):
    talk = [("a", i, "tool" if i in (5, 6) else "user", "x" * 40) for i in range(12)] + [("b", i, "user", "x" * 400) for i in range(8)] + [("c", i, "tool", "x" * 99) for i in range(12)]
    found = rows(dialogue.split_points(spark.createDataFrame(talk, "c string, turn int, role string, text string"), "c", "turn", tokens=100))
    assert found == [("a", 12, 120, 4), ("b", 8, 800, None), ("c", 12, 297, None)]
    results = spark.createDataFrame([("x" * 1700, "web_search"), ("x" * 1700, "other"), ("x" * 2001, None), ("x" * 3000, "fetch_url")], "t string, tool string")
    assert [len(r[0]) for r in results.select(dialogue.capped(F.col("t"), F.col("tool"))).collect()] == [1600 + len("\n[... 100 characters truncated ...]"), 1700, 2000 + len("\n[... 1 characters truncated ...]"), 3000]
    cases = [(False, None, False, [], ["a"]), (True, "e", False, [], ["a"]), (True, None, True, [], ["a"]), (True, None, False, [], ["a"]), (True, None, False, ["http a b"], ["a b"]), (True, None, False, ["c"], ["a"])]
    outcome = spark.createDataFrame(cases, "h boolean, e string, r boolean, c array<string>, x array<string>").select(dialogue.answer_outcome(*map(F.col, "herc"), F.col("x")))
    assert [r[0] for r in outcome.collect()] == ["REFUSED_BY_FLOOR", "ERROR", "REFUSED_BY_MODEL", "NO_CITATION", "CITED_EXPECTED", "CITED_WRONG"]
    run = lambda *refused: spark.createDataFrame(list(enumerate(refused)), "q int, refused boolean")
    assert [r.change for r in dialogue.changes(run(True, False, True, False), run(False, True, True), "q").orderBy("q").collect()] == ["now answers", "now refuses", "same", "missing"]
    scores = spark.createDataFrame([(1, "0.7"), (2, "high"), (9, "0.1"), (3, "1.5")], "index int, score string")
    assert [r.score for r in dialogue.scored(spark.range(4), scores, "id").orderBy("id").collect()] == [0.7, None, None, None]
    one = spark.sql("select array(named_struct('key', 'a', 'value', 1), named_struct('key', 'b', 'value', 2), named_struct('key', 'a', 'value', 3)) as p, 0.2D as d, 40 as e")
    got = one.select(dialogue.last_wins(F.col("p")), dialogue.similarity(F.col("d")), dialogue.clamped(F.col("e"), 1, 25), dialogue.refusal_reason(F.col("d"), 0.425)).first()
    assert [tuple(x) for x in got[0]] == [("a", 3), ("b", 2)] and tuple(got)[1:] == (0.8, 25, "Best match 0.200 is below the evidence floor 0.425.")


def test_pages_end_in_one_known_status(spark):
    from textloom import catalogue

    path = "/root/testdata/sf0.001"
    found = catalogue.queries()["crawl_outcomes"](spark, path)
    assert found.count() == table(spark, path, "pages").count() == found.select("id").distinct().count()
    assert {r.status for r in crawl.report(found).where("n > 0").collect()} <= set(crawl.STATUS_GROUPS)
