"""Expressions and sources on small rows of their own."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from textloom.functions import answers, text
from textloom.functions.calculator import calculate
from textloom.plans.corpus import set_checkpoints
from textloom.operators import dedupe
from textloom.operators.evaluation import drift
from textloom.sources import feeds, reports


def each(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", f(F.col("x")).alias("y"))
    return [r[1] for r in sorted(rows.collect())]


@pytest.mark.parametrize("given, expected", [
    ("2 + 3 * 4", 14.0), ("-(7 // 2) % 5", 2.0), ("2 ** 10", 1024.0), ("+1.5e1", 15.0), ("1 / 0", None), ("2 ** 1001", None), ("9.9e307 * 100", None), ("(-8) ** 0.5", None), ("10 ** 400", None),
    ("__import__('os')", None), ("True + 1", None), ("'a' * 3", None), ("1; 2", None), ("x", None), ("", None), (None, None), (" 1", 1.0), ("1+" * 250 + "1", None), ("[1][0]", None),
])
def test_calculate(given, expected):
    assert calculate(given) == expected


def test_link_list(spark):
    item = "- Another post - 3rd May 2024"
    given = ["Body.\n\n### Recent articles\n" + item + "\n\n" + item + "\n", "Body.\n" + item + "\nMore of the body.", "Body.\nRelated posts:", "Recent articles\n\n" + item, "No list\n- a point\n", "", None]
    assert each(spark, given, text.without_link_list) == ["Body.", given[1], "Body.", "Recent articles", given[4], "", None]


def test_shingles(spark):
    given = ["a b c d e f a b c d e", "one two", "", None, "Don't! STOP"]
    found = each(spark, given, lambda c: text.shingles(c, 5))
    assert found == [["a b c d e", "b c d e f", "c d e f a", "d e f a b", "e f a b c", "f a b c d"], ["one", "two"], [], None, ["don't", "stop"]]


def test_similar_pairs_against_all_pairs(spark):
    set_checkpoints(spark)
    base = [f"w{i % 23}x{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base[:59]), " ".join(base[:55]), " ".join(base[:40]), " ".join(["other", *base[1:]]), "short text", "short text", "text short", "", None]
    rows = list(enumerate(texts))
    found = {(r["a"], r["b"]): round(r["similarity"], 9) for r in dedupe.similar_pairs(dedupe.shingle_sets(spark.createDataFrame(rows, "id int, text string"), "id", F.col("text")), 0.85).collect()}
    sets, first = {}, {}
    for i, t in rows:
        words = (t or "").split()
        s = frozenset(" ".join(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset(words)
        if s and s not in first:
            first[s] = i
            sets[i] = s
    wanted = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])}
    assert found == wanted and (0, 1) in found


def test_citations():
    assert answers.only_valid(" a [1] b 【2†L1-L4】 ", 2) == "a [1] b 【2†L1-L4】"
    assert answers.only_valid("a [2, 9] b 【7†L1】 c [0]", 3) == "a [2] b  c"
    assert answers.only_valid("none", 0) == "none"


def test_answers(spark):
    assert each(spark, ["red (shoes) + ", "+ -", "", None], answers.search_terms) == ["red OR shoes", "+ -", "", None]
    assert each(spark, ['```json\n{"a": {"b": 1}}\n```', "none", None], answers.json_part) == ['{"a": {"b": 1}}', None, None]
    raw = [(b - 128) / 128 for b in hashlib.sha256(b"text").digest()]
    whole = [raw[i % 32] for i in range(40)]
    norm = math.sqrt(sum(x * x for x in whole))
    assert each(spark, ["text"], lambda c: answers.hash_vector(c, 40))[0] == pytest.approx([x / norm for x in whole])


def test_drift(spark):
    claims = spark.createDataFrame([(3, 1, "A"), (2, 2, "B"), (1, 2, "B"), (4, 3, "C"), (5, 2, "old")], "question_id int, article_id int, title string")
    live = spark.createDataFrame([(1, "A "), (2, "New")], "id int, title string")
    found = {(r["article_id"], r["title"], r["question_id"], r["problem"]) for r in drift(claims, live).collect()}
    assert found == {(2, "B", 1, "retitled"), (2, "old", 5, "retitled"), (3, "C", 4, "gone")}


def test_feeds(spark):
    rss = "<rss><channel><link>https://x.org</link><item><title><![CDATA[A & B]]></title><link>https://x.org/a?b=1&amp;c=2</link><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate></item><item><title>no link</title></item><item><link>https://x.org/2</link></item></channel></rss>"
    atom = '<feed><entry><link rel="self" href="https://y.org/s"/><link rel="alternate" href="https://y.org/1"/><title>T</title><updated>2024-03-05T12:00:00+02:00</updated></entry></feed>'
    rows = spark.createDataFrame([("rss", rss), ("atom", atom), ("empty", ""), ("null", None)], "feed string, xml string")
    found = [tuple(r) for r in feeds.entries(rows, F.col("xml")).select("feed", "position", "url", "title", F.unix_timestamp("published_at")).collect()]
    assert sorted(found, key=str) == [("atom", 0, "https://y.org/1", "T", 1709632800), ("rss", 0, "https://x.org/a?b=1&c=2", "A & B", 1709632800), ("rss", 1, "https://x.org/2", None, None)]
    assert feeds.entries(rows, F.col("xml"), 1).count() == 2


def test_report(spark):
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "name string, n int").orderBy("n")
    assert reports.markdown_table(df) == "| name | n |\n|-|-|\n| a\\|b | 1 |\n| - | 2 |"
    with pytest.raises(ValueError):
        reports.markdown_table(df, 1)
