"""Page trees, robots files and structured filters on rows of their own."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import text
from textloom.operators import dom, robots, structured

WORDS = "word " * 60


def test_markdown():
    html = f"""<html><head><title> A  title </title></head><body><nav><a href="/home">home page</a></nav><div id="side"><a href="/x">other pages of this site</a></div>
<article><h2>Part <em>one</em></h2><p>One <b>two</b> <a href="/a?x=1">a link</a>, <a href="#top">top</a> <img src=i.png alt="a picture"> {WORDS}</p>
<ul><li>a<ol><li>b</ol><li>c</ul><pre>x = 1
  y</pre><blockquote><p>quoted</blockquote><p>use <code>f(x)</code><script>no()</script></p></article><footer>imprint</footer></body></html>"""
    found = dom.described(html, "https://example.org/p/")
    assert found["title"] == "A title"
    assert found["markdown"] == (
        "## Part *one*\n\nOne **two** [a link](https://example.org/a?x=1), top a picture " + WORDS.strip() + "\n\n- a\n  1. b\n- c\n\n```\nx = 1\n  y\n```\n\n> quoted\n\nuse `f(x)`"
    )
    assert "imprint" not in found["lines"] and "home page" not in found["lines"] and "no()" not in found["lines"]
    assert found["anchors"] == ["home page", "other pages of this site", "a link", "top"]


def test_article_node():
    root = dom.tree(f"<body><div><section>{WORDS}</section><p>and more</p></div><div>{'<a href=x>linked words here</a> ' * 20}</div></body>")
    assert dom.article_node(root, 240).tag == "section"
    assert dom.article_node(root, 99) is None
    assert dom.article_node(root, 5_000) is None


def test_deep_and_broken_pages():
    deep = dom.described("<div>" * 50_000 + "deep text<script>hidden()</script>" + "</div>" * 50_000, "")
    assert deep["lines"] == "deep text" and deep["markdown"] == ""
    assert dom.described("<ul>" * 2_000 + "<li>x", "")["lines"] == "x"
    assert dom.described("", "")["lines"] == "" and dom.described("<p", None)["title"] is None
    assert set(dom.described(None, None).values()) == {None}
    assert dom.markdown(dom.tree('<p><a href="http://[bad">there</a>'), "https://e.org") == "[there](http://[bad)"


@pytest.mark.parametrize("html, field, expected", [
    ('<script type="application/ld+json">{"@graph":[{"x":1},{"datePublished":"2024-02-02"}]}</script>', "json_ld", "2024-02-02"),
    ('<script type="application/ld+json">[1,{"uploadDate":"2024-02-03"}]</script>', "json_ld", "2024-02-03"), ('<script type="application/ld+json">{broken</script>', "json_ld", None),
    ('<meta property="og:updated_time" content="2024-01-02"><meta name="date" content="2024-01-01">', "meta", "2024-01-01"), ('<meta name="date" content=" ">', "meta", None),
    ('<time datetime="2020-01-01"></time><time class="entry-date">May 1, 2021</time>', "time", "May 1, 2021"), ('<time datetime="2020-01-01">x</time>', "time", "2020-01-01"), ("<time></time>", "time", None),
    ("<p>On 14 March 2019 and Mar 15, 2019", "text", "Mar 15, 2019"), ("<p>on 2019-03-14.", "text", "2019-03-14"), ("<p>" + "x " * 2000 + "2019-03-14", "text", None),
    ('<script type="application/ld+json">{"isAccessibleForFree":"False"}</script>', "paid", True), ('<script type="application/ld+json">{"@graph":[{"isAccessibleForFree":false}]}</script>', "paid", False),
    ("<input type=PASSWORD>", "password", True), ("<input name=password>", "password", False),
])
def test_declared(html, field, expected):
    assert dom.described(html, "https://e.org/")[field] == expected


def test_pages_in_spark(spark):
    rows = [(1, f"<body><article><p>{WORDS}</p></article></body>", "https://e.org"), (2, None, None), (3, "", "https://e.org")]
    df = dom.with_page(spark.createDataFrame(rows, "page long, html string, url string"), F.col("html"), F.col("url"), "made")
    found = {r.page: r for r in df.select("page", "made.*").collect()}
    assert found[1].markdown == WORDS.strip() and found[1].secondary_chars == len(WORDS) - 1 and found[1].paid is False
    assert found[2].markdown is None and found[2].paid is None and found[2].secondary_chars is None
    assert found[3].markdown == "" and found[3].anchors == []


def test_link_density(spark):
    rows = [(1, ["ab c", "not there"], "ab c defg"), (2, [], "x"), (3, ["x"], " "), (4, ["aa", "aa"], "aa")]
    df = spark.createDataFrame(rows, "i int, a array<string>, t string").select("i", dom.link_density(F.col("a"), F.col("t")))
    assert dict(map(tuple, df.collect())) == {1: 0.4286, 2: 0.0, 3: 0.0, 4: 1.0}


def test_robots(spark):
    urls = spark.createDataFrame([("https://a/x", "a", 1), ("https://a/private/y", "a", 2), ("https://b/x", "b", 3), ("https://c/x", "c", 4), ("https://d/x", "d", 5), ("https://e/x", "e", 6), (None, None, 7)], "url string, host string, status int")
    files = spark.createDataFrame([("a", 200, "User-agent: *\nDisallow: /private\nCrawl-delay: 3"), ("b", 404, None), ("c", 403, ""), ("e", 200, None)], "host string, status int, body string")
    found = {r.status: (r.allowed, r.crawl_delay) for r in robots.decisions(urls, files, "agent").collect()}
    assert found == {1: (True, 3.0), 2: (False, 3.0), 3: (True, None), 4: (False, None), 5: (False, None), 6: (True, None), 7: (False, None)}


def test_structured(spark):
    rows = spark.createDataFrame([("a", 5.0, 4.0, "s", "c"), ("b", None, 5.0, "s", "c"), ("c", 5.0, 3.0, "t", "c"), ("d", 9.0, None, "s", "d")], "id string, price double, average_rating double, store string, category string")
    ids = lambda given: [r.id for r in structured.answer(rows, structured.Filter.of(given), "id").collect()]
    assert ids({}) == ["a", "b", "c", "d"]
    assert ids({"sort": "price_desc"}) == ["d", "a", "c", "b"] and ids({"sort": "rating_desc", "limit": "2"}) == ["b", "a"]
    assert ids({"store": " s ", "price_max": "6"}) == ["a"] and ids({"price_min": "none", "sort": "other", "limit": 0, "rating_min": 4}) == ["a", "b"]
    assert structured.answer(rows, structured.Filter.of({"op": "count", "category": "c", "limit": 1}), "id").first().total == 3
    assert structured.Filter.of({"limit": 1_000}).limit == structured.MOST


def test_answers(spark):
    given = ["I don’t know.", "I do not know!", "Well, I don't know that.", "I don't know " + "x" * 250, "It is so.", "", None]
    df = spark.createDataFrame(list(enumerate(given)), "i int, x string").select("i", text.is_refusal(F.col("x")).alias("whole"), text.is_short_refusal(F.col("x")).alias("short"))
    assert [(r.whole, r.short) for r in sorted(df.collect())] == [(True, True), (True, True), (False, True), (False, False), (False, False), (False, False), (None, None)]
    one = spark.range(1).select(
        text.grade(F.lit("verdict: partial")).alias("g"), text.grade(F.lit("none")).alias("n"), text.unsupported_phrases(F.lit("Then Mary Jones met Bob Smith. Mary Jones left"), F.lit("met Bob Smith")).alias("p")
    ).first()
    assert (one.g, one.n, one.p) == ("PARTIAL", None, ["Then Mary Jones", "Mary Jones"])


def test_pages_in_small_pieces(spark, monkeypatch):
    """Pages come back in order of columns and whole when a worker holds only two at a time."""
    rows = [(i, f"https://a.b/{i}", None if i == 3 else f"<title>t{i}</title><p>text {i}</p>") for i in range(7)]
    df = spark.createDataFrame(rows, "id long, url string, html string").coalesce(1)
    monkeypatch.setattr(dom, "PAGES", 2)
    found = dom.with_page(df, F.col("html"), F.col("url")).collect()
    assert [r.id for r in found] == list(range(7)) and [r.page.title for r in found] == [None if i == 3 else f"t{i}" for i in range(7)]
    assert found[0].__fields__ == ["id", "url", "html", "page"] and found[3].page.paid is None and found[4].page.paid is False
