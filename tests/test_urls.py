"""Canonical URLs: spellings that are one page, and what can't be a page."""

import pytest

from textloom.functions.urls import with_canonical

CASES = {
    "site.org/story": "https://site.org/story", "site.org/story/": "https://site.org/story", "http://site.org/story": "https://site.org/story", "HTTPS://Site.ORG/Story": "https://site.org/Story",
    "https://site.org/story#part": "https://site.org/story", "https://site.org//a//b/": "https://site.org/a/b", "https://site.org:443/x": "https://site.org/x", "//site.org/x": "https://site.org/x",
    " https://site.org/x\n": "https://site.org/x", "<https://site.org/x>.": "https://site.org/x", "(\"site.org/x\");": "https://site.org/x", "https://site.org./x": "https://site.org/x",
    "https://site.org/p?utm_source=t&UTM_medium=x&fbclid=1": "https://site.org/p", "https://site.org/?p=123": "https://site.org/?p=123", "https://site.org/x?id=9&utm_source=t&page=2": "https://site.org/x?id=9&page=2",
    "https://site.org/x?b=2&a=1": "https://site.org/x?b=2&a=1", "https://site.org/x?a": "https://site.org/x?a=", "https://site.org/x?a=&b": "https://site.org/x?a=&b=", "https://site.org/app#!/2024/post": "https://site.org/app#!/2024/post",
    "https://site.org/app#/post": "https://site.org/app#/post", "https://site.org:8080/x": "https://site.org:8080/x", "https://site.org": "https://site.org/", "https://bücher.de/x": "https://xn--bcher-kva.de/x",
    "http://MÜNCHEN.de": "https://xn--mnchen-3ya.de/", "https://a.b.site.org/x": "https://a.b.site.org/x",
}
REFUSED = ["", "  ", "not a url", "file:///etc/passwd", "ftp://site.org/x", "https://user:pass@site.org/x", "user@site.org", "https://localhost/x", "https://site/x", "https://site.org:0/", "https://site.org:65536/", "https://site.org:port/", "https://-site.org/", "https://1.2.3.4/", "javascript:alert(1)", "https://" + "ü" * 300 + ".de", None]


def test_canonical(spark):
    given = [*CASES, *REFUSED]
    df = spark.createDataFrame(list(enumerate(given)), "i int, url string")
    found = {r.i: (r.canonical, r.host) for r in with_canonical(df, df.url).collect()}
    wrong = {given[i]: c for i, (c, _) in found.items() if c != CASES.get(given[i])}
    assert wrong == {}
    assert all((c is None) == (h is None) for c, h in found.values())


@pytest.mark.parametrize("again", [c for c in CASES.values()][:12])
def test_canonical_is_a_fixed_point(spark, again):
    df = spark.createDataFrame([(again,)], "url string")
    assert with_canonical(df, df.url).first().canonical == again
