"""canonical_page_urls over all pages, against urllib."""

from urllib.parse import urlsplit

import pyarrow.parquet as pq
import pytest

from textloom import catalogue

TRACK = {"ref", "src", "source", "fbclid", "gclid"}
OWN = [(1, "http://A.example.com/x?utm_source=feed"), (2, "https://a.example.com/x?page=2&ref=x"), (3, "https://a.example.com/x?UTM_medium=m&q=1#top"), (4, None), (5, "https://a.example.com/x?refs=1"), (6, "ftp://a.example.com/x?ref=1")]


def plain(url):
    if url is None or not url.startswith(("http://", "https://")):
        return None, None
    at = urlsplit(url)
    query = "&".join(p for p in at.query.split("&") if p and p.split("=")[0].lower() not in TRACK and not p.lower().startswith("utm_"))
    return f"https://{at.netloc.lower()}{at.path.rstrip('/') or '/'}" + (f"?{query}" if query else ""), at.netloc.lower()


@pytest.mark.parametrize("where", ["/root/testdata/sf0.01", "own"])
def test_all_pages(spark, where, tmp_path):
    if where == "own":
        where = str(tmp_path)
        spark.createDataFrame(OWN, "page_id long, url string").write.parquet(f"{where}/pages.parquet")
    pages = [(r["page_id"], r["url"]) for r in pq.read_table(f"{where}/pages.parquet", columns=["page_id", "url"]).to_pylist()]
    assert any("?" in (u or "") for _, u in pages)
    found = [tuple(r) for r in catalogue.queries()["canonical_page_urls"](spark, where).select("page_id", "canonical", "host").collect()]
    assert sorted(found) == sorted((i, *plain(u)) for i, u in pages)
