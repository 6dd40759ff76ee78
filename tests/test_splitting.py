"""Pieces, chunks, books and settings."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions.settings import Settings
from textloom.operators.chunking import chunks, tail
from textloom.operators.splitting import parts, pieces, split
from textloom.sources.books import body

TEXT = st.text(alphabet="ab \n#`.é", max_size=400)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(2, 60), st.integers(0, 30))
def test_pieces_hold_all(text, size, overlap):
    overlap = min(overlap, size - 1)
    assert "".join(parts(text, size)) == text and all(len(p) <= size for p in parts(text, size))
    found = pieces(text, size, overlap)
    assert all(p == p.strip() and 0 < len(p) <= size for p in found)
    at = 0
    for p in found:  # in order, and nothing but blanks is left between them
        start = text.index(p, 0 if overlap else at)
        assert overlap or not text[at:start].strip()
        at = start + len(p)
    assert set("".join(found)) == set(text) - {" ", "\n"} or set("".join(found)) - {" ", "\n"} == set(text) - {" ", "\n"}


def test_pieces():
    assert pieces("one two\n\nthree four five", 12, 0) == ["one two", "three four", "five"]
    assert pieces("aaaa bbbb cccc", 10, 5) == ["aaaa bbbb", "bbbb cccc"]
    assert pieces("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5] and pieces(None, 5, 1) == pieces(" \n", 5, 1) == []
    with pytest.raises(ValueError, match="overlap"):
        pieces("x", 5, 5)


def test_split(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "i int, t string")
    assert [tuple(r) for r in split(df, "i", "t", 2, 0).orderBy("document_id", "ordinal").collect()] == [(1, 0, "a"), (1, 1, "b")]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["# One", "## Two", "words of a paragraph that goes on for a while and ends here.", "```\ncode = 1\n\n\nmore = 2\n```", "", "short"]), max_size=40))
def test_chunks(lines):
    text = "\n\n".join(lines)
    for heading, chunk in chunks(text, 200, 40, 10):
        assert len(chunk) >= 10 and chunk == chunk.strip()
        assert heading is None or all(h in ("One", "Two") for h in heading.split(" > "))
        assert chunk.count("```") % 2 == 0
    joined = "\n".join(c for _, c in chunks(text, 200, 40, 10))
    assert "```" not in text or "code = 1" in joined


def test_body(spark):
    rows = [(0, "head\n*** START OF X ***\nthe book\n*** END OF X\nfoot"), (1, "no marks"), (2, "*** START OF"), (3, None)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", body(F.col("t")).alias("b"))
    assert [(r.b or "").strip() for r in sorted(df.collect())] == ["the book", "no marks", "", ""]


def test_settings():
    assert Settings().fingerprint() == Settings().fingerprint() != Settings(top_k=8).fingerprint()
    Settings().require(Settings().fingerprint())
    with pytest.raises(ValueError, match="stored results"):
        Settings().require(Settings(floor=0.5).fingerprint())
    with pytest.raises(ValueError, match="chunk_overlap.*; top_k"):
        Settings(chunk_overlap=700, top_k=0)


def test_overlap_has_no_empty_first_line():
    prose = "words of a paragraph that goes on for a while and ends here."
    found = list(chunks("\n\n".join([prose, prose, prose, "short", prose]), 200, 40, 10))
    assert all(chunk == chunk.strip() for _, chunk in found) and found[1][1].startswith("short\n\n")
    assert tail("a line\n\nlast one", 12) == "last one" and tail("first\nlast one", 100) == "first\nlast one"
    assert tail("one long line of many words", 10) == "words" and tail("a" * 30, 10) == "a" * 10 and tail("text\n```", 50) == "" and tail("", 5) == ""
