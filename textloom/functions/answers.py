"""Expressions around a model's prompt and answer: contexts, search terms, citations, JSON in prose, vectors by hash."""

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = regex.compile(r"[\[【]\s*([0-9][0-9,\s]*?)\s*(?:†[^\]】]*)?[\]】]")


def search_terms(text: Column) -> Column:
    """Words without Lucene's special characters, joined by OR; the text itself if nothing is left."""
    words = F.transform(F.split(F.trim(text), "\\s+"), lambda w: F.regexp_replace(w, r"[+\-&|!(){}\[\]^\"~*?:\\/]", ""))
    found = F.array_join(F.filter(words, lambda w: w != ""), " OR ")
    return F.when(found == "", text).otherwise(found)


def numbered(parts: Column) -> Column:
    """One context of an array of (title, body): [1] title, its body below, entries apart by an empty line."""
    return F.array_join(F.transform(parts, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(p["title"], F.lit("")), F.lit("\n"), F.coalesce(p["body"], F.lit("")))), "\n\n")


def json_part(text: Column) -> Column:
    """From the first opening to the last closing brace, fences or prose around it left out; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def hash_vector(text: Column, size: int = 384) -> Column:
    """A unit vector that only the text decides: the bytes of its SHA-256 in turn, centred. For tests where no model is at hand."""
    digest = F.sha2(text, 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") - 128) / 128)

    def unit(v: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get(v, F.pmod(i, F.lit(32)).cast("int")))
        return F.get(F.transform(F.array(whole), lambda w: F.transform(w, lambda x: x / F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, y: s + y * y)))), F.lit(0))

    return F.get(F.transform(F.array(raw), unit), F.lit(0))


def only_valid(text: str, sources: int) -> str:
    """text with the indices over sources (or 0) taken out of its citations; as it is, but for outer blanks, if all are valid."""
    def valid(mark) -> list[str]:
        return [n for n in (p.strip() for p in mark[1].split(",")) if n and 1 <= int(n) <= sources]

    def indices(mark) -> int:
        return sum(1 for p in mark[1].split(",") if p.strip())

    if all(len(valid(m)) == indices(m) for m in MARK.finditer(text)):
        return text.strip()
    return MARK.sub(lambda m: f"[{', '.join(v)}]" if (v := valid(m)) else "", text).strip()


@F.pandas_udf(T.StringType())
def valid_citations(texts: pd.Series, sources: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or n is None or n != n else only_valid(t, int(n)) for t, n in zip(texts, sources)], dtype="object")
