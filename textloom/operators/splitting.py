"""Pieces of a bounded size by the coarsest separator that fits: paragraphs, lines, words, characters."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", " ", "")


def parts(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """text in order, cut at the first separator, and at finer ones where a part is longer than size; a separator stays with the part before it."""
    out, waiting = [], [(text, 0)]
    while waiting:
        t, level = waiting.pop()
        if len(t) <= size:
            out.append(t)
        elif separators[level] == "":
            out += [t[i : i + size] for i in range(0, len(t), size)]
        else:
            cut = t.split(separators[level])
            waiting += [(p + separators[level] * (i < len(cut) - 1), level + 1) for i, p in reversed(list(enumerate(cut)))]
    return [p for p in out if p]


def pieces(text: str | None, size: int, overlap: int) -> list[str]:
    """Runs of parts of at most size characters, blanks at their ends removed; each begins with the last parts of the one before, up to overlap characters."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    out: list[str] = []
    run: list[str] = []
    length = 0
    for part in parts(text or "", size):
        if length + len(part) > size:
            out.append("".join(run))
            while run and (length > overlap or length + len(part) > size):
                length -= len(run.pop(0))
        run.append(part)
        length += len(part)
    return [t for p in [*out, "".join(run)] if (t := p.strip())]


def split(docs: DataFrame, id_column: str, text_column: str, size: int = 800, overlap: int = 80) -> DataFrame:
    """(document_id, ordinal, text) of the pieces of each text; none of a null or blank one."""

    @F.pandas_udf("array<string>")
    def make(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pieces(t, size, overlap))

    return docs.select(F.col(id_column).alias("document_id"), F.posexplode(make(F.col(text_column))).alias("ordinal", "text"))
