"""Markdown chunks: sections by heading, blocks with fences whole, greedy packing with an overlap between prose pieces."""

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP, LEAST, MOST_CODE = 700, 150, 80, 4000
HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")


def sections(text: str):
    """(heading trail, body); a # within a fence is no heading."""
    trail: dict[int, str] = {}
    body, fenced = [], False
    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        found = None if fenced else HEADING.match(line)
        if found:
            yield trail, body
            level = len(found[1])
            trail = {k: v for k, v in trail.items() if k < level} | {level: found[2]}
            body = []
        else:
            body.append(line)
    yield trail, body


def blocks(lines: list[str]):
    """(is code, text): fenced code whole, paragraphs between empty lines; a fence that never ends is prose."""
    text = "\n".join(lines)
    for i, part in enumerate(re.split(r"(?ms)^(```.*?^```[^\n]*)$", text)):
        if i % 2:
            yield True, part
        else:
            for p in re.split(r"\n\s*\n", part):
                if p.strip():
                    yield False, p.strip()


def cut(text: str, size: int):
    """Sentences, then lines, then slices, joined up to size."""
    pieces, out = [], ""
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        for line in [sentence] if len(sentence) <= size else sentence.split("\n"):
            pieces += [line[i : i + size] for i in range(0, len(line), size)] or [line]
    for p in pieces:
        if out and len(out) + 1 + len(p) > size:
            yield out
            out = p
        else:
            out = f"{out}\n{p}" if out else p
    if out:
        yield out


def tail(text: str, most: int) -> str:
    """The last lines that fit in most characters, at least one, none of a code block; of a line that is longer its last whole words."""
    if most <= 0:
        return ""
    kept, size = [], 0
    for line in reversed(text.split("\n")):
        size += len(line) + 1
        if line.lstrip().startswith("```") or kept and size > most:
            break
        kept.append(line)
    found = "\n".join(reversed(kept)).strip()
    if len(found) > most:
        found = found[-most:]
        found = found.partition(" ")[2] or found
    return found.strip()


def chunks(text: str | None, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[str | None, str]]:
    """(heading trail, text) of each chunk of at least least characters."""
    out = []
    for trail, lines in sections(text or ""):
        heading = " > ".join(trail[k] for k in sorted(trail)) or None
        parts: list[tuple[bool, str]] = []
        for code, block in blocks(lines):
            pieces = [block] if code and len(block) <= MOST_CODE or len(block) <= size else list(cut(block, size))
            for piece in pieces:
                if parts and not code and not parts[-1][0] and len(parts[-1][1]) + 2 + len(piece) <= size:
                    parts[-1] = (False, parts[-1][1] + "\n\n" + piece)
                else:
                    parts.append((code, piece))
        for i, (code, part) in enumerate(parts):
            before = tail(parts[i - 1][1], overlap) if i and not code and not parts[i - 1][0] else ""
            whole = f"{before}\n\n{part}" if before else part
            if len(whole) >= least:
                out.append((heading, whole))
    return out


def chunked(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(document_id, ordinal, heading, text, chunk_id): chunk_id hashes the document's id and the text to embed, so a rerun gives the same ids."""

    @F.pandas_udf("array<struct<heading:string,text:string>>")
    def make(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"heading": h, "text": x} for h, x in chunks(t)])

    rows = docs.select(F.col(id_column).alias("document_id"), F.posexplode(make(F.col(text_column))).alias("ordinal", "c")).select("document_id", "ordinal", "c.heading", "c.text")
    embeddable = F.concat(F.coalesce(F.concat("heading", F.lit("\n\n")), F.lit("")), F.col("text"))
    return rows.withColumn("chunk_id", F.sha2(F.concat(F.col("document_id").cast("string"), F.lit("\0"), embeddable), 256))
