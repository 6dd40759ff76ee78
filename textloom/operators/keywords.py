"""Okapi BM25 in two passes: asked terms are counted in each text once, then texts are scored by matrix products, a tile of queries at a time.

A task keeps, for each query, only texts that can be among its best k (see nearest), so pairs of queries and texts are never rows. The
queries' terms are sent to every task.
"""

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.nearest import ROUNDED, Best, integers, whole

K1, B = 1.5, 0.75
#: Queries of a tile and texts scored at once; what a table of counts holds besides terms.
TILE, TEXTS, ROWS, SUM, KNOWN = 128, 1_024, -1, -2, -3
WORDS = re.compile(rb"[a-z0-9']+")


def counted(asked: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over (doc_id, low), texts in lower case: (doc_id, dl, t, f), tokens, and the asked terms in the text by number with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {term.encode(): i for i, term in enumerate(asked)}
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch["low"].cast(pa.large_binary()).to_pylist():
                words = WORDS.findall(text) if text is not None else []
                held = Counter(words)
                own = [w for w in held if w in place]
                sizes.append(len(words) if text is not None else None)
                terms.append([place[w] for w in own])
                counts.append([held[w] for w in own])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "dl", "t", "f"])

    return run


def entries(parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, tokens, term, count) of texts of (dl, t, f) each; parts of equal tokens under one id count as one."""
    flat = parts.flatten()
    dl, t, f = (flat.field(n) for n in ("dl", "t", "f"))
    text = np.repeat(np.arange(len(parts)), pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False))
    many = pc.fill_null(pc.list_value_length(t), 0).to_numpy(zero_copy_only=False)
    number = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
    found = np.stack([np.repeat(text, many), np.repeat(number(pc.fill_null(dl, 0)), many), number(t.flatten()), number(f.flatten())])
    if len(flat) > len(parts):
        keys, at = np.unique(found[:3], axis=1, return_inverse=True)
        found = np.vstack([keys, np.bincount(at.ravel(), weights=found[3], minlength=keys.shape[1]).astype(np.int64)])
    return found[0], found[1], found[2], found[3]


def frequencies(terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over (parts): (t, n), texts that hold a term; and under ROWS, SUM and KNOWN the texts, tokens and texts that are not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, more = np.zeros(terms, dtype=np.int64), Counter()
        for batch in batches:
            dl = batch["parts"].flatten().field("dl")
            more.update({ROWS: len(dl), SUM: pc.sum(dl).as_py() or 0, KNOWN: len(dl) - dl.null_count})
            df += np.bincount(entries(batch["parts"])[2], minlength=terms)
        held = np.nonzero(df)[0]
        yield pa.RecordBatch.from_pydict({"t": pa.array([*held, *more], pa.int32()), "n": pa.array([*df[held], *more.values()], pa.int64())})

    return run


def scored(ids: pa.Array, asked: list[np.ndarray], idf: np.ndarray, mean: float, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over (doc_id, parts): (query_id, doc_id, raw) of texts that can be among a query's best k."""

    def tiles() -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for at in range(0, len(asked), TILE):
            some = asked[at : at + TILE]
            columns = np.unique(np.concatenate(some))
            to = np.full(len(idf), -1)
            to[columns] = np.arange(len(columns))
            held = np.zeros((len(columns) + 1, len(some)))
            terms = np.full((len(some), max(map(len, some))), len(columns))  # the last column is empty
            for i, own in enumerate(some):
                held[to[own], i], terms[i, : len(own)] = 1.0, to[own]
            yield at, to, held, terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, made = Best(len(asked), k), list(tiles())
        for large in batches:
            for start in range(0, large.num_rows, TEXTS):
                batch = large.slice(start, TEXTS)
                text, dl, term, tf = entries(batch["parts"])
                weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
                found = []
                for at, to, held, terms in made:
                    column, wide = to[term], len(held)
                    own = column >= 0
                    table = np.bincount(text[own] * wide + column[own], weights=weight[own], minlength=batch.num_rows * wide).reshape(batch.num_rows, wide)
                    s = table @ held
                    floor = best.floor[at : at + TILE]
                    if batch.num_rows > k and np.isneginf(floor).any():
                        floor = np.maximum(floor, np.partition(s, batch.num_rows - k, axis=0)[batch.num_rows - k])
                    right, left = np.nonzero((s > 0) & (s >= floor - ROUNDED - 1e-9))
                    exact = np.add.accumulate(table[right[:, None], terms[left]], axis=1)[:, -1]
                    found.append((left + at, exact, right))
                left, exact, right = (np.concatenate(x) for x in zip(*found, strict=True))
                docs, none = batch["doc_id"], np.zeros(len(left), dtype=bool)
                late = docs.is_null().to_numpy(zero_copy_only=False)
                best.add(left, exact, none, integers(docs)[right], late[right], pa.table({"doc_id": docs.take(pa.array(right))}))
        if best.rows is not None:
            out = pa.table({"query_id": ids.take(pa.array(best.rows[0])), "doc_id": whole(best.carried["doc_id"]), "raw": pa.array(best.rows[1])})
            yield from out.to_batches(max_chunksize=65_536)

    return run


def candidates(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, raw): of each query (query_id, term) documents (doc_id, text) that hold its best k. Needs a checkpoint folder: tokens are counted once.

    A null text counts as a document, but not for the mean length; texts under one id are scored together.
    """
    pairs = queries.where("term is not null").distinct().toArrow()
    asked = sorted(set(pairs["term"].to_pylist()))
    place = {term: i for i, term in enumerate(asked)}
    by: dict = {}
    for query, term in zip(pairs["query_id"].to_pylist(), pairs["term"].to_pylist(), strict=True):
        by.setdefault(query, []).append(place[term])
    fields = [queries.schema["query_id"], docs.schema["doc_id"], T.StructField("raw", T.DoubleType())]
    if not by:
        return docs.sparkSession.createDataFrame([], T.StructType(fields))
    one = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("dl long, t array<int>, f array<int>")])
    parts = docs.select("doc_id", F.lower("text").alias("low")).mapInArrow(counted(asked), one)
    parts = parts.groupBy("doc_id").agg(F.collect_list(F.struct("dl", "t", "f")).alias("parts")).checkpoint()
    counts = dict(parts.select("parts").mapInArrow(frequencies(len(asked)), "t int, n long").groupBy("t").agg(F.sum("n")).collect())
    n, mean = counts.get(ROWS, 0), counts.get(SUM, 0) / max(counts.get(KNOWN, 0), 1)
    idf = np.array([math.log(1 + (n - df + 0.5) / (df + 0.5)) for df in (counts.get(i, 0) for i in range(len(asked)))])
    ids = pa.array(list(by), pairs.schema.field("query_id").type)
    return parts.mapInArrow(scored(ids, [np.sort(np.array(x)) for x in by.values()], idf, mean or 1.0, k), T.StructType(fields))
