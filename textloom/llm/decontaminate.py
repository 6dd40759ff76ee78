"""Benchmark decontamination: a prefix-filtered join of item windows with documents, verified word for word.

A window is a run of eight item words, or all words of a shorter item. As a window counts only when all its words occur, the prefix
that a candidate must share is one token long: the window's rarest word, by document frequency over all documents. A document
looks up only its words that are some window's rarest; length and positional bounds discard windows that can't fit there, and
the rest are compared word for word, in order, over the window's own size.

The index is packed: word numbers of the items, and per distinct window its place, its rarest word's place and its items. A block of
BLOCK_BYTES of items takes about 100 MB in each Python worker; documents are read once for frequencies and once for the join per block.
"""

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import append_columns, materialise, texts

WINDOW = 8
#: Items are taken in blocks of at most about so many bytes of text; one block at a time is broadcast.
BLOCK_BYTES = 8_000_000
#: So many candidates are compared at once.
CANDIDATES = 200_000
#: ASCII bytes that are no part of a word become blanks, A-Z become a-z.
FOLD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


@dataclass(frozen=True)
class Index:
    """vocabulary: words in byte order, joined by blanks. tokens: the items' words, numbered. Of each distinct window, in the order of
    their rarest words: start and size in tokens, offset of the rarest word. first: where each word's windows begin. Items of
    window w: items[item_at[w]:item_at[w + 1]], numbers of names."""

    vocabulary: bytes
    tokens: np.ndarray
    start: np.ndarray
    size: np.ndarray
    offset: np.ndarray
    first: np.ndarray
    item_at: np.ndarray
    items: np.ndarray
    names: list[str]

    def words(self) -> list[bytes]:
        return self.vocabulary.split()


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1 and so on, count of them, for each pair."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())


def index(items: list[tuple], window: int, frequencies) -> Index:
    """Of (item, text as bytes). frequencies: given the distinct words, a dict of their document frequencies; ties go to the first word in byte order."""
    split = [(name, w) for name, text in items if (w := words(text))]
    known = sorted({w for _, ws in split for w in ws})
    number = {w: i for i, w in enumerate(known)}
    names = sorted({name for name, _ in split})
    place = {name: i for i, name in enumerate(names)}
    tokens = np.fromiter((number[w] for _, ws in split for w in ws), np.int32)
    lengths = np.array([len(ws) for _, ws in split], np.int64)
    counts = np.maximum(1, lengths - window + 1)
    start = ranges(np.cumsum(lengths) - lengths, counts) if len(split) else np.zeros(0, np.int64)
    size = np.repeat(np.minimum(lengths, window), counts)
    item = np.repeat(np.array([place[name] for name, _ in split], np.int64), counts)
    whole = np.full((len(start), window), -1, np.int32)
    for k in range(window):
        there = size > k
        whole[there, k] = tokens[start[there] + k]
    found = frequencies(known) if known else {}
    rank = np.empty(len(known) + 1, np.int64)
    rank[np.lexsort((np.arange(len(known)), np.array([found.get(w, 0) for w in known], np.int64)))] = np.arange(len(known))
    rank[-1] = np.iinfo(np.int64).max
    offset = np.argmin(rank[whole], axis=1) if len(start) else np.zeros(0, np.int64)
    _, one, of = np.unique(np.ascontiguousarray(whole).view(f"V{4 * window}").ravel(), return_index=True, return_inverse=True)
    rarest = whole[one, offset[one]]
    order = np.argsort(rarest, kind="stable")
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    pairs = np.unique(np.stack([back[of], item], axis=1), axis=0) if len(start) else np.zeros((0, 2), np.int64)
    one = one[order]
    return Index(
        b" ".join(known), tokens, start[one].astype(np.int32), size[one].astype(np.int32), offset[one].astype(np.int32), np.searchsorted(rarest[order], np.arange(len(known) + 1)).astype(np.int32),
        np.searchsorted(pairs[:, 0], np.arange(len(one) + 1)).astype(np.int32), pairs[:, 1].astype(np.int32), names,
    )


class Matcher:
    def __init__(self, made: Index):
        self.made, known = made, made.words()
        self.number = dict(zip(known, range(len(known)), strict=True))
        self.rare = {known[i] for i in np.flatnonzero(np.diff(made.first))}

    def occurrences(self, doc: list[bytes]):
        """Arrays (first word, window) of the windows that occur in doc."""
        made, get = self.made, self.number.get
        ids = np.fromiter((get(w, -1) for w in doc), np.int32, len(doc))
        at = np.flatnonzero(ids >= 0)
        counts = (made.first[ids[at] + 1] - made.first[ids[at]]).astype(np.int64)
        at, counts = at[counts > 0], counts[counts > 0]
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(counts) // CANDIDATES)) + 1):
            entry = ranges(made.first[ids[at[part]]].astype(np.int64), counts[part])
            start = np.repeat(at[part], counts[part]) - made.offset[entry]
            fits = (start >= 0) & (start + made.size[entry] <= len(doc))
            start, entry = start[fits], entry[fits]
            for k in range(int(made.size.max(initial=0))):
                same = made.size[entry] <= k
                same[~same] = ids[start[~same] + k] == made.tokens[made.start[entry[~same]] + k]
                start, entry = start[same], entry[same]
            yield start, entry

    def find(self, text: bytes | None) -> tuple[int, list[int], list[str], int]:
        """The number of words, the spans hit (disjoint, flat: first, one after the last), the items that occur, the longest window that does."""
        doc = words(text)
        if self.rare.isdisjoint(doc):
            return len(doc), [], [], 0
        made, spans, items, longest = self.made, [], set(), 0
        for start, entry in self.occurrences(doc):
            if len(entry):
                longest = max(longest, int(made.size[entry].max()))
                spans.append(np.unique(np.stack([start, start + made.size[entry]], axis=1), axis=0))
                windows = np.unique(entry)
                counts = (made.item_at[windows + 1] - made.item_at[windows]).astype(np.int64)
                items.update(made.items[ranges(made.item_at[windows].astype(np.int64), counts)].tolist())
        return len(doc), merged(np.concatenate(spans).tolist() if spans else []), sorted(made.names[i] for i in items), longest


def merged(spans: list) -> list[int]:
    """Spans as disjoint ones, flat: first, end, first, end and so on."""
    out: list[int] = []
    for first, end in sorted(map(tuple, spans)):
        if out and first <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [first, end]
    return out


def blocks(benchmark: DataFrame, most: int) -> list[DataFrame]:
    """benchmark (item_id string, text) in parts of about most bytes of text, whole items, by hash."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // most) or 1
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)] if n > 1 else [benchmark]


def frequencies(documents: DataFrame, text: Column, vocabulary: list[bytes]) -> dict[bytes, int]:
    """In how many of all documents each word of the vocabulary, a block's, occurs."""
    shared = documents.sparkSession.sparkContext.broadcast(b" ".join(vocabulary))

    def count(batches):
        known, total = set(shared.value.split()), Counter()
        for batch in batches:
            for t in texts(batch.column(0)):
                total.update(known.intersection(words(t)))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    rows = documents.select(text.alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()),
    T.StructField("hits", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest_window", T.LongType()), T.StructField("contaminated", T.BooleanType()),
]


def digest(found: list[tuple], min_items: int) -> list[pa.Array]:
    """The columns of FIELDS, of what Matcher.find returns."""
    n, spans, items, longest = zip(*found, strict=True) if found else ((), (), (), ())
    return [
        pa.array(n, pa.int64()), pa.array([sum(s[1::2]) - sum(s[::2]) for s in spans], pa.int64()), pa.array(map(len, items), pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
        pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64()), pa.array([len(x) >= min_items for x in items], pa.bool_()),
    ]


def matched(documents: DataFrame, text: Column, made: Index, min_items: int) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(made)

    def make():
        matcher = Matcher(shared.value)
        return lambda column: digest([matcher.find(t) for t in texts(column)], min_items)

    return append_columns(documents, [text], FIELDS, make)


def decontaminate(documents: DataFrame, benchmark: DataFrame, text_column: str = "text", window: int = WINDOW, min_items: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents with n_words, n_hit, n_items, items_sha256 (of the sorted item ids, comma-joined), hits (disjoint spans of words hit, flat), items, longest_window (words of the longest window that occurs) and contaminated.

    All documents are compared with all items, in blocks of items; with one block, as for any usual benchmark, in one pass
    without a shuffle. A null text has no words; an item without words has no windows; a null item_id counts as the
    empty id; items of equal id are one; an empty benchmark hits nothing. Columns of documents with these names are replaced.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text is not null")
    parts, text = blocks(items, block_bytes), F.col(text_column)
    made = lambda part: index([(r.item_id, r.text.encode()) for r in part.collect()], window, lambda known: frequencies(documents, text, known))
    if len(parts) == 1:
        return matched(documents, text, made(parts[0]), min_items)
    union = None
    for part in parts:
        hit = matched(documents.select(F.sha2(text, 256).alias("__key"), text.alias("__text")), F.col("__text"), made(part), min_items).where("longest_window > 0")
        hit = materialise(hit.select("__key", "hits", "items", "longest_window").dropDuplicates(["__key"]), "hits")
        union = hit if union is None else union.unionByName(hit)
    union = union.groupBy("__key").agg(F.flatten(F.collect_list("hits")).alias("__hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items"), F.max("longest_window").alias("__longest"))
    wide = documents.withColumn("__key", F.sha2(text, 256)).join(union, "__key", "left").drop("__key")

    def make():
        def work(column, hits, items, longest):
            rows = zip(texts(column), hits.to_pylist(), items.to_pylist(), longest.to_pylist(), strict=True)
            return digest([(len(words(t)), merged([*zip((h or [])[::2], (h or [])[1::2], strict=True)]), i or [], n or 0) for t, h, i, n in rows], min_items)

        return work

    return append_columns(wide, [text, F.col("__hits"), F.col("__items"), F.col("__longest")], FIELDS, make).drop("__hits", "__items", "__longest")
