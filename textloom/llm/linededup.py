"""Line dedup that can be undone: exact reference counts of line keys, and sharded cuckoo filters over the frequent ones.

The state is a table (hi, lo, refs): a line key's 128-bit hash and the number of documents that hold it. Documents are inserted
and deleted by adding or subtracting their counts, so a deletion restores what was there before. Frequent keys, those in min_docs
documents or more, go into cuckoo filters, sharded by hash; a key that crosses the threshold is inserted into or deleted from its
shard's filter. A line that its filter doesn't know stays without any lookup; the others are checked against the exact counts.
"""

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import append_columns, materialise, texts

MIN_DOCS, MIN_CHARS = 10, 1
#: A shard's filter is meant for so many keys. Up to BROADCAST frequent keys go to each task, as sorted numbers (16 bytes each, and 3 in filters), else they are joined.
SHARD_KEYS, BROADCAST = 50_000, 1_000_000
BLANK = b" \t\n\x0b\x0c\r"
STATE = "hi long, lo long, refs long"


def keys(text: bytes | None) -> list[bytes]:
    """16-byte hashes of a text's line keys, empty for a key that is too short to count."""
    out = []
    for line in (text or b"").split(b"\n"):
        key = line.strip(BLANK).lower()
        if len(key) >= MIN_CHARS and (MIN_CHARS == 1 or len(key.decode()) >= MIN_CHARS):
            out.append(xxhash.xxh3_128_digest(key))
        else:
            out.append(b"")
    return out


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; each hash (uint64) has two buckets, and any of its copies can be deleted again."""

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        self.buckets = 1 << max(1, (max(1, capacity) * 100 // 340).bit_length())
        self.table = np.zeros((self.buckets, 4), np.uint16) if table is None else table.reshape(-1, 4).copy()
        self.buckets = len(self.table)

    def places(self, hashes: np.ndarray):
        prints = (hashes >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (hashes & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, first, self.other(first, prints)

    def other(self, bucket, prints):
        return bucket ^ ((prints.astype(np.int64) * 0x5BD1E995) & (self.buckets - 1))

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, a, b = self.places(hashes)
        return (self.table[a] == prints[:, None]).any(axis=1) | (self.table[b] == prints[:, None]).any(axis=1)

    def insert(self, value: int) -> bool:
        """False if there is no room; the filter is then as before."""
        prints, a, b = (int(x[0]) for x in self.places(np.array([value], np.uint64)))
        for bucket in (a, b):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = prints
                return True
        before, bucket = self.table.copy(), a
        for kick in range(500):
            slot = (kick * 7 + prints) & 3
            prints, self.table[bucket, slot] = int(self.table[bucket, slot]), prints
            bucket = int(self.other(np.int64(bucket), np.uint16(prints)))
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = prints
                return True
        self.table = before
        return False

    def delete(self, value: int) -> bool:
        prints, a, b = (int(x[0]) for x in self.places(np.array([value], np.uint64)))
        for bucket in (a, b):
            there = np.flatnonzero(self.table[bucket] == prints)
            if len(there):
                self.table[bucket, there[0]] = 0
                return True
        return False

    @classmethod
    def of(cls, hashes) -> "CuckooFilter":
        room = max(64, len(hashes))
        while True:
            made = cls(room)
            if all(made.insert(int(h)) for h in hashes):
                return made
            room *= 2


def reference_counts(documents: DataFrame, text: Column) -> DataFrame:
    """(hi, lo, refs): in how many rows of documents each line key occurs; a row counts once however often it holds the line."""

    def count(batches):
        for batch in batches:
            total = Counter()
            for t in texts(batch.column(0)):
                total.update(set(keys(t)))
            total.pop(b"", None)
            if total:
                pairs = np.frombuffer(b"".join(total), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(total.values(), pa.int64())], names=["hi", "lo", "refs"])

    return documents.select(text.alias("text")).mapInArrow(count, STATE).groupBy("hi", "lo").agg(F.sum("refs").alias("refs"))


def changed(state: DataFrame, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """The state after documents' counts (reference_counts) are inserted and deleted. Keys of no document vanish; a count below zero is an error."""
    both = state
    if inserted is not None:
        both = both.unionByName(inserted)
    if deleted is not None:
        both = both.unionByName(deleted.withColumn("refs", -F.col("refs")))
    total = both.groupBy("hi", "lo").agg(F.sum("refs").alias("refs"))
    checked = F.when(F.col("refs") < 0, F.raise_error(F.lit("a document was deleted that had not been inserted"))).otherwise(F.col("refs"))
    return total.withColumn("refs", checked.cast("long")).where("refs <> 0")


def shard_of(shards: int) -> Column:
    return F.pmod(F.col("hi"), F.lit(shards)).cast("int")


def build_filters(frequent: DataFrame, shards: int) -> DataFrame:
    """(shard int, filter binary) over frequent keys (hi, lo)."""

    def build(pdf):
        return pd.DataFrame({"shard": pdf.shard[:1], "filter": [CuckooFilter.of(pdf["lo"].to_numpy(np.int64).view(np.uint64)).table.tobytes()]})

    return frequent.select(shard_of(shards).alias("shard"), "lo").groupBy("shard").applyInPandas(build, "shard int, filter binary")


def updated_filters(filters: DataFrame, before: DataFrame, after: DataFrame, shards: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """filters after the state went from before to after: only keys that cross min_docs are inserted or deleted."""
    old, new = (s.where(F.col("refs") >= min_docs).select("hi", "lo") for s in (before, after))
    moves = new.join(old, ["hi", "lo"], "left_anti").withColumn("sign", F.lit(1)).unionByName(old.join(new, ["hi", "lo"], "left_anti").withColumn("sign", F.lit(-1)))

    def update(key, held, moved):
        made = CuckooFilter(64, np.frombuffer(held["filter"].iloc[0], np.uint16)) if len(held) else None
        fits = made is not None
        for value, sign in zip(moved["lo"].to_numpy(np.int64).view(np.uint64), moved["sign"], strict=True):
            fits = fits and (made.insert(int(value)) if sign > 0 else made.delete(int(value)))
        return pd.DataFrame({"shard": [key[0]], "filter": [made.table.tobytes() if fits else None]})

    moved = moves.select(shard_of(shards).alias("shard"), "lo", "sign")
    found = materialise(filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(update, "shard int, filter binary"), "updated")
    # A shard that is new, full or lacks a key is built anew, with room to grow, from the exact counts.
    again = new.select("*", shard_of(shards).alias("shard")).join(found.where("filter is null").select("shard"), "shard", "left_semi")
    return found.where("filter is not null").unionByName(build_filters(again, shards))


class Exact:
    """Sorted 128-bit keys, 16 bytes each."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        order = np.lexsort((lo, hi))
        self.hi, self.lo = hi[order], lo[order]

    def holds(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hi, hi)
        while True:  # keys that share their first half are next to each other
            here = np.minimum(at, len(self.hi) - 1)
            on = (at < len(self.hi)) & (self.hi[here] == hi) & (self.lo[here] < lo)
            if not on.any():
                return (at < len(self.hi)) & (self.hi[here] == hi) & (self.lo[here] == lo)
            at = at + on

    def among(self, keys: set[bytes]) -> set[bytes]:
        if not keys or not len(self.hi):
            return set()
        flat = list(keys)
        pairs = np.frombuffer(b"".join(flat), "<i8").reshape(-1, 2)
        return {flat[i] for i in np.flatnonzero(self.holds(pairs[:, 0], pairs[:, 1]))}


def suspects(found: list[list[bytes]], filters: dict, shards: int) -> list[set[bytes]]:
    """Of each document's keys, those that their shards' filters know."""
    flat = [k for doc in found for k in doc if k]
    if not flat or not filters:
        return [set() for _ in found]
    pairs = np.frombuffer(b"".join(flat), "<i8").reshape(-1, 2)
    shard, hashes, known = np.mod(pairs[:, 0], shards), pairs[:, 1].copy().view(np.uint64), np.zeros(len(flat), bool)
    for s in np.unique(shard):
        if int(s) in filters:
            at = shard == s
            known[at] = filters[int(s)].contains(hashes[at])
    hit = {flat[i] for i in np.flatnonzero(known)}
    return [hit.intersection(doc) for doc in found]


FIELDS = [T.StructField("n_lines", T.LongType(), False), T.StructField("n_dropped", T.LongType(), False), T.StructField("kept_text", T.StringType(), False), T.StructField("kept_sha256", T.StringType(), False)]


def without_lines(column: list, found: list[list[bytes]], drop: list[set[bytes]]) -> list[pa.Array]:
    counts, dropped, kept, hashes = [], [], [], []
    for t, ks, gone in zip(column, found, drop, strict=True):
        t = t or b""
        counts.append(len(ks))
        if gone:
            lines = [line for line, k in zip(t.split(b"\n"), ks, strict=True) if k not in gone]
            dropped.append(len(ks) - len(lines))
            t = b"\n".join(lines)
        else:
            dropped.append(0)
        kept.append(t)
        hashes.append(hashlib.sha256(t).hexdigest())
    return [pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(hashes)]


def drop_lines(documents: DataFrame, state: DataFrame, text_column: str = "text", min_docs: int = MIN_DOCS, broadcast: int = BROADCAST) -> DataFrame:
    """documents with n_lines, n_dropped, kept_text and kept_sha256, after all lines whose key is in min_docs documents or more are gone.

    state is a written table of reference_counts. A null or empty text is one empty line, which stays, as its key is too
    short to count. Repeated rows count as documents each. Without frequent keys every text stays as it is. Columns of
    documents with these names are replaced.
    """
    spark = documents.sparkSession
    frequent = materialise(state.where(F.col("refs") >= min_docs), "frequent")
    n = frequent.count()
    shards = max(1, -(-n // SHARD_KEYS))
    filters = materialise(build_filters(frequent, shards), "filters")
    text = F.col(text_column)
    if n <= broadcast:
        tables = spark.sparkContext.broadcast({r.shard: bytes(r["filter"]) for r in filters.collect()})
        pairs = frequent.select("hi", "lo").toPandas().to_numpy(np.int64)
        exact = spark.sparkContext.broadcast(Exact(pairs[:, 0].copy(), pairs[:, 1].copy()))

        def make():
            filters = {s: CuckooFilter(0, np.frombuffer(b, np.uint16)) for s, b in tables.value.items()}

            def work(column):
                column = texts(column)
                found = [keys(t) for t in column]
                known = suspects(found, filters, shards)
                sure = exact.value.among(set().union(*known)) if known else set()
                return without_lines(column, found, [s & sure if s else s for s in known])

            return work

        return append_columns(documents, [text], FIELDS, make)

    # Too many for every task: filters go out in blocks of shards, what they pass meets the exact counts, then the texts that hold it.
    def candidates(tables):
        def run(batches):
            filters = {s: CuckooFilter(0, np.frombuffer(b, np.uint16)) for s, b in tables.value.items()}
            for batch in batches:
                found = suspects([keys(t) for t in texts(batch.column(1))], filters, shards)
                rows = [(key, k) for key, ks in zip(batch.column(0).to_pylist(), found, strict=True) for k in ks]
                if rows:
                    both = np.frombuffer(b"".join(k for _, k in rows), "<i8").reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["key", "hi", "lo"])

        return run

    distinct = documents.select(F.sha2(F.coalesce(text, F.lit("")), 256).alias("key"), text.alias("text")).dropDuplicates(["key"])
    passed, step = None, max(1, broadcast // SHARD_KEYS)
    for first in range(0, shards, step):
        block = filters.where((F.col("shard") >= first) & (F.col("shard") < first + step)).collect()
        found = distinct.mapInArrow(candidates(spark.sparkContext.broadcast({r.shard: bytes(r["filter"]) for r in block})), "key string, hi long, lo long")
        passed = found if passed is None else passed.unionByName(found)
    gone = passed.join(frequent, ["hi", "lo"], "left_semi").groupBy("key").agg(F.collect_list(F.struct("hi", "lo")).alias("__gone"))
    wide = documents.withColumn("__key", F.sha2(F.coalesce(text, F.lit("")), 256)).join(gone.withColumnRenamed("key", "__key"), "__key", "left").drop("__key")

    def make():
        def work(column, gone):
            column = texts(column)
            drop = [{np.array([x["hi"], x["lo"]], "<i8").tobytes() for x in g or ()} for g in gone.to_pylist()]
            return without_lines(column, [keys(t) for t in column], drop)

        return work

    return append_columns(wide, [text, F.col("__gone")], FIELDS, make).drop("__gone")
