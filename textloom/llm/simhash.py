"""SimHash near-duplicates: exact pairs of fingerprints at a small Hamming distance by vantage-point trees.

A vantage-point tree over a bounded sample deals the distinct fingerprints to shards: at a node, those within the radius
of its vantage point go inside, the others outside. A fingerprint inside, but within max_bits of the boundary, also goes outside as a
guest; guests go on to every branch that the triangle bound leaves. So each pair at distance <= max_bits meets in one shard as
home and home or guest and home. A shard goes on splitting in the same way in memory, then compares what is left. Of its
links it returns a spanning forest, so a group of n alike gives n rows, not n squared.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import append_columns, materialise, texts
from textloom.llm.components import connected_components, contract

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: The tree is drawn from about so many fingerprints, at most twice as many; a shard is meant to hold LEAF of them.
SAMPLE, LEAF, SMALL = 32_768, 4_096, 1_024


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: a bit is set if it is in over half the XXH64 of the word shingles, repeats included; no words or null: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else iter([b" ".join(words)])
    left = total = max(1, len(words) - shingle + 1)
    bits, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    while left:
        n = min(left, 65_536)
        hashes = np.fromiter((digest(next(parts), seed) for _ in range(n)), np.uint64, n)
        bits += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(n, 64).sum(axis=0, dtype=np.int32)
        left -= n
    return int(np.packbits(2 * bits > total, bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, text: Column, name: str = "fingerprint") -> DataFrame:
    """df with a column of fingerprints as signed longs; a column of that name is replaced."""

    def make():
        def work(column):
            return [pa.array(np.array([fingerprint(t) for t in texts(column)], np.uint64).view(np.int64))]

        return work

    return append_columns(df, [text], [T.StructField(name, T.LongType(), False)], make)


def distances(fps: np.ndarray, to) -> np.ndarray:
    return np.bitwise_count(fps ^ np.uint64(to)).astype(np.int16)


def grow(sample: np.ndarray, depth: int, least: int = 16) -> list[tuple]:
    """Nodes (vantage, radius, inside, outside); a branch is a node's index or, for shard s, ~s. Node 0 is the root."""
    nodes: list = []
    shards = 0

    def make(points: np.ndarray, depth: int) -> int:
        nonlocal shards
        if depth and len(points) >= 2 * least:
            vantage = points[len(points) // 2]
            d = distances(points, vantage)
            radius = int(np.median(d))
            if (d <= radius).all():
                radius -= 1
            if (d <= radius).any():
                at = len(nodes)
                nodes.append(None)
                nodes[at] = (int(vantage), radius, make(points[d <= radius], depth - 1), make(points[d > radius], depth - 1))
                return at
        shards += 1
        return ~(shards - 1)

    rng = np.random.default_rng(SEED)
    root = make(rng.permutation(np.sort(sample)), depth)
    return nodes if root == 0 else []


def part(vantage: int, radius: int, homes: np.ndarray, guests: np.ndarray, r: int) -> tuple:
    """(homes, guests) inside and outside."""
    d, g = distances(homes, vantage), distances(guests, vantage)
    return (homes[d <= radius], guests[g <= radius + r]), (homes[d > radius], np.concatenate([homes[(d <= radius) & (d > radius - r)], guests[g > radius - r]]))


def route(nodes: list[tuple], fps: np.ndarray, r: int):
    """(shard, homes, guests) for those shards that any of fps reaches."""
    todo = [(0 if nodes else ~0, fps, fps[:0])]
    while todo:
        at, homes, guests = todo.pop()
        if not len(homes) and not len(guests):
            continue
        if at < 0:
            yield ~at, homes, guests
        else:
            vantage, radius, *branches = nodes[at]
            todo += [(b, *both) for b, both in zip(branches, part(vantage, radius, homes, guests, r), strict=True)]


def linked(homes: np.ndarray, guests: np.ndarray, r: int):
    """Arrays of linked fingerprints, home by home or guest by home, by a tree in memory."""
    todo = [(homes, guests)]
    while todo:
        homes, guests = todo.pop()
        if not len(homes):
            continue
        if len(homes) > SMALL:
            vantage = homes[len(homes) // 2]
            radius = int(np.median(distances(homes, vantage)))
            inside, outside = part(int(vantage), radius, homes, guests, r)
            if max(len(inside[0]) + len(inside[1]), len(outside[0]) + len(outside[1])) < 0.95 * (len(homes) + len(guests)):
                todo += [inside, outside]
                continue
        everyone = np.concatenate([homes, guests])
        step = max(1, 2_000_000 // len(everyone))
        for at in range(0, len(homes), step):
            i, j = np.nonzero(np.bitwise_count(homes[at : at + step, None] ^ everyone[None, :]) <= r)
            ahead = j > i + at
            if ahead.any():
                yield homes[i[ahead] + at], everyone[j[ahead]]


def forest(homes: np.ndarray, guests: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what homes and guests link, one at most for each of them."""
    ids = np.unique(np.concatenate([homes, guests]))
    label = np.arange(len(ids))
    for a, b in linked(homes, guests, r):
        label = contract(len(ids), np.concatenate([np.arange(len(ids)), np.searchsorted(ids, a)]), np.concatenate([label, np.searchsorted(ids, b)]))
    tied = label != np.arange(len(ids))
    return ids[tied], ids[label[tied]]


def links(fps: DataFrame, count: int, max_bits: int = MAX_BITS) -> DataFrame:
    """Of distinct fingerprints (fp long): links (a, b) that span the graph of pairs at distance <= max_bits."""
    every = max(1, count // SAMPLE)
    sample = [x[0] for x in fps.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").limit(2 * SAMPLE).collect()]
    nodes = grow(np.array(sample, np.int64).view(np.uint64), max(0, (max(1, count) - 1) // LEAF).bit_length())

    def deal(batches):
        found = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        if found:
            for shard, homes, guests in route(nodes, np.concatenate(found).view(np.uint64), max_bits):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([homes.tobytes()], pa.binary()), pa.array([guests.tobytes()], pa.binary())], names=["shard", "homes", "guests"])

    def solve(pdf):
        homes, guests = (np.frombuffer(b"".join(pdf[c]), np.uint64) for c in ("homes", "guests"))
        a, b = forest(homes, guests, max_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return fps.select("fp").mapInArrow(deal, "shard int, homes binary, guests binary").groupBy("shard").applyInPandas(solve, "a long, b long")


def placed(marked: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Of a written table (doc_id, fingerprint long): (fp, least_id, component) of each distinct fingerprint.

    component, a fingerprint, is the component's own key, whatever its rows' ids; least_id is null only if all ids of fp are.
    """
    distinct = materialise(marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least_id")), "distinct")
    found = connected_components(links(distinct, distinct.count(), max_bits))
    return distinct.join(found, distinct.fp == found.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint long, component_id): each row's smallest id reachable over fingerprints that differ in max_bits or fewer.

    Rows of equal ids, texts or fingerprints all count; null and empty texts have fingerprint 0 and link like others; a null id
    is never a component_id unless all ids of the component are null. An empty table gives an empty one. The result's columns
    are these three whatever else df holds.
    """
    narrow = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    marked = materialise(with_fingerprints(narrow, F.col("text")).select("doc_id", "fingerprint"), "fingerprints")
    found = placed(marked, max_bits)
    named = found.groupBy("component").agg(F.min("least_id").alias("component_id"))
    ids = found.join(named, "component").select(F.col("fp").alias("fingerprint"), "component_id")
    return marked.join(ids, "fingerprint").select("doc_id", "fingerprint", "component_id")
