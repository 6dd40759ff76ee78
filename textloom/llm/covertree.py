"""Embedding near-duplicates: exact pairs of a cosine threshold by dual traversal of cover trees.

Vectors are compared within a group (label and dimension) only; equal vectors are one point with a multiplicity. A group's points go to
the nearest of pivots that grow with the group, then into blocks; two blocks meet only if their centres are no further
apart than their covering radii and the threshold's distance allow. Each block has a cover tree: nested levels of halving radii, a node knowing
the radius that covers its points. Pairs of nodes that are too far apart are pruned; what is left is compared exactly.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialise
from textloom.llm.components import connected_components, contract

THRESHOLD, BLOCK, LEAF, SLACK = 0.98, 2_048, 24, 1e-7
#: Pivots of all groups together, about: 16 MB of vectors of 64 numbers.
PIVOTS = 32_768


class CoverTree:
    """Over unit vectors: nodes in arrays; a node has a centre, a covering radius, and children or, as a leaf, points."""

    def __init__(self, points: np.ndarray, base: float = 2.0):
        self.points, self.centre, self.radius, self.children, self.members = points, [], [], [], []
        self.root = self.add(0, np.arange(len(points)), base)

    def add(self, centre: int, members: np.ndarray, reach: float) -> int:
        d = self.away(centre, members)
        at, covering = len(self.centre), float(d.max(initial=0))
        self.centre.append(centre)
        self.radius.append(covering)
        self.children.append([])
        self.members.append(None)
        if len(members) <= LEAF or covering < SLACK:
            self.members[at] = members
            return at
        while reach >= covering:  # levels at which this node would be its only child
            reach /= 2
        nets, left = [], members
        chosen = centre
        while len(left):
            near = self.away(chosen, left) <= reach
            nets.append((chosen, left[near]))
            left = left[~near]
            chosen = int(left[0]) if len(left) else -1
        alone = [c for c, m in nets if len(m) == 1]
        found = [self.add(c, m, reach / 2) for c, m in nets if len(m) > 1]
        for i in range(0, len(alone), LEAF * 8):  # points that cover none but themselves stand together in one node
            some = np.array(alone[i : i + LEAF * 8])
            node = len(self.centre)
            self.centre.append(int(some[0]))
            self.radius.append(float(self.away(int(some[0]), some).max()))
            self.children.append([])
            self.members.append(some)
            found.append(node)
        self.children[at] = found
        return at

    def away(self, centre: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (self.points[members] @ self.points[centre])))


def dual(a: CoverTree, b: CoverTree, threshold: float):
    """Arrays (i, j): pairs of a point of a and one of b whose cosine is threshold or more; within one tree i < j."""
    limit, same = np.sqrt(max(0, 2 - 2 * threshold)) + SLACK, a is b
    todo = [(a.root, b.root)]
    while todo:
        x, y = todo.pop()
        if a.members[x] is not None and b.members[y] is not None:
            i, j = a.members[x], b.members[y]
            p, q = np.nonzero(a.points[i] @ b.points[j].T >= threshold)
            i, j = i[p], j[q]
            if same:
                if x == y:
                    i, j = i[i < j], j[i < j]
                i, j = np.minimum(i, j), np.maximum(i, j)
            if len(i):
                yield i, j
            continue
        if same and x == y:
            c = a.children[x]
            todo += [(u, u) for u in c]
            u, v = np.triu_indices(len(c), 1)
            left, right = np.array(c, int)[u], np.array(c, int)[v]
        elif b.members[y] is not None or a.members[x] is None and a.radius[x] >= b.radius[y]:
            left = np.array(a.children[x], int)
            right = np.full(len(left), y)
        else:
            right = np.array(b.children[y], int)
            left = np.full(len(right), x)
        if len(left):
            ca, cb = a.points[[a.centre[k] for k in left]], b.points[[b.centre[k] for k in right]]
            d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", ca, cb)))
            close = d <= np.array([a.radius[k] for k in left]) + np.array([b.radius[k] for k in right]) + limit
            todo += zip(left[close].tolist(), right[close].tolist(), strict=True)


def unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def unpack(data: bytes, dim: int) -> np.ndarray:
    return unit(np.frombuffer(data, np.float64).reshape(-1, dim))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Of (vec_id, embedding, label): (vec_id, n_links, component_id, kept), a row per row of vectors.

    Vectors link if labels are equal and not null, dimensions are equal and the cosine in double precision is threshold or
    more. Null, zero and empty vectors, those with a null or non-finite component and those without a label link with nothing and are
    their own component. Equal vectors (copies) link with each other; rows of equal vec_id are rows of their own; a null
    vec_id is never a component_id while another is there, and is not kept. Empty table: no rows.
    """
    value = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.col("label").isNotNull() & F.forall(value, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0), F.lit(False))
    rows = materialise(vectors.select("vec_id", "label", value.alias("v"), sound.alias("sound")), "vectors")
    points = rows.where("sound").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    points = materialise(points.withColumn("point", F.monotonically_increasing_id()), "points")  # numbered once, as written
    kind = vectors.schema["label"].dataType.simpleString()
    groups = points.groupBy("label", F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    pivots = _pivots(points, groups, block)

    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def deal(frames):
        for pdf in frames:
            for (label, dim), rows in pdf.groupby([pdf.label, pdf.v.map(len)]):
                centres = shared.value.get((label, dim))
                cell = 0 if centres is None else np.argmax(unit(np.array(rows.v.tolist(), np.float64)) @ centres.T, axis=1)
                yield pd.DataFrame({"label": label, "dim": dim, "cell": cell, "point": rows.point, "copies": rows.copies, "v": [np.asarray(x, np.float64).tobytes() for x in rows.v]})

    dealt = points.select("label", "v", "point", "copies").mapInPandas(deal, f"label {kind}, dim int, cell int, point long, copies long, v binary")
    # A cell may hold more than a block: its points go on in several blocks, as many as its size asks for.
    dealt = materialise(dealt, "cells")
    sizes = dealt.groupBy("label", "dim", "cell").agg(F.count("*").alias("cell_rows"))
    parted = dealt.join(sizes, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("point"), F.ceil(F.col("cell_rows") / block)).cast("int"))

    def pack(pdf):
        dim = int(pdf.dim.iloc[0])
        v = unpack(b"".join(pdf.v), dim)
        centre = v.mean(axis=0)
        return pd.DataFrame({
            "label": pdf.label[:1], "dim": pdf.dim[:1], "cell": pdf.cell[:1], "block": [f"{pdf.cell.iloc[0]}.{pdf.part.iloc[0]}"], "centre": [centre.tolist()], "radius": [float(np.sqrt(((v - centre) ** 2).sum(axis=1)).max())],
            "points": [pdf.point.to_numpy(np.int64).tobytes()], "copies": [pdf.copies.to_numpy(np.int64).tobytes()], "vectors": [b"".join(pdf.v)],
        })

    packed = materialise(parted.groupBy("label", "dim", "cell", "part").applyInPandas(pack, f"label {kind}, dim int, cell int, block string, centre array<double>, radius double, points binary, copies binary, vectors binary"), "blocks")
    return _finish(rows, points, packed, threshold)


def _pivots(points: DataFrame, groups: DataFrame, block: int) -> dict:
    """For each group of more than a block: unit pivots, picked by hash, about one per block's worth of points, about 256 at most, and fewer
    where all groups would have over PIVOTS; a group without pivots is one cell of several blocks."""
    wanted = F.least(F.lit(256), F.ceil(F.col("n") / block)).cast("double")
    large = groups.where(F.col("n") > block).select(F.col("label").alias("__l"), F.col("dim").alias("__d"), (F.col("n") / wanted).alias("__every"), wanted.alias("__wanted"))
    over = max(1.0, (large.agg(F.sum("__wanted")).first()[0] or 0) / PIVOTS)
    every = F.ceil(F.col("__every") * F.lit(over)).cast("long")
    chosen = points.join(large, (F.col("label") == F.col("__l")) & (F.size("v") == F.col("__d"))).where(F.pmod(F.xxhash64("point"), every) == 0)
    found: dict = {}
    for r in chosen.select("label", "v").collect():
        found.setdefault((r.label, len(r.v)), []).append(r.v)
    return {k: unit(np.array(v, np.float64)) for k, v in found.items()}


def _gap(a: str, b: str):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _pairs(meta: DataFrame, limit: float) -> DataFrame:
    """(label, dim, x, y): blocks near enough to hold a link. Cells, a few hundred a label, are paired first, then the blocks of each pair of cells by themselves."""

    def cover(pdf):
        centres = np.array(pdf.centre.tolist())
        centre = centres.mean(axis=0)
        return pdf[["label", "dim", "cell"]].head(1).assign(centre=[centre.tolist()], radius=float((np.sqrt(((centres - centre) ** 2).sum(axis=1)) + pdf.radius.to_numpy()).max()))

    kind = meta.schema["label"].dataType.simpleString()
    cells = materialise(meta.groupBy("label", "dim", "cell").applyInPandas(cover, f"label {kind}, dim int, cell int, centre array<double>, radius double"), "covers")
    near = (F.col("l.label") == F.col("r.label")) & (F.col("l.dim") == F.col("r.dim")) & (F.col("l.cell") <= F.col("r.cell")) & (_gap("l.centre", "r.centre") <= F.col("l.radius") + F.col("r.radius") + limit + SLACK)
    cells = cells.alias("l").join(cells.alias("r"), near).select("l.label", "l.dim", F.col("l.cell").alias("cx"), F.col("r.cell").alias("cy"))
    side = lambda s: meta.select("label", "dim", F.col("cell").alias(f"c{s}"), F.col("block").alias(s), F.col("centre").alias(f"{s}_centre"), F.col("radius").alias(f"{s}_radius"))
    both = cells.join(side("x"), ["label", "dim", "cx"]).join(side("y"), ["label", "dim", "cy"])
    once = (F.col("cx") < F.col("cy")) | (F.col("x") <= F.col("y"))
    return both.where(once & (_gap("x_centre", "y_centre") <= F.col("x_radius") + F.col("y_radius") + limit)).select("label", "dim", "x", "y")


def _finish(rows: DataFrame, points: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    limit = float(np.sqrt(max(0, 2 - 2 * threshold)) + SLACK)
    pairs = _pairs(packed.select("label", "dim", "cell", "block", "centre", "radius"), limit)
    side = lambda name: packed.select("label", "dim", F.col("block").alias(name), F.col("points").alias(f"{name}_points"), F.col("copies").alias(f"{name}_copies"), F.col("vectors").alias(f"{name}_vectors"))
    tasks = pairs.join(side("x"), ["label", "dim", "x"]).join(side("y"), ["label", "dim", "y"]).repartition("label", "dim", "x", "y")

    def solve(frames):
        for pdf in frames:
            for t in pdf.itertuples():
                a = CoverTree(unpack(t.x_vectors, t.dim))
                b = a if t.x == t.y else CoverTree(unpack(t.y_vectors, t.dim))
                n, m = len(a.points), len(b.points)
                ca, cb = np.frombuffer(t.x_copies, np.int64), np.frombuffer(t.y_copies, np.int64)
                total, label = np.zeros(n if a is b else n + m, np.int64), np.arange(n if a is b else n + m)
                shift = 0 if a is b else n
                for i, j in dual(a, b, threshold):
                    np.add.at(total, i, cb[j])
                    np.add.at(total, j + shift, ca[i])
                    label = contract(len(label), np.concatenate([np.arange(len(label)), i]), np.concatenate([label, j + shift]))
                ids = np.frombuffer(t.x_points, np.int64) if a is b else np.concatenate([np.frombuffer(t.x_points, np.int64), np.frombuffer(t.y_points, np.int64)])
                some = np.flatnonzero(total)
                yield pd.DataFrame({"point": ids[some], "root": ids[label[some]], "links": total[some]})

    found = materialise(tasks.mapInPandas(solve, "point long, root long, links long"), "found")
    degrees = found.groupBy("point").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("point").alias("a"), F.col("root").alias("b")))
    placed = points.select("label", "v", "point", "least", "copies").join(degrees, "point", "left").join(parts.select(F.col("node").alias("point"), "component"), "point", "left")
    placed = placed.select("label", "v", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "point").alias("component"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = placed.join(named, "component").select("label", "v", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.where("sound").join(classes, ["label", "v"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
