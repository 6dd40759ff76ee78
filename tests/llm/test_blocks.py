"""States that grow and shrink, and the forms that only larger inputs reach: joined lines, several blocks of items and vectors, several shards."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from textloom.llm import covertree, decontaminate, linededup, simhash
from textloom.llm.common import materialise

SF = "/root/testdata/sf0.001"


def counts(spark, texts):
    return materialise(linededup.reference_counts(spark.createDataFrame([(t,) for t in texts], "text string"), F.col("text")), "counts")


def held(state):
    return {(r.hi, r.lo): r.refs for r in state.collect()}


def test_documents_in_and_out(spark):
    old, new = ["a\nb\na", "B \nc", None, ""], ["a\nd", "c", "a\nd"]
    first, more = counts(spark, old), counts(spark, new)
    grown = materialise(linededup.changed(first, inserted=more), "grown")
    assert held(grown) == held(counts(spark, old + new))
    assert held(linededup.changed(grown, deleted=more)) == held(first)
    assert held(linededup.changed(first, inserted=more, deleted=first)) == held(more)
    assert held(linededup.changed(first, deleted=first)) == {}
    with pytest.raises(Exception, match="had not been inserted"):
        linededup.changed(first, deleted=more).collect()


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    known = rng.integers(0, 2**64, 5_000, np.uint64)
    made = linededup.CuckooFilter.of(known)
    assert made.contains(known).all()
    assert made.contains(rng.integers(0, 2**64, 50_000, np.uint64)).mean() < 0.01
    assert all(made.delete(int(h)) for h in known[:4_000]) and made.contains(known[4_000:]).all()
    assert made.contains(known[:4_000]).mean() < 0.01
    small = linededup.CuckooFilter(4)
    copies = [small.insert(7) for _ in range(20)]
    assert copies.count(True) == 8 and all(small.delete(7) for _ in range(8)) and not small.delete(7)


def test_filters_follow_the_state(spark):
    before = counts(spark, ["a\nb\nc"] * 2 + ["d"])
    after = materialise(linededup.changed(before, inserted=counts(spark, ["d\ne"] * 2), deleted=counts(spark, ["a\nb"])), "after")
    frequent = lambda s: s.where("refs >= 2")
    made = linededup.updated_filters(linededup.build_filters(frequent(before), 3), before, after, 3, min_docs=2)
    tables = {r.shard: linededup.CuckooFilter(0, np.frombuffer(bytes(r["filter"]), np.uint16)) for r in made.collect()}
    assert sum(int((t.table != 0).sum()) for t in tables.values()) == frequent(after).count()
    keys = [linededup.keys(b"c\nd\ne\na\nb")]
    known = linededup.suspects(keys, tables, 3)[0]
    assert {keys[0][0], keys[0][1], keys[0][2]} == known


def test_filters_grow(spark):
    """Shards without a filter, and ones that overflow, take any number of keys."""
    before = counts(spark, ["x"] * 2)
    made, state = linededup.build_filters(before.where("refs >= 2"), 3), before
    for step in range(3):
        after = materialise(linededup.changed(state, inserted=counts(spark, ["\n".join(f"{step} {i}" for i in range(600))] * 2)), "after")
        made, state = materialise(linededup.updated_filters(made, state, after, 3, min_docs=2), "filters"), after
    tables = {r.shard: linededup.CuckooFilter(0, np.frombuffer(bytes(r["filter"]), np.uint16)) for r in made.collect()}
    assert sum(int((t.table != 0).sum()) for t in tables.values()) == state.count() == 1_801
    keys = [linededup.keys("\n".join(f"{s} {i}" for s in range(3) for i in range(600)).encode())]
    assert linededup.suspects(keys, tables, 3)[0] == set(keys[0])


def test_exact_keys():
    rng = np.random.default_rng(2)
    hi, lo = rng.integers(-3, 3, 400), rng.integers(-(2**63), 2**63 - 1, 400)
    made = linededup.Exact(hi, lo)
    assert made.holds(hi, lo).all() and not made.holds(hi, lo ^ 1).any() and not made.holds(np.array([9]), lo[:1]).any()
    key = lambda a, b: np.array([a, b], "<i8").tobytes()
    assert made.among({key(hi[0], lo[0]), key(7, 7)}) == {key(hi[0], lo[0])}
    assert linededup.Exact(hi[:0], lo[:0]).among({key(1, 1)}) == set()


def test_joined_lines(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (None, "own line")], docs.schema))
    state = materialise(linededup.reference_counts(docs, F.col("text")), "state")
    columns = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    monkeypatch.setattr(linededup, "SHARD_KEYS", 3)
    found = linededup.drop_lines(docs, state, broadcast=6).select(columns)
    key = lambda r: tuple(map(str, r))
    expected = brute.lines([tuple(r) for r in docs.collect()])
    assert sum(r[2] for r in expected) > 0
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)


def test_item_blocks(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-1, None), (-2, "")], "doc_id long, text string"))
    key = lambda r: tuple(map(str, r))
    held = lambda **more: sorted(map(tuple, decontaminate.decontaminate(docs, items, **more).drop("text").collect()), key=key)
    one = held()
    most = items.agg(F.sum(F.octet_length("text"))).first()[0] // 4
    assert len(decontaminate.blocks(items.select(F.col("item_id").cast("string"), "text"), most)) > 3
    assert held(block_bytes=most) == one
    monkeypatch.setattr(decontaminate, "CANDIDATES", 3)
    assert held() == one
    assert any(r[3] for r in one)


def test_windows_of_common_words():
    """Items of few, frequent words, shared windows and repeats, against all places of all windows."""
    rng = np.random.default_rng(11)
    text = lambda n: " ".join("ab"[i] for i in rng.integers(0, 2, n)).encode()
    items = [(f"{i}", text(int(rng.integers(0, 14)))) for i in range(40)] + [("7", b"a b a b a b a b a b a b"), ("x", b"a " * 9), ("y", b"a " * 9)]
    docs = [text(int(n)) for n in rng.integers(0, 60, 50)] + [b"a " * 300, b"", b"c"]
    made = decontaminate.Matcher(decontaminate.index(items, 8, lambda known: dict.fromkeys(known, 1)))
    expected = brute.leaks([(i, d.decode()) for i, d in enumerate(docs)], [(i, t.decode()) for i, t in items])
    found = [decontaminate.digest([made.find(d)], 2) for d in docs]
    assert [tuple(c[0].as_py() for c in (f[0], f[1], f[2], f[3], f[7])) for f in found] == [r[1:] for r in expected]


@pytest.mark.parametrize("spread", [0.02, 0.3])
def test_vector_blocks(spark, spread, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    v = centres[rng.integers(0, 12, 400)] + spread * rng.normal(size=(400, 8))
    v[50:60] = v[50]
    rows = [(int(i), [float(x) for x in a.astype(np.float32)], int(i % 3 > 0)) for i, a in enumerate(v)]
    found = covertree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=16)
    assert sorted(map(tuple, found.collect())) == sorted(brute.cosine(rows))
    monkeypatch.setattr(covertree, "PIVOTS", 4)
    named = [(f"v{i:03}", v, f"l{label}") for i, v, label in rows]
    found = covertree.near_duplicates(spark.createDataFrame(named, "vec_id string, embedding array<float>, label string"), block=16)
    assert sorted(map(tuple, found.collect())) == sorted(brute.cosine(named))


def test_fingerprint_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 40)
    monkeypatch.setattr(simhash, "SAMPLE", 100)
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 2**64, 300, np.uint64)]
    for at in range(300):
        other = fps[int(rng.integers(0, len(fps)))]
        for bit in rng.choice(64, int(rng.integers(1, 4)), replace=False):
            other ^= 1 << int(bit)
        fps.append(other)
    fps = sorted(set(fps))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    pairs = [(signed(a), signed(b)) for k, a in enumerate(fps) for b in fps[:k] if (a ^ b).bit_count() <= 2]
    found = [tuple(r) for r in simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), len(fps)).collect()]
    nodes = [signed(x) for x in fps]
    one, other = brute.components(nodes, found), brute.components(nodes, pairs)
    assert len({(one[n], other[n]) for n in nodes}) == len({one[n] for n in nodes}) == len({other[n] for n in nodes})
