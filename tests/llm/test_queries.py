"""Each query against brute force: on the smallest tables, and on rows with nulls, empty and long texts, ties and repeats."""

import hashlib
import re
import shutil
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
import tiktoken  # noqa: F401
from pyspark.sql import functions as F
from tests.compare import database, differences
from tests.llm import brute

from textloom.llm import common, interpolated_lm, lengths, mixing, queries, sharding, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string, shard int, size string, `TEXT_crc32` string, contaminated string, hits string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000)) + "\n" + "z" * 5_000


def odd_rows():
    base = [
        (1, "The same text of several words, twice over.\nlicence line", "en", "a"), (2, "The same text of several words, twice over.\nlicence line", "en", "a"),
        (2, "The same text of several words, twice over.\nlicence line", "en", None), (3, None, "fr", "b"), (4, "", None, "b"), (5, " \t\n \r\n", "de", None), (None, "a null id with words enough for shingles", "en", "a"),
        (None, None, None, None), (6, LONG, "en", "a"), (7, "ÀÉ ß 漢字 \U0001f600 mixed space \x0b ok", "fr", "c"), (8, "12 34 !!", "de", "c"), (-9, "negative id and one two", "es", "é"), (2**62, "large id one two three four five six seven eight nine", "es", "Z"),
    ]
    base += [(100 + i, f"  Licence LINE \nown text number {i} of many here\r\nlicence line", "en", "hot") for i in range(12)]
    return [(*r, len(r[1] or ""), 0.5, "x", 7, "s", "c", "c", "h") for r in base]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of tables of odd rows, with columns whose names clash with results'."""
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(odd_rows(), DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    items = [(1, "large id one two three four five six seven eight nine"), (2, "Own text"), (2, "number 3 of many"), (None, "one two"), (3, None), (4, "?!"), (5, "one two")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(1, 1, 1), (2, 0, 0), (2, 1, 1), (None, 1, 1), (100, None, None), (101, 1, 0), (102, 1, 0), (103, 1, 7)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    v = lambda *x: [None if a is None else float(a) for a in x]
    vectors = [(1, v(1, 0), 1), (2, v(2, 0), 1), (2, v(1, 0.1), 1), (3, v(1, 0), 2), (4, v(0, 0), 1), (5, None, 1), (6, v(1, None), 1), (7, v(float("nan"), 1), 1), (8, v(float("inf"), 1), 1), (9, v(1, 0), None), (10, v(1, 0, 0), 1), (11, [], 1), (None, v(1, 0), 1), (None, v(0, 1), 1), (12, v(1, 0), 2), (13, v(1e38, 1e30), 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark", "labels", "embeddings"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


def rows(df):
    return [tuple(r) for r in df.collect()]


rows_of = rows


def same(found, expected):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(found, key=key) == sorted(expected, key=key)


def documents(path, *columns):
    return [tuple(r.values()) for r in pq.read_table(f"{path}/documents.parquet", columns=list(columns)).to_pylist()]


@pytest.mark.parametrize("where", [SF, "odd"])
def test_simhash(spark, where, odd):
    path = odd if where == "odd" else where
    same(rows(queries.op9_simhash_near_dedup(spark, path)), brute.simhash(documents(path, "doc_id", "text")))


@pytest.mark.parametrize("where", [SF, "odd"])
def test_line_dedup(spark, where, odd):
    path = odd if where == "odd" else where
    same(rows(queries.op3_line_dedup(spark, path)), brute.lines(documents(path, "doc_id", "text")))


@pytest.mark.parametrize("where", [SF, "odd"])
def test_decontamination(spark, where, odd):
    path = odd if where == "odd" else where
    items = [tuple(r.values()) for r in pq.read_table(f"{path}/benchmark.parquet").to_pylist()]
    same(rows(queries.op7_decontamination(spark, path)), brute.leaks(documents(path, "doc_id", "text"), items))


@pytest.mark.parametrize("where", [SF, "odd"])
def test_embeddings(spark, where, odd):
    path = odd if where == "odd" else where
    vectors = [tuple(r.values()) for r in pq.read_table(f"{path}/embeddings.parquet", columns=["vec_id", "embedding", "label"]).to_pylist()]
    same(rows(queries.op8_embedding_near_dedup(spark, path)), brute.cosine(vectors))


@pytest.mark.parametrize("where", [SF, "odd"])
def test_lm_scoring(spark, where, odd):
    path = odd if where == "odd" else where
    found = rows(queries.op5_lm_scoring(spark, path))
    expected = brute.language_model(documents(path, "doc_id", "text"))
    same([(*r[:5], round(r[5], 5)) for r in found], [(*r[:5], round(r[5], 5)) for r in expected])
    order = lambda r: (r[0] is None, r[0] or 0, r[-1])
    for (i, score), (j, want) in zip(sorted(((r[0], r[6]) for r in found), key=order), sorted(brute.interpolated(documents(path, "doc_id", "text")), key=order), strict=True):
        assert i == j and score == pytest.approx(want, rel=2e-4, abs=1e-3)
    if where == SF:
        held = [r for r in found if r[1]]
        assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_lm_levels(spark, monkeypatch):
    """Blocks merged over three levels, and ids of text, give the scores of one level."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("cast(doc_id as string) as name", "text as body")
    one = {r.doc_id: (r.n_known, r.base_score, r.score) for r in interpolated_lm.score_documents(docs, "name", "body").collect()}
    monkeypatch.setattr(interpolated_lm, "FAN", 3)
    monkeypatch.setattr(interpolated_lm, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(interpolated_lm, "CHUNK", 2_000)
    for i, found in {r.doc_id: (r.n_known, r.base_score, r.score) for r in interpolated_lm.score_documents(docs, "name", "body").collect()}.items():
        assert found == pytest.approx(one.pop(i), rel=1e-9)
    assert not one


@pytest.mark.parametrize("where", [SF, "odd"])
def test_mixing(spark, where, odd):
    path = odd if where == "odd" else where
    found = rows(queries.op6_mixing(spark, path))
    again = rows(queries.op6_mixing(spark, path))
    same(found, again)
    docs = documents(path, "doc_id", "text", "source")
    size = lambda t: len(brute.WORDS.findall((t or "").encode()))
    total = Counter()
    for _, t, s in docs:
        total[s] += size(t)
    goal = brute.targets(list(total.items()))
    same([(r[0], r[1], r[2], round(r[3], 6)) for r in found], [(i, size(t), total[s], round(goal[s], 6)) for i, t, s in docs])
    assert sum(goal.values()) == pytest.approx(1.5 * sum(total.values()))
    assert all(0 <= r[4] <= 2 * r[1] for r in found)
    taken = Counter()
    for r in found:
        taken[(r[2], r[3])] += r[4]
    wanted = Counter()
    for s in total:
        wanted[(total[s], goal[s])] += int(goal[s])
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in wanted.items() if v}


@pytest.mark.parametrize("sizes", [[], [(None, 0)], [(None, 5)], [("b", 10), ("a", 1_000), ("Z", 3), (None, 7), ("é", 0), ("\U0001f600", 50), ("\uffff", 20)], [(f"s{i:03}", i * i % 91) for i in range(400)]])
def test_targets(spark, sizes):
    found = mixing.targets(spark.createDataFrame(sizes, "source string, n long").repartition(3)).collect()
    assert {r.source: r.target for r in found} == pytest.approx(brute.targets(sizes))


def test_many_ranges(spark, monkeypatch):
    """A source of many ranges and several stretches of them, joined rather than sent targets: the sums are those of one sort."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 2)
    monkeypatch.setattr(mixing, "BROADCAST", 0)
    monkeypatch.setattr(mixing, "sums_before", lambda *a: common.sums_before(*a, fan=7))
    docs = spark.range(600).selectExpr("id", "if(id % 3 = 0, null, concat('s', id % 5)) as source", "id % 17 as words")
    found = mixing.mix(docs, F.col("source"), F.col("words"), [F.col("id")]).collect()
    of = defaultdict(list)
    for r in found:
        of[r.source].append((hashlib.md5(f"mix|{r.id}".encode()).hexdigest(), r))
    assert len(found) == 600
    for rs in of.values():
        at = 0
        for _, r in sorted(rs, key=lambda x: x[0]):
            assert r.start == at
            at += r.size


@pytest.mark.parametrize("where", [SF, "odd"])
def test_sharding(spark, where, odd):
    path = odd if where == "odd" else where
    found = rows(queries.op2_sharding(spark, path))
    same([(r[0], r[1], r[2]) for r in found], [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in documents(path, "doc_id", "text")])
    slots, of = defaultdict(list), {}
    for doc, _, _, law, shard, slot, grown in found:
        assert law == "key" and 0 <= shard < 16 and grown in (shard, 16)
        assert of.setdefault(doc, (shard, grown)) == (shard, grown)
        slots[shard].append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("where", [SF, "odd"])
def test_token_counts(spark, where, odd):
    path = odd if where == "odd" else where
    with open(lengths.VOCABULARY, "rb") as f:
        encode = lengths.encoder(f.read()).encode_ordinary
    n = np.array([len(encode(t)) if t else 0 for _, t in documents(path, "doc_id", "text")])
    expected = [(int(x), int((n == x).sum()), len(n), int(n.sum()), int((n >= x).sum()), int(n[n >= x].sum()), float((n <= x).mean()), int(np.minimum(n, x).sum())) for x in np.unique(n)]
    same([(*r[:6], round(r[6], 9), r[7]) for r in rows(queries.op4_token_counts(spark, path))], [(*r[:6], round(r[6], 9), r[7]) for r in expected])
    table = queries.op4_token_counts(spark, path).cache()
    for limit in (0, 1, 100, 333, 10**9):
        assert lengths.at_limit(table, limit) == {"docs": len(n), "tokens": int(n.sum()), "docs_cut": int((n > limit).sum()), "tokens_within": int(np.minimum(n, limit).sum())}


@pytest.mark.parametrize("where", [SF, "odd"])
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, where, odd, name):
    path = odd if where == "odd" else where
    assert differences(queries.queries()[name](spark, path), database(path), queries.oracle_sql()[name]) is None


def test_language_id(spark, odd):
    found = queries.op1_language_id(spark, SF).toPandas()
    held = found.merge(pd.read_parquet(f"{SF}/documents.parquet"), on="doc_id").query("held_out")
    assert len(held) > 30 and (held.lang_pred == held.lang).mean() > 0.95
    odd_found = rows(queries.op1_language_id(spark, odd))
    texts = Counter((i, t) for i, t in documents(odd, "doc_id", "text"))
    assert len(odd_found) == sum(texts.values())
    und = {i for i, t in texts if not t or not any(map(str.isalpha, t))}
    assert all((r[2] == "und") == (r[0] in und or r[0] is None and r[2] == "und") and 0 <= r[3] <= 1 for r in odd_found if r[0] is not None)
    assert all(r[1] == (brute.crc(r[0]) % 4 == 2) for r in odd_found)


def test_toxicity(spark, odd):
    path = "/root/testdata/sf0.1"
    found = queries.op10_toxicity(spark, path).toPandas()
    held = found.merge(pd.read_parquet(f"{path}/labels.parquet"), on="doc_id").query("held_out")
    hit = held[held.predicted == 1]
    assert ((found.score >= 0.3) == (found.predicted == 1)).all() and found.score.between(0, 1).all()
    assert (hit.toxic == 1).mean() > 0.8 and (held[held.toxic == 1].predicted == 1).mean() >= 0.4
    scores = {r[0]: r[2] for r in rows(queries.op10_toxicity(spark, odd)) if r[0] is not None}
    assert len(rows(queries.op10_toxicity(spark, odd))) == len(documents(odd, "doc_id"))
    assert scores[3] == scores[4] == scores[5]  # null, empty and blank texts have no windows


def test_toxic_windows():
    def plain(text, size, step):
        words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
        starts = [*range(0, max(0, len(words) - size) + 1, step)] if words else []
        if words and len(words) > size and starts[-1] + size < len(words):
            starts.append(len(words) - size)
        return [(words[i][0], words[min(i + size, len(words)) - 1][1] - words[i][0]) for i in starts]

    for text in (b"", b" \n", b"one", b" a b  c\td ", b"a b c d e", b"a b c d e f", " é ß x\x0by z ".encode(), b"x " * 1_001):
        for size, step in ((4, 3), (toxicity.WORDS, toxicity.STEP)):
            assert [tuple(map(int, w)) for w in toxicity.windows_of(text, size, step)] == plain(text, size, step)
    one = toxicity.Dictionary(b"some words that a dictionary may hold for a test " * 3)
    text = b"words that a dictionary may hold, and other words"
    every = toxicity.windows_of(text, 4, 3)
    assert one.lengths(text, every).tolist() == [len(one.compressor.compress(text[int(a) : int(a + n)])) for a, n in every]


def test_empty_tables(spark, empty):
    for name, query in queries.queries().items():
        assert rows(query(spark, empty)) == [], name


def test_pipeline(spark, odd, empty):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = docs
    items = [tuple(r.values()) for r in pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pylist()]
    assert all(brute.leaks([(0, t)], [])[0][1] >= 8 for _, t in items)  # so any hit is a whole window
    for name, stage in p.STAGES[:3]:
        held = [tuple(r) for r in kept.select("doc_id", "text").collect()]
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = stage(spark, kept, "/root/testdata/sf0.01").cache()
        assert kept.columns == docs.columns
        after = [r.doc_id for r in kept.select("doc_id").collect()]
        assert len(after) == len(set(after)) and set(after) <= before and len(after) > 0.5 * len(before), name
        if name == "decontamination":
            dirty = {r[0] for r in brute.leaks(held, items) if r[2] > 0}
            assert len(dirty) > 15 and set(after) == before - dirty
    ids = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    assert len({c for _, _, c in brute.simhash(ids)}) == len(ids)
    assert p.drop_near_duplicates(spark, kept, "").count() == len(ids)
    mixed = p.mix_sources(spark, kept, "").groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("n")).collect()
    own = kept.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("n"), F.max(mixing.words(F.col("text"))).alias("most")).collect()
    goal = brute.targets([(r.source, r.n) for r in own])
    assert all(abs(r.n - goal[r.source]) <= {o.source: o.most for o in own}[r.source] / 2 + 1 for r in mixed)
    for path in (odd, empty):
        out = p.run(spark, path)
        assert set(docs.columns) <= set(out.columns)
        assert (out.count() > 0) == (path == odd)


def test_pipeline_short_items(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([(1, "one two three"), (2, "four five"), (3, "a b c d e f g h i")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "so one two three it is", 1, "h"), (2, "one two three, four five", 2, "h"), (3, "x a b c d e f g h y", 3, "h"), (4, "a b c d e f g x h i", 4, "h"), (4, None, 5, "h"), (None, "four five", 6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, hits string")
    kept = p.drop_contaminated(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    same(rows_of(kept), [rows[0], rows[3], rows[4], rows[5]])


def test_pipeline_clashing_columns(spark):
    """Stages keep the values of columns whose names they use themselves."""
    import corpus_pipeline as p

    own = lambda k: " ".join(f"t{k}n{i}" for i in range(30))
    rows = [(i, own(i), "a" if i % 3 else None, i * 7, f"s{i}", -i, f"r{i}", i * 11, i * 13) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, start string, `row` int, fingerprint string, `__row` int, taken int")
    assert rows_of(p.drop_near_duplicates(spark, docs, "")) and p.drop_near_duplicates(spark, docs, "").columns == docs.columns
    same(rows_of(p.drop_near_duplicates(spark, docs, "")), rows)
    mixed = rows_of(p.mix_sources(spark, docs, ""))
    assert mixed and set(mixed) <= set(rows)
    sharded = p.shard(spark, docs.withColumn("slot", F.lit(-5)), "")
    assert {tuple(r)[:9] for r in sharded.select(docs.columns).collect()} == set(rows)
    assert sorted(r.slot for r in sharded.where("shard = 3").collect()) == list(range(sharded.where("shard = 3").count()))


def test_tree_moves_only_what_it_must(spark):
    keys = spark.range(4_000).withColumnRenamed("id", "k")

    def shards(tree):
        return {r.k: r.shard for r in sharding.with_shard(keys, tree, F.col("k")).collect()}

    tree = sharding.Tree.of(16)
    before = shards(tree)
    share = Counter(before.values())
    assert len(share) == 16 and all(180 < n < 330 for n in share.values())
    heavier = sharding.Tree(tuple(tuple(tuple((s, 3.0 if s == 5 else w) for s, w in rack) for rack in region) for region in tree.regions))
    after = shards(heavier)
    rack = {s: (i, j) for i, region in enumerate(tree.regions) for j, r in enumerate(region) for s, _ in r}
    moved = [(before[k], after[k]) for k in before if before[k] != after[k]]
    assert moved and all(rack[b][0] == rack[5][0] for _, b in moved)  # nothing moves into a region whose weight stays
    assert all(rack[a][0] != rack[5][0] or rack[b] == rack[5] for a, b in moved)  # nor between its racks but into the heavier one
    assert all(b == 5 for a, b in moved if rack[a] == rack[5])
    for n in (3, 16, 17, 18):
        a, b = shards(sharding.Tree.of(n)), shards(sharding.Tree.of(n + 1))
        if n >= 16:
            assert all(a[k] == b[k] or b[k] == n for k in a)
        assert set(a.values()) == set(range(n))
    shutil.rmtree("/tmp/none", ignore_errors=True)
