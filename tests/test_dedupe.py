"""Copies of a shingle set: paired with their representative, and resolved with it."""

import re

from pyspark.sql import functions as F

from textloom import catalogue

BASE = [f"w{i % 23}x{i}" for i in range(60)]
TEXTS = [
    " ".join(BASE), " ".join(BASE[:59]), " ".join(BASE), " ".join(BASE).upper() + "!", " ".join(BASE[:59]) + " \u00e9", "Two words", "two, words", "own text of this one document here", "", None, "two words", " ".join(BASE[:52]), " ".join(BASE[:52]),
]


def brute():
    """(sets by id, whether each id stays): ids in order, each against all kept before."""
    sets, kept = {}, {}
    for i, t in enumerate(TEXTS):
        words = re.findall("[a-z0-9']+", (t or "").lower())
        sets[i] = frozenset(" ".join(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset(words)
        kept[i] = not any(kept[j] and similar(sets[i], sets[j]) >= 0.85 for j in range(i))
    return sets, kept


def similar(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def written(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_pairs_name_every_copy(spark, tmp_path):
    sets, _ = brute()
    rows = [tuple(r) for r in catalogue.queries()["near_duplicate_pairs"](spark, written(spark, tmp_path)).collect()]
    assert len(rows) == len(set(rows)) and all(a < b for a, b, _ in rows)
    stands = {i: i for i in sets} | {b: a for a, b, s in rows if s == 1.0}
    near = {(a, b): s for a, b, s in rows if s < 1.0}
    found = {}
    for i in sets:
        for j in range(i):
            a, b = sorted((stands[i], stands[j]))
            if a == b or (a, b) in near:
                found[(j, i)] = near.get((a, b), 1.0)
    assert found == {(j, i): round(similar(sets[i], sets[j]), 6) for i in sets for j in range(i) if similar(sets[i], sets[j]) >= 0.85}


def test_greedy_decides_every_id(spark, tmp_path):
    _, kept = brute()
    found = [tuple(r) for r in catalogue.queries()["greedy_near_duplicates"](spark, written(spark, tmp_path)).select("id", F.col("kept")).collect()]
    assert len(found) == len(TEXTS) and dict(found) == kept


def test_hashes_are_of_shingles(spark):
    """As many hashes as distinct shingles, sorted, and the same for the same shingles; made without joining tokens."""
    from textloom.functions import text as tx

    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string").select("id", tx.shingles(F.col("t")).alias("w"), tx.shingle_hashes(F.col("t")).alias("h"))
    found = {r.id: r for r in df.collect()}
    assert all((r.w is None) == (r.h is None) and r.h == (None if r.h is None else sorted(set(r.h))) and len(r.w or []) == len(r.h or []) for r in found.values())
    assert all((set(a.w or []) == set(b.w or [])) == ((a.h or []) == (b.h or [])) for a in found.values() for b in found.values())
