"""What a capped sample, null and repeated ids must not change."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.llm import toxicity

ID_TEXT = "doc_id long, text string"


def test_capped_toxicity_sample_keeps_the_prior(spark):
    draw = random.Random(5)
    words = [f"w{i}x{i * i % 97}" for i in range(3_000)]
    text = lambda marked: " ".join([*draw.sample(words, 40), *["vilgrubness"] * marked])
    rows = [(i, text(i < 120 and i % 10 < 7), int(i < 120)) for i in range(1_200)]
    docs = spark.createDataFrame([r[:2] for r in rows], ID_TEXT)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    empty = {}
    for sample in (2_000, 120):
        model = toxicity.train(docs, labels, sample=sample)
        windows = model.windows()
        empty[sample] = model.score(windows, rows[-1][1].encode())
        assert sum(model.score(windows, t.encode()) for _, t, _ in rows) / len(rows) == pytest.approx(0.1, abs=0.02)
    # 36 of 1,116 texts without the mark are toxic; at equal shares it would be 36 of 156.
    assert empty[120] == pytest.approx(empty[2_000], abs=0.02) and empty[120] < 0.1


def test_near_duplicates_of_null_and_repeated_ids(spark):
    import corpus_pipeline

    own = lambda k: " ".join(f"t{k}n{i}" for i in range(40))
    rows = [(None, own(0)), (None, own(1)), (None, own(2)), (None, own(2)), (7, own(3)), (7, own(4)), (7, own(4)), (8, own(4)), (9, own(5)), (None, own(5))]
    docs = spark.createDataFrame(rows, ID_TEXT).repartition(3)
    kept = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id", "text").collect()]
    wanted = [(None, own(0)), (None, own(1)), (None, own(2)), (7, own(3)), (7, own(4)), (9, own(5))]
    assert sorted(kept, key=str) == sorted(wanted, key=str)
