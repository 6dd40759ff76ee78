"""Language ID of long runs of letters."""

import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import langid


def test_long_run_without_pieces():
    vocabulary = ["▁", *"abcdefgh"]
    lattice = langid.Lattice(vocabulary)
    table = np.zeros((len(vocabulary) + 1, 2))
    table[:-1, 0] = 1e-6
    table[:-1, 1] = 2e-6
    words = ["▁" + "abcdefgh" * 31 + "abc", "▁" + "h" * 251]
    assert lattice.log_probability(words, table) == pytest.approx(np.log([[1e-6, 2e-6]] * 2) * 252)
    assert lattice.log_probability(["▁abcdefghab"], table) == pytest.approx(np.log([[1e-6, 2e-6]]) * 11)


def test_text_without_spaces_in_two_languages(spark):
    draw = random.Random(3)
    letters = {"x": "\u0e01\u0e02\u0e04\u0e07\u0e08\u0e0a", "y": "\u0e0d\u0e15\u0e16\u0e17\u0e19\u0e1a"}
    text = lambda lang, n: "".join(draw.choice(letters[lang]) for _ in range(n))
    docs = spark.createDataFrame([(text(lang, 300), lang) for lang in "xy" for _ in range(20)], "text string, lang string")
    model = langid.train(docs, F.col("text"), F.col("lang"))
    found = list(langid.Scorer(model).languages([text(lang, 400) for lang in "xyxy"]))
    assert [x for x, _ in found] == list("xyxy") and all(s > 0.99 for _, s in found)


def test_whole_vocabulary():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=langid.VOCABULARY)
    every = {model.IdToPiece(i) for i in range(model.GetPieceSize()) if not (model.IsControl(i) or model.IsUnknown(i) or model.IsByte(i))}
    assert every <= set(langid.pieces(langid.VOCABULARY)) and max(map(len, every)) > 8


def test_long_pieces_are_summed():
    vocabulary = ["▁", "a", "b", "▁abababababab", "abababababababab", "ab"]
    table = np.array([[0.1, 0.2], [0.2, 0.1], [0.1, 0.1], [0.2, 0.1], [0.3, 0.4], [0.1, 0.1], [0, 0]])
    words = ["▁" + "ab" * 9, "▁" + "b" * 18, "▁" + "ab" * 6 + "ba" * 3]

    def plain(word):
        total = [np.ones(2)]
        for end in range(1, len(word) + 1):
            total.append(sum((total[end - len(p)] * table[i] for i, p in enumerate(vocabulary) if word[:end].endswith(p)), np.zeros(2)))
        return np.log(total[-1])

    assert langid.Lattice(vocabulary).log_probability(words, table) == pytest.approx(np.array([plain(w) for w in words]))


def test_expected_counts_by_all_segmentations(monkeypatch):
    vocabulary = ["▁", "a", "b", "ab", "ba", "▁a", "aba"]
    table = np.array([[0.1, 0.3], [0.2, 0.1], [0.1, 0.2], [0.2, 0.1], [0.1, 0.1], [0.1, 0.1], [0.2, 0.1], [0, 0]])
    words, counts, language = ["▁abab", "▁baba", "▁aaba"], np.array([2.0, 1.0, 5.0]), np.array([0, 1, 1])

    def cuts(word):
        if not word:
            yield []
        for i, p in enumerate(vocabulary):
            if word.startswith(p):
                for rest in cuts(word[len(p) :]):
                    yield [i, *rest]

    want = np.zeros_like(table)
    for word, n, at in zip(words, counts, language):
        every = [(c, np.prod(table[c, at])) for c in cuts(word)]
        assert langid.Lattice(vocabulary).log_probability([word], table)[0, at] == pytest.approx(np.log(sum(p for _, p in every)))
        for c, p in every:
            for i in c:
                want[i, at] += n * p / sum(p for _, p in every)
    for narrow in (24, 2):
        monkeypatch.setattr(langid, "NARROW", narrow)
        into = np.zeros_like(table)
        langid.Lattice(vocabulary).expected(words, counts, language, table, into)
        assert into == pytest.approx(want)


def test_long_words_teach():
    vocabulary = ["▁", *"abcdefgh"]
    table = np.full((len(vocabulary) + 1, 1), 1e-6)
    into = np.zeros_like(table)
    langid.Lattice(vocabulary).expected(["▁" + "abcdefgh" * 31], np.array([3.0]), np.array([0]), table, into)
    assert into[:, 0] == pytest.approx([3, *[93] * 8, 0])


def test_words_keep_their_marks():
    assert langid.LETTERS.findall("हिन्दी e\u0301té 漢字12x_y, \u0301") == ["हिन्दी", "e\u0301té", "漢字", "x", "y"]
    assert langid.words_of("Été 12x²y Ⅷ½z_Q٣") == ["été", "x", "y", "z", "q"]
    assert langid.words_of("a\U0001f600b \U00010400\U00010428 \U0001e2ec x\U0001e2ecy \U00010107") == ["a", "b", "\U00010428\U00010428", "x\U0001e2ecy"]
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    found = set("".join(langid.LETTERS.findall(" ".join(every))))
    assert found == {c for c in every if c.isalpha()}


def test_small_caches_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs, F.col("text"), F.col("lang"))
    texts = [r.text for r in docs.select("text").collect()]
    one = list(langid.Scorer(model).languages(texts))
    monkeypatch.setattr(langid, "CACHE", 100)
    for (a, p), (b, q) in zip(one, langid.Scorer(model).languages(texts), strict=True):
        assert a == b and p == pytest.approx(q)
