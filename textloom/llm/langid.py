"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces; each language has a probability for every piece. A word's probability in a language is
the sum, over all ways to cut it into pieces, of the products of their probabilities, which a forward pass computes. Words are runs of letters
and pieces stay within them, so a text's probability is the product of its words'. Piece probabilities are learned by expectation-maximisation
over the counts of (language, word): forward and backward passes give each piece's expected count over all segmentations.
"""

import math
import re
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import append_columns, in_fold, materialise

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: A word is learned from and scored in stretches of STRETCH characters. Expectation-maximisation ends when no language's piece
#: probabilities move by more than TOLERANCE in all (half the sum of absolute changes), or after MOST_ROUNDS.
STRETCH, MOST_ROUNDS, TOLERANCE, SMOOTHING = 256, 5, 0.1, 0.1
#: Words remembered in a task, and bytes of their scores; words counted before they are passed on.
CACHE, CACHE_BYTES, COUNTED = 400_000, 100_000_000, 400_000
MOST_LANGUAGES = 2_000
#: Longer words than this are learned from in numbers of a wider range, so that their probabilities don't vanish.
NARROW = 24


def class_of(kinds: str, first: int, last: int) -> str:
    """A pattern's class of the characters from first to last whose Unicode category begins with one of kinds."""
    held = [c for c in range(first, last + 1) if unicodedata.category(chr(c))[0] in kinds]
    starts = [c for c, before in zip(held, [-2, *held], strict=False) if c != before + 1]
    ends = [c for c, after in zip(held, [*held[1:], -2], strict=True) if c + 1 != after]
    return "[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends, strict=True)) + "]"


def run_of(kinds: str) -> str:
    """A run of characters of these kinds, or one from beyond the first 65,536, whose many ranges are tried on such characters only."""
    return rf"(?:{class_of(kinds, 0, 0xFFFF)}+|(?=[\U00010000-\U0010FFFF]){class_of(kinds, 0x10000, 0x10FFFF)})"


#: Words are letters with the marks that combine with them, in lower case: digits and signs tell nothing of a language.
LETTERS = re.compile(f"{run_of('L')}{run_of('LM')}*")


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def pieces(path: str) -> list[str]:
    """The vocabulary's pieces, of any length; bytes stand as one private character each, from U+F0000 on."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = [model.IdToPiece(i) for i in range(model.GetPieceSize()) if not (model.IsControl(i) or model.IsUnknown(i) or model.IsByte(i))]
    return [*every, *(chr(0xF0000 + b) for b in range(256))]


class Lattice:
    """Piece numbers of every stretch of a group of equally long words, by hashes of their characters."""

    def __init__(self, vocabulary: list[str]):
        self.size, self.longest = len(vocabulary), max(map(len, vocabulary))
        self.single = {p for p in vocabulary if len(p) == 1}
        self.keys = np.zeros(self.size + 1, np.uint64)
        for at, piece in enumerate(vocabulary):
            h = 0
            for c in piece:
                h = (h * self.BASE + ord(c)) & 0xFFFFFFFFFFFFFFFF
            self.keys[at] = h
        if len(np.unique(self.keys)) <= self.size:
            raise ValueError("two pieces share a 64-bit hash")
        self.first, self.second = (np.full(1 << 20, self.size, np.int32) for _ in range(2))
        places = self.place(self.keys[:-1], self.FIRST)
        _, one = np.unique(places, return_index=True)
        self.first[places[one]] = one
        rest = np.setdiff1d(np.arange(self.size), one)
        places = self.place(self.keys[rest], self.SECOND)
        if len(np.unique(places)) < len(rest):
            raise ValueError("the table of pieces is too small")
        self.second[places] = rest

    BASE, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F

    @staticmethod
    def place(hashes: np.ndarray, by: int) -> np.ndarray:
        return ((hashes * np.uint64(by)) >> np.uint64(44)).astype(np.int64)

    def pieces_at(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes; size stands for no piece."""
        one = self.first[self.place(hashes, self.FIRST)]
        missed = np.flatnonzero((one != self.size) & (self.keys[one] != hashes))  # a piece is in the second table only if its place in the first is taken
        if len(missed):
            two = self.second[self.place(hashes[missed], self.SECOND)]
            one[missed] = np.where(self.keys[two] == hashes[missed], two, self.size)
        return one

    def spell(self, word: str) -> str:
        """word with the mark of a word's start, and its characters that are no piece as bytes."""
        word = "▁" + word
        single = self.single
        if single.issuperset(word):
            return word
        return "".join(c if c in single else "".join(chr(0xF0000 + b) for b in c.encode("utf-8", "surrogatepass")) for c in word)

    def stretches(self, words: list[str], n: int):
        """(i, length, piece numbers of words[i:i + length]), by end."""
        codes = np.array(words, f"<U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64)
        hashes: dict[int, np.ndarray] = {}
        for end in range(1, n + 1):
            code = codes[:, end - 1]
            hashes[end - 1] = np.zeros(len(words), np.uint64)
            hashes.pop(end - 1 - self.longest, None)
            for length in range(1, min(self.longest, end) + 1):
                i = end - length
                hashes[i] = hashes[i] * np.uint64(self.BASE) + code
                ids = self.pieces_at(hashes[i])
                if length == 1 or (ids < self.size).any():
                    yield i, length, ids

    def log_probability(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """Log of the summed probability of each word's segmentations in each language; words are spelled and equally long. table: (pieces + 1) x languages, the last row 0."""
        n = len(words[0])
        alpha: dict[int, np.ndarray] = {0: np.ones((len(words), table.shape[1]))}
        scale = np.zeros((len(words), table.shape[1]))
        for i, length, ids in self.stretches(words, n):
            end = i + length
            if length == 1:  # every end has this one, and it comes first
                alpha.pop(end - self.longest - 1, None)
                if end % 8 == 0:
                    self.rescale(alpha, scale)
                alpha[end] = np.zeros_like(scale)
            there = np.flatnonzero(ids != self.size)
            if 2 * len(there) < len(ids):
                alpha[end][there] += alpha[i][there] * table[ids[there]]
            else:
                alpha[end] += alpha[i] * table[ids]
        return np.log(np.maximum(alpha[n], 1e-300)) + scale

    @staticmethod
    def rescale(alpha: dict[int, np.ndarray], scale: np.ndarray) -> None:
        """Divides the sums still in use by the largest of them, where that is small, and adds its log to scale."""
        low = np.maximum.reduce(list(alpha.values()))
        if (low < 1e-20).any():
            by = np.where(low < 1e-20, np.maximum(low, 1e-300), 1.0)
            scale += np.log(by)
            for k in alpha:
                alpha[k] = alpha[k] / by

    def expected(self, words: list[str], counts: np.ndarray, language: np.ndarray, table: np.ndarray, into: np.ndarray) -> None:
        """Adds to into (pieces + 1 x languages) the expected number of each piece over words' segmentations, counts times each."""
        n = len(words[0])
        kind = np.float64 if n <= NARROW else np.longdouble
        steps = []
        for i, length, ids in self.stretches(words, n):
            there = np.flatnonzero(ids != self.size)
            if len(there):
                steps.append((i, i + length, there, ids[there], table[ids[there], language[there]].astype(kind)))
        alpha, beta = (np.zeros((n + 1, len(words)), kind) for _ in range(2))
        alpha[0], beta[n] = 1, 1
        for i, end, there, _, p in steps:
            alpha[end, there] += alpha[i, there] * p
        for i, end, there, _, p in reversed(steps):
            beta[i, there] += p * beta[end, there]
        weight = counts / np.maximum(alpha[n], np.finfo(kind).tiny)
        for i, end, there, ids, p in steps:
            np.add.at(into, (ids, language[there]), (alpha[i, there] * p * beta[end, there] * weight[there]).astype(np.float64))


@dataclass(frozen=True)
class LanguageModel:
    vocabulary: list[str]
    languages: list[str]
    table: np.ndarray  # (pieces + 1) x languages
    prior: np.ndarray  # log share of each language


class Scorer:
    """Log probabilities of words, remembered up to CACHE of them and CACHE_BYTES of scores, and the languages of texts."""

    def __init__(self, model: LanguageModel):
        self.model, self.lattice = model, Lattice(model.vocabulary)
        width = max(1, len(model.languages))
        self.most = max(1, min(CACHE, CACHE_BYTES // (8 * width)))
        self.known, self.rows = {}, np.zeros((1_024, width))

    def learn(self, words: set[str]) -> None:
        spell, score, table = self.lattice.spell, self.lattice.log_probability, self.model.table
        groups: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        for w in words:
            spelled = spell(w)
            own, spellings = groups[len(spelled)]
            own.append(w)
            spellings.append(spelled)
        at = len(self.known)
        while at + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for n, (own, spellings) in groups.items():
            if n <= STRETCH:
                for i in range(0, len(own), 4_096):
                    self.rows[at + i : at + i + len(own[i : i + 4_096])] = score(spellings[i : i + 4_096], table)
            else:
                for i, s in enumerate(spellings):
                    self.rows[at + i] = np.sum([score([s[j : j + STRETCH]], table) for j in range(0, n, STRETCH)], axis=0)[0]
            self.known.update(zip(own, range(at, at + len(own)), strict=True))
            at += len(own)

    def total(self, words: Counter) -> np.ndarray:
        """The summed scores of words, learned in parts that fit the cache."""
        words, out = list(words.items()), np.zeros(self.rows.shape[1])
        for i in range(0, len(words), self.most):
            some = words[i : i + self.most]
            new = {w for w, _ in some} - self.known.keys()
            if len(self.known) + len(new) > self.most:
                self.known.clear()
                new = {w for w, _ in some}
            self.learn(new)
            out += np.array([n for _, n in some], float) @ self.rows[np.fromiter((self.known[w] for w, _ in some), np.int64, len(some))]
        return out

    def languages(self, texts: list[str | None]):
        """(language, posterior probability) of each text."""
        for at in range(0, len(texts), 256):
            some = list(map(words_of, texts[at : at + 256]))
            new = set().union(*some) - self.known.keys()
            if len(self.known) + len(new) <= self.most:  # as a rule; else text by text, in parts
                self.learn(new)
            for words in some:
                if not self.model.languages or not words:
                    yield "und", 0.0
                    continue
                try:
                    total = self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)
                except KeyError:
                    total = self.total(Counter(words))
                total = total + self.model.prior
                best = int(np.argmax(total))
                yield self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def word_counts(documents: DataFrame, text: Column, lang: Column) -> DataFrame:
    """(lang, word, n) over all rows with both."""

    def flush(total):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in total]), pa.array([k[1] for k in total]), pa.array(total.values(), pa.int64())], names=["lang", "word", "n"])

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for t, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.update((language, w) for w in words_of(t))
                if len(total) > COUNTED:
                    yield flush(total)
                    total.clear()
        if total:
            yield flush(total)

    return documents.select(text.alias("t"), lang.alias("l")).where("t is not null and l is not null").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(documents: DataFrame, text: Column, lang: Column, vocabulary: str = VOCABULARY, rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE) -> LanguageModel:
    """Learns from all rows whose text and lang are not null. vocabulary: a file on the driver, of fixed size, sent to the tasks."""
    known = pieces(vocabulary)
    spark = documents.sparkSession
    shares = documents.where(text.isNotNull() & lang.isNotNull()).groupBy(lang.alias("lang")).count().limit(MOST_LANGUAGES + 1).collect()
    if len(shares) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    shares = sorted((r.lang, r["count"]) for r in shares)
    languages = [s for s, _ in shares]
    size, place = len(known), {s: i for i, s in enumerate(languages)}
    table = np.zeros((size + 1, len(languages)))
    table[:size] = 1 / size
    if languages:
        words = materialise(word_counts(documents, text, lang), "words")
        for _ in range(rounds):
            shared = spark.sparkContext.broadcast((known, place, table))

            def expect(frames, shared=shared):
                known, place, table = shared.value
                lattice, into = Lattice(known), np.zeros_like(table)
                for pdf in frames:
                    groups = defaultdict(list)
                    for language, word, n in zip(pdf.lang, pdf.word, pdf.n, strict=True):
                        spelled = lattice.spell(word)
                        for i in range(0, len(spelled), STRETCH):
                            part = spelled[i : i + STRETCH]
                            groups[len(part)].append((part, n, place[language]))
                    for group in groups.values():
                        some, n, language = zip(*group, strict=True)
                        lattice.expected(list(some), np.array(n, float), np.array(language), table, into)
                for language, at in place.items():
                    if into[:, at].any():
                        yield pd.DataFrame({"lang": [language], "counts": [into[:, at].tobytes()]})

            def total(pdf):
                return pd.DataFrame({"lang": pdf.lang[:1], "counts": [np.sum([np.frombuffer(b) for b in pdf["counts"]], axis=0).tobytes()]})

            rows = words.mapInPandas(expect, "lang string, counts binary").groupBy("lang").applyInPandas(total, "lang string, counts binary").collect()
            counts = np.zeros((size + 1, len(languages)))
            for r in rows:
                counts[:, place[r.lang]] = np.frombuffer(r["counts"])
            before, table = table, np.zeros_like(table)
            table[:size] = (counts[:size] + SMOOTHING) / (counts[:size].sum(axis=0) + SMOOTHING * size)
            shared.unpersist()
            if np.abs(table - before).sum(axis=0).max() / 2 <= tolerance:
                break
    every = sum(n for _, n in shares)
    return LanguageModel(known, languages, table, np.array([math.log(n / every) for _, n in shares]))


def with_language(df: DataFrame, model: LanguageModel, text: Column, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """df with the language of each whole text and its posterior probability; und and 0 for a null text or one without a letter, or without a language learned.

    Ties go to the first language in code point order. Columns of df with these names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.vocabulary, model.languages, model.table, model.prior))

    def make():
        scorer = Scorer(LanguageModel(*shared.value))

        def work(column):
            found = list(scorer.languages(column.to_pylist()))
            return [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]

        return work

    return append_columns(df, [text], [T.StructField(names[0], T.StringType(), False), T.StructField(names[1], T.DoubleType(), False)], make)


def learned_rows() -> Column:
    return ~in_fold(F.col("doc_id"), 4, 2)
