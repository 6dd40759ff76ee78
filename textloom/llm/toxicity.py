"""Toxicity by compression distance: two zstandard dictionaries, and windows of words that the toxic one shortens more.

A window is a run of WORDS words, a new one every STEP words; of fewer words zstandard would store most windows as they are, under either
dictionary. Both dictionaries end with the same ordinary training windows, so an ordinary window costs the same under either; before
these the toxic one has toxic windows, the ordinary one blanks of the same size. Most windows of a toxic document are ordinary, so the
toxic ones are found by compression too, in rounds: toxic documents are split into two folds, each fold's dictionary shortens the
other's windows, those it shortens more than nearly all ordinary windows are kept and trimmed to what ordinary training text seldom
holds, and the dictionaries are made anew from what is kept and a fresh draw of windows, in the rounds of ordinary windows too. A
threshold on the bytes saved and a logistic curve over a document's windows give the score; both are fitted to folds that their
dictionaries have not seen.
"""

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import append_columns, in_fold, texts
from textloom.llm.simhash import fingerprint

#: At most so many labelled documents of each class train the model, those of least hash.
SAMPLE = 2_000
WORDS, STEP, LEVEL = 16, 12, 15
SHARED_BYTES, OWN_BYTES = 12_000, 4_096
#: Rounds of selection; documents of each class read in one; the share of ordinary windows that a kept window must outdo; bytes of a segment.
ROUNDS, ROUND_DOCS, OUTDO, GRAM = 16, 150, 0.999, 5
#: Windows compressed at once.
BATCH = 65_536
FEATURES = 4
#: A score of so much rejects a document.
REJECT = 0.3
BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def windows_of(text: bytes, words: int = WORDS, step: int = STEP) -> np.ndarray:
    """(first byte, number of bytes) of each window; the last one ends with the last word. A text of fewer words is one window."""
    blank = BLANK[np.frombuffer(text, np.uint8)]
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    first, end = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros((0, 2), np.uint64)
    last = max(0, len(first) - words)
    at = np.arange(0, last + 1, step)
    if at[-1] < last:
        at = np.append(at, last)
    return np.stack([first[at], end[np.minimum(at + words, len(first)) - 1] - first[at]], axis=1).astype(np.uint64)


class Dictionary:
    """A raw-content zstandard dictionary and the lengths of windows under it."""

    def __init__(self, content: bytes):
        data = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        self.compressor = zs.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)

    def lengths(self, text: bytes, windows: np.ndarray) -> np.ndarray:
        if not len(windows):
            return np.zeros(0, np.int64)
        made = self.compressor.multi_compress_to_buffer(zs.BufferWithSegments(text, windows.tobytes()))
        return np.fromiter(map(len, made), np.int64, len(windows))


class Windows:
    """Bytes that the toxic dictionary saves on each window of a text against the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = Dictionary(ordinary), Dictionary(toxic)

    def gains(self, text: bytes | None) -> np.ndarray:
        text = (text or b"").lower()
        every = windows_of(text)
        parts = [every[i : i + BATCH] for i in range(0, len(every), BATCH)]
        return np.concatenate([np.zeros(0, np.int64), *(self.ordinary.lengths(text, w) - self.toxic.lengths(text, w) for w in parts)])


def features(gains: np.ndarray, threshold: int) -> list[float]:
    """The largest gain, the logs of the toxic windows' number, of their bytes saved and of their share of the document."""
    hits = gains[gains >= threshold]
    return [min(int(gains.max(initial=0)), 12) / 12, math.log1p(len(hits)), math.log1p(int(hits.sum())), math.log1p(100 * len(hits) / max(1, len(gains)))]


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    threshold: int
    weights: tuple[float, ...]

    def windows(self) -> Windows:
        return Windows(self.ordinary, self.toxic)

    def score(self, windows: Windows, text: bytes | None) -> float:
        x = features(windows.gains(text), self.threshold)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], x, strict=True))))))


def logistic(x: np.ndarray, y: np.ndarray, stands: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights, the intercept's first, by Newton's method with a ridge on all but the intercept; each row counts as often as stands says."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (stands * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (stands * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def apart(docs: list[bytes], bits: int = 6) -> list[bytes]:
    """docs without copies, exact or with SimHash fingerprints that differ in few bits: the first of each stays."""
    docs = list(dict.fromkeys(docs))
    prints = np.array([fingerprint(t) for t in docs], np.uint64)
    keep = [i for i in range(len(docs)) if not (np.bitwise_count(prints[:i] ^ prints[i]) <= bits).any()]
    return [docs[i] for i in keep]


def grams(text: bytes) -> np.ndarray:
    """The distinct runs of GRAM bytes of a text, as numbers."""
    if len(text) < GRAM:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(text, np.uint8).astype(np.uint64)
    return np.unique(sum(codes[i : len(codes) - GRAM + 1 + i] << np.uint64(8 * i) for i in range(GRAM)))


class Trainer:
    """Draws windows, selects toxic ones and lays out dictionaries; texts are in lower case."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes], seed: int = 1):
        self.draw = np.random.default_rng(seed)
        self.folds = [[(t, windows_of(t)) for t in toxic[i::2]] for i in (0, 1)]
        self.seen, self.unseen = ([(t, windows_of(t)) for t in ordinary[i::2]] for i in (0, 1))
        self.shared = self.drawn(self.seen, SHARED_BYTES)
        self.marks = self.marking(toxic, ordinary)
        self.kept: list[dict[bytes, None]] = [{}, {}]

    @staticmethod
    def marking(toxic: list[bytes], ordinary: list[bytes]) -> set[int]:
        """Runs of GRAM bytes over four times as frequent in toxic documents as in ordinary ones, beyond chance: by the bound on a binomial tail, less than one run is expected to be so by chance."""
        (a, n), (b, m) = (np.unique(np.concatenate([np.zeros(0, np.uint64), *map(grams, docs)]), return_counts=True) for docs in (toxic, ordinary))
        at = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
        there = np.where(b[at] == a, m[at], 0) if len(b) else np.zeros(len(a), np.int64)
        share, even = n / (n + there), len(toxic) / (len(toxic) + len(ordinary))
        surprise = n * np.log(share / even) + there * np.log(np.maximum(1 - share, 1e-300) / (1 - even))
        return set(a[(n * len(ordinary) > 4 * there * len(toxic)) & (surprise > math.log(max(1, len(a))))].tolist())

    def drawn(self, docs: list, size: int) -> bytes:
        """Windows of docs, drawn at random, up to size bytes."""
        docs, out, room = [d for d in docs if len(d[1])], [], size
        while docs and room > 0:
            text, windows = docs[self.draw.integers(len(docs))]
            at, n = map(int, windows[self.draw.integers(len(windows))])
            out.append(text[at : at + n])
            room -= n + 1
        return b"\n".join(out)[:size]

    def trimmed(self, window: bytes) -> bytes:
        """What a window has of marking runs."""
        keep = np.zeros(len(window) + 1, bool)
        for i in range(len(window) - GRAM + 1):
            if int.from_bytes(window[i : i + GRAM], "little") in self.marks:
                keep[i : i + GRAM] = True
        edge = np.flatnonzero(np.diff(keep, prepend=False))
        return b" ".join(window[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))

    def spread(self, segments: list[bytes], size: int, most: int) -> bytes:
        """Segments in random order up to size bytes, leaving out those of whose runs over half are there most times already."""
        out, room, seen = [], size, Counter()
        for i in self.draw.permutation(len(segments)):
            own = self.marks.intersection(grams(segments[i]).tolist())
            if own and len(segments[i]) < room and 2 * sum(seen[g] < most for g in own) >= len(own):
                out.append(segments[i])
                room -= len(segments[i]) + 1
                seen.update(own)
        return b"\n".join(out)

    def laid(self, own: bytes) -> bytes:
        """A dictionary's content: its own part, always as long, then the shared one: so shared text stands in the same place."""
        return own[:OWN_BYTES].ljust(OWN_BYTES) + b"\n" + self.shared

    def ordinary(self, size: int) -> bytes:
        return self.laid(self.drawn(self.seen, size))

    def some(self, docs: list) -> list:
        return [docs[i] for i in self.draw.permutation(len(docs))[:ROUND_DOCS]]

    def select(self, rounds: int) -> None:
        for _ in range(rounds):
            ordinary = Dictionary(self.ordinary(OWN_BYTES))
            usual, found = [], []
            for fold in (0, 1):
                kept = self.spread(list(self.kept[fold]), OWN_BYTES // 2, 2)
                toxic = Dictionary(self.laid(kept + b"\n" + self.drawn(self.folds[fold], OWN_BYTES - len(kept) - 1)))
                gain = lambda d, toxic=toxic: ordinary.lengths(*d) - toxic.lengths(*d)
                usual += map(gain, self.some(self.unseen))
                found.append([(d, gain(d)) for d in self.some(self.folds[1 - fold])])
            least = max(2, np.quantile(np.concatenate([np.zeros(1), *usual]), OUTDO))
            for fold in (0, 1):
                for (text, windows), gains in found[fold]:
                    for at, n in windows[gains >= least].tolist():
                        if segment := self.trimmed(text[at : at + n]):
                            self.kept[1 - fold][segment] = None

    def toxic(self, folds: tuple[int, ...]) -> bytes:
        return self.spread([s for f in folds for s in self.kept[f]], OWN_BYTES, 4)


def fit(toxic: list[bytes], ordinary: list[bytes], stands: tuple[float, float] = (1.0, 1.0), rounds: int = ROUNDS) -> ToxicityModel:
    """A model of the two classes' training texts. Copies count once. With fewer than four of a class, every score is the toxic texts' share.

    stands: how many labelled documents each toxic and each ordinary text stands for; the curve is fitted to the classes' shares so weighted.
    """
    toxic, ordinary = (apart([t.lower() for t in docs]) for docs in (toxic, ordinary))
    if min(len(toxic), len(ordinary)) < 4:
        share = len(toxic) * stands[0] / max(1.0, len(toxic) * stands[0] + len(ordinary) * stands[1])
        return ToxicityModel(b" " * 16, b" " * 16, 2, (math.log((share * 100 + 0.5) / (100 - share * 100 + 0.5)),) + (0.0,) * FEATURES)
    made = Trainer(toxic, ordinary)
    made.select(rounds)
    own = made.toxic((0, 1))
    plain = made.laid(b"")
    gains, y = [], []
    for fold in (0, 1):  # each half of the texts is measured by what the other half of the toxic ones gave
        windows = Windows(plain, made.laid(made.toxic((1 - fold,))))
        for label, docs in ((1.0, made.folds[fold]), (0.0, made.unseen[fold::2])):
            gains += [windows.gains(t) for t, _ in docs]
            y += [label] * len(docs)
    y = np.array(y)
    weight = np.where(y == 1, stands[0], stands[1] * len(ordinary) / max(1, len(made.unseen)))
    best = None
    for threshold in range(2, 9):
        x = np.array([features(g, threshold) for g in gains])
        w = logistic(x, y, weight)
        p = np.clip(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))), 1e-9, 1 - 1e-9)
        loss = -np.average(y * np.log(p) + (1 - y) * np.log(1 - p), weights=weight)
        if best is None or loss < best[0] - 1e-12:
            best = loss, threshold, w
    return ToxicityModel(plain, made.laid(own), best[1], tuple(map(float, best[2])))


def train(documents: DataFrame, labels: DataFrame, learn: Column | None = None, sample: int = SAMPLE) -> ToxicityModel:
    """Fits on at most sample documents of each class: labelled rows for which learn (over labels.doc_id) holds, of least hash.

    Rows whose label is neither 0 nor 1, or whose doc_id or text is null, teach nothing; an id in labels twice counts once.
    The ids are picked in labels before documents is read, so the join's right side has at most 2 * sample rows. Each picked id
    stands for its class' ids / picked ids, so that a score means the same whether or not the sample is the whole.
    """
    rows = labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)")
    rows = (rows.where(learn) if learn is not None else rows).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [rows.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (1, 0)]
    texts_of = documents.select("doc_id", "text").where("text is not null")
    of_class = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    found = texts_of.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").select("toxic", "text").collect()
    both = {c: sorted(x.text.encode() for x in found if x.toxic == c) for c in (1, 0)}
    return fit(both[1], both[0], stands=tuple(max(1.0, of_class.get(c, 0) / sample) for c in (1, 0)))


def with_score(df: DataFrame, model: ToxicityModel, text: Column, name: str = "toxicity_score") -> DataFrame:
    """df with a column of scores, 0 to 1, of whole texts; null and empty texts get the score of a text without windows."""

    def make():
        windows = model.windows()

        def work(column):
            return [pa.array([model.score(windows, t) for t in texts(column)], pa.float64())]

        return work

    return append_columns(df, [text], [T.StructField(name, T.DoubleType(), False)], make)


def rejected(score: Column, model: ToxicityModel) -> Column:
    """Whether a text goes: its score is REJECT or more, and above that of a text without windows, so that none goes by the share of toxic labels alone."""
    return (score >= REJECT) & (score > model.score(model.windows(), None))


def learned_rows() -> Column:
    return ~in_fold(F.col("doc_id"), 4, 2)
