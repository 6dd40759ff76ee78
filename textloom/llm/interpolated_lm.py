"""LM scoring by deleted interpolation of bigram, unigram and uniform maximum-likelihood estimates.

P(w | h) = L * c(hw) / c(h) + (1 - L) * P(w) and P(w) = M * c(w) / N + (1 - M) / (V + 1). L depends on the bucket of c(h), the
frequency of the context. L and M are learned by expectation-maximisation on a deleted part of the training documents, with counts
from the rest; the model then counts all training documents. All counts are exact and over all training documents.

The corpus is taken in chunks of whole documents. A chunk's distinct n-grams go, as sorted hashes in compressed blocks, to
shards of the hash space; a shard adds up the counts of all chunks and answers each chunk with the totals of its n-grams. So counting and
looking up are one shuffle of distinct n-grams per chunk; a hot word is one entry per chunk, and no model is broadcast or collected.

A chunk makes at most FAN blocks. A corpus that needs more shards goes through levels: FAN chunks' blocks of one range of hashes are merged,
the merged block is cut into up to FAN finer ones, and so on down to the shards; answers come back the same way. So the blocks,
like their bytes, grow with the corpus times the number of levels, which is 1 to 4 GB, 2 to 1 TB and 3 to 270 TB.
"""

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard as zs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import fold, materialise, texts

#: Tokens of a chunk, about; bytes of text for each shard, about; how many words a task remembers.
CHUNK, SHARD_BYTES, CACHE = 1_000_000, 16_000_000, 300_000
#: Blocks that a chunk or a merged block is cut into at most, and blocks that are merged.
FAN = 256
END = xxhash.xxh3_64_intdigest(b"\n")
DEALT = "target long, kind int, chunk long, shard int, deleted boolean, a binary, b binary, c binary"
ANSWERED = "kind int, chunk long, shard int, deleted boolean, a binary, b binary, c binary"


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    """60 bits, the last of which tells words from bigrams: a shared key makes two n-grams one, which of n words or bigrams about n * n / 2**60 pairs do."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(4)


def bigrams(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of bigrams are even, keys of words odd."""
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + mixed(word)) & ~np.uint64(1)


def planes(values: np.ndarray, level: int = 1) -> bytes:
    """Compressed: the values' first bytes, then their second ones, and so on."""
    return zs.ZstdCompressor(level=level).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def values_of(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zs.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(values_of(data, np.uint64), dtype=np.uint64)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Rises with the key, so that a chunk's keys of a shard are a stretch."""
    return ((keys >> np.uint64(28)) * np.uint64(shards)) >> np.uint64(32)


class Chunk:
    """words: a chunk's distinct word keys, sorted; at: each token's word; starts: each document's first token."""

    def __init__(self, words: np.ndarray, at: np.ndarray, starts: np.ndarray):
        self.words, self.at, self.starts = words, at, starts
        end = int(np.searchsorted(words, mixed(np.array([END], np.uint64))[0] | np.uint64(1)))
        self.before = np.empty_like(at)
        self.before[1:] = at[:-1]
        self.before[starts] = end  # a text begins after an end: the end's count is that of texts, as a context
        self.pairs, self.pair_at = np.unique(bigrams(words[self.before], words[at]), return_inverse=True)
        self.keys = np.sort(np.concatenate([words, self.pairs]))
        self.word_place, self.pair_place = np.searchsorted(self.keys, words), np.searchsorted(self.keys, self.pairs)

    def counts(self) -> np.ndarray:
        out = np.zeros(len(self.keys), np.uint64)
        out[self.word_place] = np.bincount(self.at, minlength=len(self.words))
        out[self.pair_place] = np.bincount(self.pair_at, minlength=len(self.pairs))
        return out


def chunked(docs: list[np.ndarray]) -> Chunk:
    """docs: hashes of each document's words, its end included."""
    lengths = np.array([len(d) for d in docs])
    words, at = np.unique(np.concatenate(docs), return_inverse=True)
    words = mixed(words) | np.uint64(1)
    order = np.argsort(words)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return Chunk(words[order], back[at], np.cumsum(lengths) - lengths)


def deal(documents: DataFrame, doc_id: Column, text: Column, part: Column, shards: int) -> DataFrame:
    """part: 0 for documents to count, 1 for those of the deleted part, 2 for those to score only. A row per chunk and shard (kind 0) and per chunk (kind 1)."""

    def run(batches):
        known, number = Words(), 0
        waiting: dict[int, list] = {0: [], 1: [], 2: []}
        held = dict.fromkeys(waiting, 0)

        def close(p):
            nonlocal number
            chunk = chunked([w for _, w in waiting[p]])
            name = TaskContext.get().partitionId() << 32 | number
            number += 1
            of, counts = shard_of(chunk.keys, shards), chunk.counts()
            cuts = np.searchsorted(of, np.arange(shards + 1, dtype=np.uint64))
            rows = []
            for s in range(shards):
                if cuts[s] < cuts[s + 1]:
                    here = slice(cuts[s], cuts[s + 1])
                    rows.append((s, 0, name, s, p == 1, pack_keys(chunk.keys[here]), *(planes(counts[here]) if p == q else b"" for q in (0, 1))))
            rank = np.empty(len(chunk.words), np.uint32)
            by_count = np.argsort(-np.bincount(chunk.at, minlength=len(chunk.words)), kind="stable")
            rank[by_count] = np.arange(len(by_count), dtype=np.uint32)
            about = zs.ZstdCompressor().compress(pickle.dumps(([i for i, _ in waiting[p]], chunk.starts.tolist(), by_count.astype(np.uint32))))
            rows.append((shards + name, 1, name, p, p == 1, pack_keys(chunk.words), planes(rank[chunk.at]), about))
            waiting[p].clear()
            held[p] = 0
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["target", "kind", "chunk", "shard", "deleted", "a", "b", "c"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for i, t, p in zip(some.column(0).to_pylist(), texts(some.column(1)), some.column(2).to_pylist(), strict=True):
                    words = (t or b"").lower().split()
                    hashes = np.empty(len(words) + 1, np.uint64)
                    hashes[:-1] = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                    hashes[-1] = END
                    waiting[p].append((i, hashes))
                    held[p] += len(hashes)
                    if held[p] >= CHUNK:
                        yield close(p)
        for p in waiting:
            if waiting[p]:
                yield close(p)

    return documents.select(doc_id.alias("i"), text.alias("t"), part.alias("p")).mapInArrow(run, DEALT)


def added(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of blocks (a: keys, b and c: counts kept and deleted, or none): their distinct keys, both totals, and each block's places among the keys."""
    keys = [unpack_keys(a) for a in pdf.a]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    where = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
    totals = []
    for column in (pdf.b, pdf.c):
        total = np.zeros(len(distinct), np.uint64)
        for w, counts in zip(where, column, strict=True):
            if counts:
                total[w] += values_of(counts, np.uint64)
        totals.append(total)
    return distinct, *totals, where


def answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a shard: the totals of each chunk's keys (a: documents to count, b: deleted part), and the shard's own sums (kind 2). A chunk's own row stays."""
    if pdf.kind.iloc[0] == 1:
        return pdf.drop(columns="target")
    distinct, kept, gone, where = added(pdf)
    word = (distinct & np.uint64(1)).astype(bool)
    sums = pickle.dumps((int((kept[word] > 0).sum()), int(kept[word].sum()), int((kept[word] + gone[word] > 0).sum()), int((kept[word] + gone[word]).sum())))
    rows = [(0, c, s, d, planes(kept[w]), planes(gone[w]), b"") for c, s, d, w in zip(pdf.chunk, pdf["shard"], pdf.deleted, where, strict=True)]
    rows.append((2, -1, int(pdf["shard"].iloc[0]), False, sums, b"", b""))
    return pd.DataFrame(rows, columns=["kind", "chunk", "shard", "deleted", "a", "b", "c"])


def resolve(blocks: DataFrame, ranges: int, shards: int, owners: int) -> DataFrame:
    """Answers to blocks (kind 0) of owners, cut into ranges of hashes, over shards or more in all: as answer gives them, level by level."""
    if ranges >= shards:
        return blocks.groupBy("target").applyInPandas(answer, ANSWERED)
    finer = ranges * min(FAN, -(-shards // ranges))
    groups = max(1, owners // FAN)
    blocks = blocks.withColumn("owner", F.pmod(F.xxhash64("chunk"), F.lit(groups)) * F.lit(ranges) + F.col("target"))

    def merge(pdf):
        distinct, kept, gone, _ = added(pdf)
        of = shard_of(distinct, finer).astype(np.int64)
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        owner = int(pdf.owner.iloc[0])
        cuts = zip(starts, [*starts[1:], len(of)], strict=True)
        return pd.DataFrame([(int(of[i]), 0, owner, int(of[i]), False, pack_keys(distinct[i:j]), planes(kept[i:j]), planes(gone[i:j])) for i, j in cuts], columns=["target", "kind", "chunk", "shard", "deleted", "a", "b", "c"])

    def give(asked, answered):
        """The owner's totals, in the order of its keys, to those who asked."""
        if not len(asked):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("kind", "chunk", "shard", "deleted", "a", "b", "c")})
        _, _, _, where = added(asked)
        answered = answered.sort_values("shard")
        kept, gone = (np.concatenate([values_of(x, np.uint64) for x in answered[c]]) for c in ("a", "b"))
        return pd.DataFrame([(0, c, s, d, planes(kept[w]), planes(gone[w]), b"") for c, s, d, w in zip(asked.chunk, asked["shard"], asked.deleted, where, strict=True)], columns=["kind", "chunk", "shard", "deleted", "a", "b", "c"])

    merged = materialise(blocks.groupBy("owner").applyInPandas(merge, DEALT), "merged")
    found = materialise(resolve(merged, finer, shards, groups * ranges), "level")
    back = blocks.groupBy("owner").cogroup(found.where("kind = 0").withColumnRenamed("chunk", "owner").groupBy("owner")).applyInPandas(give, ANSWERED)
    return back.unionByName(found.where("kind = 2"))


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 and the whole part of its count's binary logarithm."""
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)


def looked_up(pdf: pd.DataFrame):
    """(chunk, ids, counts kept, counts deleted) of a chunk's rows."""
    own, rest = pdf[pdf.kind == 1].iloc[0], pdf[pdf.kind == 0].sort_values("shard")
    ids, starts, by_count = pickle.loads(zs.ZstdDecompressor().decompress(own.c))
    chunk = Chunk(unpack_keys(own.a), by_count[values_of(own.b, np.uint32)].astype(np.int64), np.array(starts))
    kept, gone = (np.concatenate([values_of(x, np.uint64) for x in rest[c]]).astype(np.float64) for c in ("a", "b"))
    return chunk, ids, kept, gone


#: Cells to an octave in the table that weights are learned from.
STEPS = 8


def learn(answered: DataFrame, n: int, v: int, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights L by bucket and M, from the deleted part's tokens. Tokens are gathered in cells by bucket, ML bigram estimate and word count,
    an eighth of an octave wide; a cell stands at the means of its tokens' estimates, so what is lost is of the second order in its width. The
    table has a bounded number of rows, whatever the corpus."""

    def cells(pdf):
        chunk, _, kept, _ = looked_up(pdf)
        context, word, pair = kept[chunk.word_place][chunk.before], kept[chunk.word_place][chunk.at], kept[chunk.pair_place][chunk.pair_at]
        pair = pair / np.maximum(context, 1)
        step = lambda x: np.where(x > 0, np.floor(STEPS * np.log2(np.maximum(x, 1e-300))), -9_999).astype(np.int64)
        found = pd.DataFrame({"bucket": bucket(context), "p": step(pair), "w": step(word), "n": 1, "pair": pair, "word": word})
        return found.groupby(["bucket", "p", "w"], as_index=False).sum()

    table = answered.where("kind < 2 and deleted").groupBy("chunk").applyInPandas(cells, "bucket long, p long, w long, n long, pair double, word double")
    table = table.groupBy("bucket", "p", "w").agg(F.sum("n").alias("n"), F.sum("pair").alias("pair"), F.sum("word").alias("word")).toPandas()
    weights, m = np.full(80, 0.5), 0.9
    weights[0] = 0
    if len(table) and n:
        b, times = table.bucket.to_numpy(), table.n.to_numpy(float)
        pair, word = table.pair.to_numpy() / times, table.word.to_numpy() / times / n
        for _ in range(rounds):
            first, second, third = weights[b] * pair, (1 - weights[b]) * m * word, (1 - weights[b]) * (1 - m) / (v + 1)
            every = first + second + third
            use = np.bincount(b, times, 80)
            weights = np.where(use > 0, (np.bincount(b, times * first / every, 80) + 0.01) / (use + 0.02), weights)
            weights[0] = 0
            m = float(min(0.999999, max(1e-6, (times * second / every).sum() / max(1e-9, (times * (second + third) / every).sum()))))
    return weights, m


def summed(answered: DataFrame) -> list[int]:
    """Of all shards: distinct words and tokens kept, distinct words and tokens in all."""

    def add(frames):
        total = np.zeros(4, np.int64)
        for pdf in frames:
            for a in pdf.a:
                total += np.array(pickle.loads(a))
        yield pd.DataFrame([total.tolist()], columns=list("abcd"))

    found = answered.where("kind = 2").select("a").mapInPandas(add, "a long, b long, c long, d long").agg(*(F.sum(c) for c in "abcd")).first()
    return [x or 0 for x in found]


def score_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per row of documents, scores of whole texts in log10.

    Counts come from all documents whose crc32 of doc_id (null: the empty text) mod 5 is not 1; of these, remainder 4 is the deleted
    part. A null text is empty: one token, its end. Without training documents, every estimate is uniform. Empty table: no rows.
    A chunk holds whole documents, so the longest text bounds a task's memory.
    """
    size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(12, -(-size // SHARD_BYTES))
    remainder = fold(F.col(doc_id), 5)
    part = F.when(remainder == 1, 2).when(remainder == 4, 1).otherwise(0).cast("int")
    dealt = deal(documents, F.col(doc_id), F.col(text), part, min(shards, FAN))
    if shards <= FAN:
        answered = materialise(dealt.groupBy("target").applyInPandas(answer, ANSWERED), "counts")
    else:
        dealt = materialise(dealt, "dealt")
        answered = materialise(resolve(dealt.where("kind = 0"), FAN, shards, -(-size // (6 * CHUNK))), "counts").unionByName(dealt.where("kind = 1").drop("target"))
    v_kept, n_kept, v, n = summed(answered)
    weights, m = learn(answered, n_kept, v_kept)

    def scored(pdf):
        chunk, ids, kept, gone = looked_up(pdf)
        total = kept + gone
        per_word, per_pair = total[chunk.word_place], total[chunk.pair_place]
        context, word = per_word[chunk.before], per_word[chunk.at]
        weight = weights[bucket(context)]
        p = weight * per_pair[chunk.pair_at] / np.maximum(context, 1) + (1 - weight) * (m * word / max(1, n) + (1 - m if n else 1) / (v + 1))
        base = np.log10((word + 0.5) / (n + 0.5 * (v + 1)))
        sum_of = lambda x: np.add.reduceat(x, chunk.starts)
        return pd.DataFrame({"doc_id": pd.Series(ids, dtype=object), "n_tokens": sum_of(np.ones(len(p), np.int64)), "n_known": sum_of((word > 0).astype(np.int64)), "base_score": sum_of(base), "score": sum_of(np.log10(p))})

    out = answered.where("kind < 2").groupBy("chunk").applyInPandas(scored, f"doc_id {documents.schema[doc_id].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
