"""What the queries must return, by the plainest means."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "").encode()


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[root(a)] = root(b)
    return {n: root(n) for n in nodes}


def named(rows, groups):
    """For rows (id, node): the least id that is not null of each row's group."""
    least = {}
    for i, node in rows:
        g = groups[node]
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [least.get(groups[node]) for _, node in rows]


def fingerprint(text):
    words = WORDS.findall(ascii_lower(text))
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs):
    rows = [(i, fingerprint(t)) for i, t in docs]
    fps = sorted({f for _, f in rows})
    groups = components(fps, [(a, b) for k, a in enumerate(fps) for b in fps[:k] if (a ^ b).bit_count() <= 2])
    return [(i, f"{f:016x}", c) for (i, f), c in zip(rows, named(rows, groups))]


def lines(docs):
    split = [(i, (t or "").split("\n")) for i, t in docs]
    key = lambda line: ascii_lower(line.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for _, ls in split for k in {key(x) for x in ls} if k)
    out = []
    for i, ls in split:
        kept = [x for x in ls if not key(x) or seen[key(x)] < 10]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def leaks(docs, items):
    pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = pattern.findall(ascii_lower(text))
        for i in range(max(1, len(w) - 7)):
            if w:
                windows[tuple(w[i : i + 8])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w = pattern.findall(ascii_lower(t))
        hit, found = set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[at : at + n]))) is not None:
                    hit.update(range(at, at + n))
                    found |= got
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out


def language_model(docs):
    split = [(i, [*WORDS.findall(ascii_lower(t)), None]) for i, t in docs]
    counts = Counter(w for i, ws in split if crc(i) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(i, crc(i) % 5 == 1, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in split]


def cosine(rows, threshold=0.98):
    good = []
    for at, (_, v, label) in enumerate(rows):
        if label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v, float)
            good.append((at, label, a / np.linalg.norm(a)))
    links = [(p, q) for k, (p, lp, a) in enumerate(good) for q, lq, b in good[:k] if lp == lq and len(a) == len(b) and a @ b >= threshold]
    degree = Counter(x for pair in links for x in pair)
    groups = components(range(len(rows)), links)
    names = named([(r[0], at) for at, r in enumerate(rows)], groups)
    return [(r[0], degree[at], c, r[0] is not None and r[0] == c) for at, (r, c) in enumerate(zip(rows, names))]


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    left, room = share * sum(n for _, n in order), {s: most * n for s, n in order}
    found, open_ = {}, [s for s, _ in order]
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > room[s]]
        if not full:
            return found | {s: unit * weight[s] for s in open_}
        found |= {s: room[s] for s in full}
        left -= sum(room[s] for s in full)
        open_ = [s for s in open_ if s not in found]
    return found


def interpolated(docs, rounds=40):
    """Scores of deleted interpolation, the weights learned over the deleted part's tokens one by one."""
    split = [(i, crc(i) % 5, [*WORDS.findall(ascii_lower(t)), None]) for i, t in docs]
    word, pair = ([Counter(), Counter()] for _ in range(2))  # kept, and all
    for _, part, ws in split:
        for k in (0, 1) if part not in (1, 4) else (1,) if part == 4 else ():
            word[k].update(ws)
            pair[k].update(zip([None, *ws], ws))
    bucket = lambda c: 1 + c.bit_length() - 1 if c else 0
    n, v = sum(word[0].values()), len(word[0])
    tokens = [(bucket(word[0][h]), pair[0][h, w] / max(1, word[0][h]), word[0][w] / max(1, n)) for _, part, ws in split if part == 4 for h, w in zip([None, *ws], ws)]
    weights, m = np.full(80, 0.5), 0.9
    weights[0] = 0
    if tokens and n:
        b, p, u = (np.array(x) for x in zip(*tokens))
        for _ in range(rounds):
            first, second, third = weights[b] * p, (1 - weights[b]) * m * u, (1 - weights[b]) * (1 - m) / (v + 1)
            every, use = first + second + third, np.bincount(b, minlength=80)
            weights = np.where(use > 0, (np.bincount(b, first / every, 80) + 0.01) / (use + 0.02), weights)
            weights[0] = 0
            m = float(min(0.999999, max(1e-6, (second / every).sum() / max(1e-9, ((second + third) / every).sum()))))
    n, v, out = sum(word[1].values()), len(word[1]), []
    for i, _, ws in split:
        total = 0.0
        for h, w in zip([None, *ws], ws):
            x = weights[bucket(word[1][h])]
            total += math.log10(x * pair[1][h, w] / max(1, word[1][h]) + (1 - x) * (m * word[1][w] / max(1, n) + (1 - m if n else 1) / (v + 1)))
        out.append((i, total))
    return out
