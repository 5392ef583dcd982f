"""Plain single-machine versions of the contracts, to hold the queries against."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def licences(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hits = []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def top_k(rows, k=5):
    vecs = [(i, np.floor(256 * np.array(v, dtype=np.float64))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, qv in vecs:
        if q % 50 == 0:
            scored = sorted((-int(qv @ v), i) for i, v in vecs if i != q and len(v) == len(qv))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def targets(source_sizes):
    order = sorted((s for s in source_sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in source_sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(source_sizes.values()), set()
    while True:
        left = total - sum(3 * source_sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * source_sizes[s]}
        if not over:
            return {s: 3.0 * source_sizes[s] if s in capped else share[s] for s in order}
        capped |= over


def rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, rep = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    n = max(1, len(words) - 2)
    bits = [0] * 64
    for i in range(n):
        h = xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > n)


def components(ids_fps, bits=2):
    """id -> smallest id reachable, by comparing all distinct fingerprints."""
    fps = sorted({f for _, f in ids_fps})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    arr = np.array(fps, dtype=np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= bits):
            root[find(fps[i + 1 + j])] = find(f)
    least = defaultdict(list)
    for i, f in ids_fps:
        if i is not None:
            least[find(f)].append(i)
    return {f: min(least[find(f)], default=None) for f in fps}


MASK = re.compile(r"[0-9]")


def line_templates(docs, depth=4, min_tokens=8):
    """docs: (id, text) -> texts with recurring lines dropped, over the templates as tuples."""
    seen, keys = defaultdict(set), {}
    for i, (d, text) in enumerate(docs):
        for pos, line in enumerate((text or "").split("\n")):
            raw = WORD.findall(line)
            if len(raw) < min_tokens:
                continue
            t = ["<*>" if MASK.search(x) else x for x in raw]
            if 2 * t.count("<*>") > len(t):
                t = raw
            rest = len(t) - depth
            cut = [depth + rest * q // 4 for q in range(5)]
            parts = [tuple(t[cut[q] : cut[q + 1]]) for q in range(4)]
            keys[i, pos] = [(len(t), tuple(t[:depth]), q, *(parts[j] for j in range(4) if j != q)) for q in range(4)]
            for k in keys[i, pos]:
                if d is not None:
                    seen[k].add(d)
    out = []
    for i, (d, text) in enumerate(docs):
        if text is None:
            out.append((d, 0, 0, None))
            continue
        lines = text.split("\n")
        kept = [x for pos, x in enumerate(lines) if not any(len(seen[k]) > 1 and min(seen[k]) != d for k in keys.get((i, pos), []))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
