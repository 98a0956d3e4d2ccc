"""Plain-Python forms of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np


def union_find(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def repeats(docs, length=200):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)} of [(doc_id, text)]."""
    starts = Counter()
    data = [(i, (t or "").encode()) for i, t in docs]
    for _, b in data:
        starts.update(hash(b[p:p + length]) for p in range(len(b) - length + 1))
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if starts[hash(b[p:p + length])] > 1:
                gone[p:p + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, k=5):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))}


def jaccard(docs, k=5, percent=80):
    """{doc_id: (n_shingles, component)}."""
    sets = {i: shingles(t, k) for i, t in docs}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    both = Counter()
    for ids in where.values():
        for a in range(len(ids)):
            for b in range(a):
                both[ids[a], ids[b]] += 1
    pairs = [p for p, n in both.items() if 100 * n >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    comp = union_find(list(sets), pairs)
    return {i: (len(sets[i]), comp[i]) for i in sets}


def secrets_base(text):
    text = text or ""
    out = [(m.start(), m.end(), "assign") for m in re.finditer(
        r"""(?ia:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    out.sort(key=lambda x: (x[0], ("assign", "access", "hex").index(x[2])))
    count = Counter(k for _, _, k in out)
    return count["assign"], count["access"], count["hex"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in out).encode()).hexdigest()


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def leaks(docs, items, window=20, percent=80):
    """{(doc_id, item_id): matched} of verified overlaps, on every diagonal."""
    index = defaultdict(list)
    words = {i: plain_words(t) for i, t in items}
    for i, w in words.items():
        for q, x in enumerate(w):
            index[x].append((i, q))
    out = {}
    for d, t in docs:
        w = plain_words(t)
        diagonals = Counter((i, p - q) for p, x in enumerate(w) for i, q in index.get(x, ()))
        for (i, g), equal in diagonals.items():
            size = min(window, len(words[i]))
            if equal * 100 < size * percent:
                continue
            same = [w[q + g] == x for q, x in enumerate(words[i]) if 0 <= q + g < len(w)]
            best = max((sum(same[s:s + size]) for s in range(len(same) - size + 1)), default=0)
            if best and best * 100 >= size * percent:
                out[d, i] = max(best, out.get((d, i), 0))
    return out


def near(vectors, cosine=0.95):
    """{vec_id: (n_links, component)} of [(vec_id, vector)]."""
    good = [(i, np.asarray(v, float)) for i, v in vectors
            if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, pairs = Counter(), []
    for a in range(len(good)):
        for b in range(a):
            (i, x), (j, y) = good[a], good[b]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    comp = union_find([i for i, _ in vectors], pairs)
    return {i: (links[i], comp[i]) for i, _ in vectors}
