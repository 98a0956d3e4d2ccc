"""Vectorised 64-bit hashing of text inside Arrow batches (numpy only).

Texts are read straight from the Arrow string buffers as UTF-8 bytes, in
slices of bounded size, so no per-row Python strings are made.  All
arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORD_MULT = _RNG.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
LENGTH_SEED = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (full avalanche)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(col: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets into them) of a string
    column; a slice holds whole texts, at most ``max_bytes`` unless one text
    alone is longer.  Null texts are empty."""
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if not n:
        return
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def word_hashes(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) and, per
    row, the index of its first word (length rows + 1)."""
    rows = len(off) - 1
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    upper = (b >= 65) & (b <= 90)
    b = b + upper.astype(np.uint8) * np.uint8(32)
    word = ~((b == 32) | ((b >= 9) & (b <= 13)))
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = off[:-1][off[:-1] < len(b)]
    first[edge] |= word[edge]
    at = np.flatnonzero(word)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    start_in = np.flatnonzero(first[at])
    lens = np.diff(np.append(start_in, len(at)))
    place = np.arange(len(at)) - np.repeat(start_in, lens)
    power = np.cumprod(np.full(int(lens.max()), BASE, np.uint64))
    h = mix(np.add.reduceat(BYTE_TABLE[b[at]] * power[place], start_in) + lens.astype(np.uint64) * LENGTH_SEED)
    return h, np.searchsorted(at[start_in], off, "left").astype(np.int64)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles of one row (not distinct); the whole
    sequence as one shingle when it has fewer words; none without words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    m = min(n, k)
    acc = np.full(n - m + 1, m * int(LENGTH_SEED) % 2**64, np.uint64)
    for j in range(m):
        acc += words[j:n - m + 1 + j] * np.uint64(int(WORD_MULT[j % 8]) * (2 * (j // 8) + 1) % 2**64)
    return mix(acc)


def set_keys(u: np.ndarray) -> tuple[int, int]:
    """Two 64-bit keys of a set of hashes (order-free)."""
    a = mix(u ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    b = mix(u ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))
