"""Array kernels over whole Arrow batches of texts: words, rolling hashes, sliding minima.

A word is a run of bytes outside ``00-2F 3A-60 7B-7F`` after A-Z are lower-cased: ASCII letters
and digits and every byte of a non-ASCII character. Working on the UTF-8 bytes of many texts at
once keeps the cost at a few nanoseconds a byte, and long texts need no special case.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[0:0x30] = False
IS_WORD[0x3A:0x61] = False
IS_WORD[0x7B:0x80] = False

_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.ones(size, dtype=U64)
        k = 1
        step = base
        while k < size:  # doubling: the second half is the first times base^k
            have[k : 2 * k] = have[:k] * U64(step)
            step = step * step % (1 << 64)
            k *= 2
        if size <= 1 << 22:
            _tables[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser (splitmix64) that spreads the entropy of sums over all bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n+1 offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive runs of whole texts of about ``limit`` bytes (one long text may exceed it):
    first and last row, bytes, offsets."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def prefix_sums(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """P with P[j]-P[i] = sum of (byte+1)*base^k over i <= k < j."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(base, len(data)), out=out[1:])
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word of the texts, and for each text the index of its first word
    (n+1 entries)."""
    is_word = IS_WORD[LOWER[data]]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = is_word
    cut = offsets[:-1][offsets[:-1] < len(data)]
    before[cut] = False  # no word runs on from the text before
    starts = np.flatnonzero(is_word & ~before[:-1])
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = is_word
    after[offsets[1:]] = False
    ends = np.flatnonzero(is_word & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each lower-cased word, with starts, ends and first words as in words()."""
    starts, ends, first = words(data, offsets)
    sums = prefix_sums(LOWER[data])
    inverse = powers(BASE_INV, len(data) + 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts]), starts, ends, first


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words within a text, and the text of each. A text of fewer than k
    words but at least one has the run of all its words."""
    n = len(hashes)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    acc = np.zeros(n, dtype=U64)
    m = 1
    for j in range(k):
        part = np.zeros(n, dtype=U64)
        if n > j:
            part[: n - j] = hashes[j:]
        # words beyond the text's end count as absent
        acc += np.where(np.arange(n) + j < first[1:][text], part * U64(m), U64(0))
        m = m * BASE % (1 << 64)
    within = np.arange(n) - first[:-1][text]
    keep = (within + k <= counts[text]) | (within == 0)
    return mix(acc[keep]), text[keep]


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values; len(h)-w+1 results. Doubling, so log(w) passes."""
    out, size = h, 1
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return out if size == w else np.minimum(out[: len(h) - w + 1], out[w - size :])
