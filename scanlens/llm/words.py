"""Words of many texts at once, found in their UTF-8 bytes.

Both kinds of words are runs of bytes of a class; bytes from 0x80 on always belong to words, so runs of bytes
are runs of characters. A word is known by a 64-bit hash of its lower-cased (A-Z) bytes.
"""

from __future__ import annotations

import numpy as np

from .pretoken import mix, run_hashes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: [^\x20\x09-\x0D]
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def spans(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and the number of words before each text (one more than texts)."""
    if not len(data):
        empty = np.empty(0, np.int64)
        return empty, empty, np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = word_bytes[data]
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    some = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][some], offsets[1:][some] - 1
    head[heads] = inside[heads]
    tail[tails] = inside[tails]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    lengths = ends - starts
    hashes = run_hashes(LOWER[data[inside]], np.cumsum(lengths) - lengths, lengths)
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every run of `size` words of a text, the whole text where it has fewer (but some) words; and the number before each text."""
    counts = np.diff(firsts)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    before = np.concatenate([[0], np.cumsum(n)])
    total = int(before[-1])
    if not total:
        return np.empty(0, np.uint64), before
    at = np.arange(total) + np.repeat(firsts[:-1] - before[:-1], n)
    left = np.repeat(firsts[1:], n) - at
    out = np.zeros(total, np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(size):
            factor = np.uint64((int(factor) * 0x8CB92BA72F3D8DD7 + 0x5851F42D4C957F2D) & (2**64 - 1) | 1)
            there = left > k
            if there.all():
                out += hashes[at + k] * factor
            else:
                out[there] += hashes[at[there] + k] * factor
    return mix(out), before
