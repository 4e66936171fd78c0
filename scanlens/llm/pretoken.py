"""The pre-tokenisation that byte-level BPE vocabularies share, computed for many texts at once.

`public_tokenizers.PATTERN` cuts a text into matches. Merges never cross a match, so a match always
gets the same ids, and each distinct one need be encoded once only. `cut` finds all matches of a piece
of texts with array operations; `Memo` keeps the ids of matches met before (a bounded number of them).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import regex

from .frames import ragged

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Unicode's White_Space property (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Matches that a Memo holds before it starts anew.
MEMO_ENTRIES = 600_000


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            skip = lambda i: i + (0x800 if i >= 0xD800 else 0)  # noqa: E731  surrogates are left out of `every`
            out[skip(m.start()) : skip(m.end() - 1) + 1] = kind
    out[WHITE_SPACE] = SPACE
    return out


def cut(codes: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where the matches of texts start. codes: the code points of all texts; doc_starts: where each text starts.

    Runs of letters, numbers or other signs are matches; a run takes in one blank before it; white space
    before that is a match of its own; 's 't 're 've 'm 'll 'd are matches where the apostrophe starts one.
    """
    n = len(codes)
    if n == 0:
        return np.empty(0, np.int64)
    kind = classes()[codes]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    first[n] = True
    cut_at = first.copy()
    cut_at[1:n] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(cut_at[:n])
    ends = np.append(runs[1:], n)
    blank = (kind[runs] == SPACE) & ~first[ends]
    after = ends[blank]
    cut_at[after - 1] = True
    cut_at[after[codes[after - 1] == 0x20]] = False
    quote = (ends - runs == 1) & (codes[runs] == 0x27) & cut_at[runs] & ~first[ends]
    at = ends[quote]
    if len(at):
        c1 = codes[at]
        second = np.minimum(at + 1, n - 1)
        c2 = np.where(first[np.minimum(at + 1, n)], 0, codes[second])
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
        cut_at[at[one | two]] = False
        cut_at[at[one] + 1] = True
        cut_at[at[two] + 2] = True
    return np.flatnonzero(cut_at[:n])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-and-shift rounds)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@functools.lru_cache(4)
def powers(n: int) -> np.ndarray:
    """The first n powers of a 64-bit odd number."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, 0xA0761D6478BD642F, np.uint64)]))


def run_hashes(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of `values`; runs follow each other without gaps, none is empty."""
    if not len(starts):
        return np.empty(0, np.uint64)
    table = powers(1 << max(6, int(lengths.max() - 1).bit_length()))
    at = np.arange(len(values), dtype=np.int64) - np.repeat(starts, lengths)
    terms = (values.astype(np.uint64) + np.uint64(0x1D8E4E27C47D124F)) * table[at]
    return mix(np.add.reduceat(terms, starts) + lengths.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))


class Memo:
    """The ids of matches. encode: list of distinct matches to their ids, one array each."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], entries: int = MEMO_ENTRIES):
        self.encode, self.entries = encode, entries
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.ids, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, hashes: list[int], matches: list[str]) -> None:
        got = self.encode(matches)
        base = len(self.index)
        self.index.update(zip(hashes, range(base, base + len(hashes)), strict=True))
        self.ids = np.concatenate([self.ids, *got])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(x) for x in got], dtype=np.int64)])

    def slots(self, text: str, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The memo's entry of each match."""
        lengths = np.diff(np.append(starts, len(codes)))
        hashes = run_hashes(codes, starts, lengths)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.index) + len(distinct) > self.entries:
            self.clear()
        keys = distinct.tolist()
        get = self.index.get
        new = [i for i, h in enumerate(keys) if get(h) is None]
        if new:
            s = starts[where[new]]
            e = s + lengths[where[new]]
            self._learn([keys[i] for i in new], [text[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)])
            get = self.index.get
        return np.array([get(h) for h in keys], np.int64)[inverse] if keys else np.empty(0, np.int64)

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of each text's."""
        slots, owner = self.matches(texts)
        n = self.starts[slots + 1] - self.starts[slots]
        ids = self.ids[ragged(self.starts[slots], n)]
        return ids, np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64)

    def count_texts(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        slots, owner = self.matches(texts)
        return np.bincount(owner, weights=self.starts[slots + 1] - self.starts[slots], minlength=len(texts)).astype(np.int64)

    def matches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "".join(texts)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        starts = cut(codes, (ends - lengths)[lengths > 0])
        return self.slots(text, codes, starts), np.searchsorted(ends, starts, side="right")
