"""Whole-text encoding with the `tokenizers` library, each distinct pre-tokenisation match encoded once per worker.

For byte-level BPE files without a normaliser the library encodes every match on its own, so matches can be
kept in a Memo. Any other file, and any text that holds a special string of the file, goes to the library whole.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np

from . import frames
from .pretoken import Memo


def encoder(path: str) -> LibraryEncoder:
    """The encoder of a file, kept by the worker for its next task."""
    return frames.remembered("library", path, lambda: LibraryEncoder(path))


def file_digest(path: str) -> str:
    """The tokenizer's version: the SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class LibraryEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, "rb") as f:
            said = json.load(f)
        self.special = [x["content"] for x in said.get("added_tokens") or []]
        pre, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
        self.by_match = (
            said.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        )
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        if self.by_match:
            newline = self._whole(["\n"])[0]
            self.by_match = len(newline) == 1
            self.newline = int(newline[0]) if self.by_match else -1
        self.memo = Memo(self._matches)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _matches(self, matches: list[str]) -> list[np.ndarray]:
        """Matches that hold more than white space go to the library a thousand at a time, a line each: a line feed ends a match and is one id."""
        lines = [i for i, m in enumerate(matches) if not m.isspace() and "\n" not in m]
        rest = [i for i, m in enumerate(matches) if m.isspace() or "\n" in m]
        out: list = [None] * len(matches)
        for i, ids in zip(rest, self._whole([matches[i] for i in rest]), strict=True):
            out[i] = ids
        for at in range(0, len(lines), 1000):
            own = lines[at : at + 1000]
            ids = self._whole(["\n".join(matches[i] for i in own)])[0]
            ends = np.flatnonzero(ids == self.newline)
            if len(ends) != len(own) - 1:
                parts = self._whole([matches[i] for i in own])
            else:
                parts = [ids[a:b] for a, b in zip(np.append(0, ends + 1).tolist(), np.append(ends, len(ids)).tolist(), strict=True)]
            for i, x in zip(own, parts, strict=True):
                out[i] = x
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        special = [i for i, t in enumerate(texts) if not self.by_match or any(s in t for s in self.special)]
        if not special:
            return self.memo.encode_texts(texts)
        gone = set(special)
        whole = dict(zip(special, self._whole([texts[i] for i in special]), strict=True))
        ids, counts = self.memo.encode_texts(["" if i in gone else t for i, t in enumerate(texts)])
        parts = np.split(ids, np.cumsum(counts)[:-1])
        parts = [whole.get(i, x) for i, x in enumerate(parts)]
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def count(self, texts: list[str]) -> np.ndarray:
        special = [i for i, t in enumerate(texts) if not self.by_match or any(s in t for s in self.special)]
        gone = set(special)
        out = self.memo.count_texts(["" if i in gone else t for i, t in enumerate(texts)])
        if special:
            out[special] = [len(x) for x in self._whole([texts[i] for i in special])]
        return out
