"""Operator 8: language identification by a linear-chain conditional random field over words.

Words are runs of letters, lower-cased; a line of a text is a chain. A word's features are its affixes, its
character n-grams, itself (all hashed) and whether a language's lexicon holds it; transitions between the
languages of neighbouring words are learned. Forward-backward gives every word a posterior over languages, so
code-switched text is labelled word by word; a document gets the language with the largest mean posterior.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import frames
from .frames import column, pieces
from .pretoken import LETTER, classes, mix, run_hashes

#: Labelled rows of each language that a model is fitted on (about; picked by a hash of id and text, whole texts), and words that a worker remembers.
SAMPLE_ROWS, MEMO_WORDS = 80, 500_000
#: Bytes of text that are labelled at once (some 100 bytes of memory each); a longer text is a piece of its own.
LABEL_BYTES = 1 << 20
FEATURES = 1 << 17
UNKNOWN = "und"


@functools.cache
def lower_codes() -> np.ndarray:
    """The lower-case code point of every letter (its own where lower-casing gives more than one)."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(classes() == LETTER).tolist():
        if len(low := chr(c).lower()) == 1:
            out[c] = ord(low)
    return out


def letter_words(codes: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters; none goes over the start of a text."""
    inside = classes()[codes] == LETTER
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    head[doc_starts] = inside[doc_starts]
    before = doc_starts[doc_starts > 0] - 1
    tail[before] = inside[before]
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


def features(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word, feature) of words that follow each other in codes (lower-cased)."""
    n = len(starts)
    size = lengths + 2
    at = np.cumsum(size) - size
    marked = np.full(int(size.sum()), 1, np.uint64)  # a mark before and after each word
    marked[np.arange(len(codes)) + 2 * np.repeat(np.arange(n), lengths) + 1] = codes
    marked[at + size - 1] = 2
    word = np.repeat(np.arange(n), size)
    left = np.repeat(at + size, size) - np.arange(len(marked))
    words, hashes = [], []
    h = np.zeros(len(marked), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(4):  # n-grams of 1 to 4 signs, with the marks
            h = h * np.uint64(0x100000001B3) + np.concatenate([marked[k:], np.zeros(k, np.uint64)]) + np.uint64(k + 1)
            ok = left > k
            words.append(word[ok])
            hashes.append(mix(h[ok]))
            if k >= 2:  # prefixes and suffixes, with the mark
                for place, salt in ((at, 0x51ED27), (at + size - 1 - k, 0xA3C59B)):
                    fits = size > k
                    words.append(np.flatnonzero(fits))
                    hashes.append(mix(h[place[fits]] ^ np.uint64(salt)))
        whole = run_hashes(codes, np.cumsum(lengths) - lengths, lengths)
    words.append(np.arange(n))
    hashes.append(mix(whole ^ np.uint64(0x77)))
    known, label = lexicon
    if len(known):
        i = np.minimum(np.searchsorted(known, whole), len(known) - 1)
        hit = known[i] == whole
        return np.concatenate([*words, np.flatnonzero(hit)]), np.concatenate([*((x % np.uint64(FEATURES)).astype(np.int64) for x in hashes), FEATURES + label[i[hit]]])
    return np.concatenate(words), np.concatenate([(x % np.uint64(FEATURES)).astype(np.int64) for x in hashes])


def forward_backward(emit: np.ndarray, move: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward and backward messages of all chains, step by step for all chains at once. emit, move: potentials (not logarithms)."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0)) + 1), side="left")  # chains longer than t
    forward, backward = np.empty_like(emit), np.ones_like(emit)
    now = None
    for t in range(len(active) - 1):
        at = starts[: active[t]] + t
        now = emit[at] if t == 0 else (now[: active[t]] @ move) * emit[at]
        now /= now.sum(axis=1, keepdims=True)
        forward[at] = now
    for t in range(len(active) - 3, -1, -1):
        at = starts[: active[t + 1]] + t
        now = (emit[at + 1] * backward[at + 1]) @ move.T
        backward[at] = now / now.sum(axis=1, keepdims=True)
    return forward, backward


def potentials(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -60.0))


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    lexicon: tuple[np.ndarray, np.ndarray]

    def scores(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The emission scores of words that follow each other in codes."""
        word, feature = features(codes, starts, lengths, self.lexicon)
        return np.stack([np.bincount(word, self.weights[feature, k], len(starts)) for k in range(len(self.labels))], axis=1)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters of all words one after the other, their lengths, the text of each word, its line (numbered through), and the number of texts' letters."""
    text = "\n".join(texts)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(n + 1) - n - 1
    starts, ends = letter_words(codes, np.empty(0, np.int64)) if len(codes) else (np.empty(0, np.int64),) * 2
    letters = lower_codes()[codes[classes()[codes] == LETTER]]
    line = np.searchsorted(np.flatnonzero(codes == 10), starts)
    return letters, ends - starts, np.searchsorted(first, starts, "right") - 1, line, starts


def train(texts: list[str], languages: list[str], *, rounds: int = 40, rate: float = 0.5, seed: int = 7) -> Model:
    """Fit a model to labelled texts. Every word bears its text's label; texts are cut into short stretches that are put together anew, so that chains change their language and transitions can be learned."""
    labels = sorted(set(languages))
    rng = np.random.default_rng(seed)
    letters, lengths, doc, _, _ = words_of(texts)
    none = (np.empty(0, np.uint64), np.empty(0, np.int64))
    if not len(lengths):
        return Model([], np.zeros((FEATURES, 0)), np.zeros((0, 0)), none)
    y = np.array([labels.index(x) for x in languages])[doc]
    first = np.cumsum(lengths) - lengths
    hashes = run_hashes(letters, first, lengths)
    distinct, where, word = np.unique(hashes, return_index=True, return_inverse=True)
    seen = np.zeros((len(distinct), len(labels)))
    np.add.at(seen, (word, y), 1)
    sure = (seen.sum(axis=1) >= 3) & (seen.max(axis=1) >= 0.9 * seen.sum(axis=1))
    lexicon = (distinct[sure], seen.argmax(axis=1)[sure])
    cuts = np.flatnonzero((rng.random(len(word)) < 1 / 8) | (np.append(True, doc[1:] != doc[:-1])))
    stretch = np.diff(np.append(cuts, len(word)))
    order = rng.permutation(len(cuts))
    tokens = frames.ragged(cuts[order], stretch[order])
    word, y = word[tokens], y[tokens]
    used, word = np.unique(word, return_inverse=True)
    where = where[used]
    own = letters[frames.ragged(first[where], lengths[where])]
    n_words, k = len(where), len(labels)
    pair_word, pair_feature = features(own, np.cumsum(lengths[where]) - lengths[where], lengths[where], lexicon)
    starts = np.arange(0, len(word), 32)
    sizes = np.minimum(32, len(word) - starts)
    inner = np.ones(len(word), bool)
    inner[starts] = False
    after = np.flatnonzero(inner)
    weights, moves = np.zeros((FEATURES + k, k)), np.zeros((k, k))
    sum_w, sum_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    truth = np.eye(k)[y]
    true_moves = truth[after - 1].T @ truth[after]
    for _ in range(rounds):
        scores = np.stack([np.bincount(pair_word, weights[pair_feature, j], n_words) for j in range(k)], axis=1)
        emit, move = potentials(scores[word]), np.exp(moves)
        a, b = forward_backward(emit, move, starts, sizes)
        posterior = a * b
        posterior /= posterior.sum(axis=1, keepdims=True)
        out = emit[after] * b[after]
        weight = 1 / np.einsum("ni,ij,nj->n", a[after - 1], move, out)
        expected = move * np.einsum("ni,nj->ij", a[after - 1] * weight[:, None], out)
        wrong = truth - posterior
        by_word = np.stack([np.bincount(word, wrong[:, j], n_words) for j in range(k)], axis=1)
        g = np.stack([np.bincount(pair_feature, by_word[pair_word, j], FEATURES + k) for j in range(k)], axis=1) / len(word) - 1e-6 * weights
        h = (true_moves - expected) / len(word) - 1e-6 * moves
        sum_w += g * g
        sum_m += h * h
        weights += rate * 0.3 * g / np.sqrt(sum_w)
        moves += rate * h / np.sqrt(sum_m)
    return Model(labels, weights.astype(np.float32), moves, lexicon)


class Labeller:
    """A model with the emission scores of the words met before (a bounded number of them)."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.hashes = np.empty(0, np.uint64)  # sorted; known has their scores
        self.known = np.empty((0, len(self.model.labels)))

    def label(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The posterior of every word, its text, and its start and length in the joined texts."""
        letters, lengths, doc, line, starts = words_of(texts)
        k = len(self.model.labels)
        if not len(lengths) or not k:
            return np.empty((0, k)), doc[:0], starts[:0], lengths[:0]
        first = np.cumsum(lengths) - lengths
        distinct, where, word = np.unique(run_hashes(letters, first, lengths), return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > MEMO_WORDS:
            self.clear()
        place = np.searchsorted(self.hashes, distinct)
        inside = place < len(self.hashes)
        fresh = np.ones(len(distinct), bool)
        fresh[inside] = self.hashes[place[inside]] != distinct[inside]
        if fresh.any():
            at = where[fresh]
            n = lengths[at]
            scores = self.model.scores(letters[frames.ragged(first[at], n)], np.cumsum(n) - n, n)
            self.known = np.insert(self.known, place[fresh], scores, axis=0)
            self.hashes = np.insert(self.hashes, place[fresh], distinct[fresh])
        scores = self.known[np.searchsorted(self.hashes, distinct)]
        chain = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        a, b = forward_backward(potentials(scores)[word], np.exp(self.model.moves), chain, np.diff(np.append(chain, len(word))))
        posterior = a * b
        return posterior / posterior.sum(axis=1, keepdims=True), doc, starts, lengths


def labeller(sent) -> Labeller:
    """The labeller of a broadcast model, kept by the worker for its next task."""
    model, name = sent.value
    return frames.remembered("langid", name, lambda: Labeller(model))


def threshold(count: int, wanted: int) -> int:
    """The signed 64-bit hash up to which (itself included) rows are in a sample of about `wanted` of `count` rows."""
    return (1 << 63) - 1 if wanted >= count else -(1 << 63) + wanted * (1 << 64) // count


def fit(docs: DataFrame, labelled: Column, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit a model to about sample_rows rows of each language, of those for which `labelled` holds and text and lang aren't null.

    Which rows, a hash of id and text says, so that neither partitions nor the order of rows matter; equal texts
    of a language count once. Rows for each language that the labels have, with whole texts, are what comes to
    the driver. Without any such row the model has no labels.
    """
    rows = docs.where(labelled).select(frames.named(id_col).cast("string").alias("id"), frames.named(text).cast("string").alias("text"), frames.named(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return train([], [])
    edges = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, threshold(r.n, sample_rows))])
    drawn = rows.where(F.xxhash64(F.lit("sample"), "id", "text") <= F.element_at(edges, F.col("lang")))
    got = drawn.groupBy("lang", "text").agg(F.count(F.lit(1)).alias("n")).select("text", "lang").collect()
    got.sort(key=lambda r: (r.text, r.lang))
    return train([r.text for r in got], [r.lang for r in got])


def detect(docs: DataFrame, model: Model, *, text: str = "text", with_words: bool = False) -> DataFrame:
    """docs with lang_pred and score, and, with_words, the label of each word.

    lang_pred is the language of the largest mean posterior over all words of the whole text (ties: the first
    by name), score that mean. Null texts, texts without a letter, and models without labels give 'und' and 0.
    Other columns, repeated rows and extra columns stay; an empty table stays empty. No shuffle.
    """
    rows, fields, names = frames.carried(docs, text, ["lang_pred", "score", "words"])
    schema = T.StructType([*fields, *T.StructType.fromDDL("lang_pred string, score double" + ", words array<struct<word:string,lang:string,p:double>>" * with_words).fields])
    name = f"{id(model)}-{np.random.default_rng().integers(1 << 62)}"
    sent = docs.sparkSession.sparkContext.broadcast((model, name))

    def run(batches):
        use = labeller(sent)
        labels = use.model.labels
        for part in pieces(batches, "body", LABEL_BYTES):
            texts = column(part, "body").fill_null("").to_pylist()
            posterior, doc, starts, lengths = use.label(texts)
            n = np.bincount(doc, minlength=len(texts))
            mass = np.stack([np.bincount(doc, posterior[:, j], len(texts)) for j in range(len(labels))], axis=1) if labels else np.zeros((len(texts), 1))
            best = mass.argmax(axis=1)
            score = np.clip(mass[np.arange(len(texts)), best] / np.maximum(n, 1), 0.0, 1.0)
            cols = [*(column(part, f.name) for f in fields), pa.array([labels[b] if w else UNKNOWN for b, w in zip(best.tolist(), n.tolist(), strict=True)], pa.string()), pa.array(score)]
            if with_words:
                joined, at, out = "\n".join(texts), 0, []
                top = posterior.argmax(axis=1) if len(posterior) else np.empty(0, np.int64)
                for w in n.tolist():
                    out.append([{"word": joined[starts[i] : starts[i] + lengths[i]], "lang": labels[top[i]], "p": float(posterior[i, top[i]])} for i in range(at, at + w)])
                    at += w
                cols.append(pa.array(out, pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return rows.mapInArrow(run, schema).toDF(*names, *schema.names[len(fields) :])


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, mod n."""
    return F.crc32(frames.named(id_col).cast("string").cast("binary")) % n


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = frames.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = fit(docs, ~held_out)
    return detect(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")
