"""Operator 8: forward-backward against enumeration, and held-out accuracy."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlens.llm import frames, langid

SF = "/root/testdata/sf0.01"


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 4, 2, 4])
    starts = np.cumsum(lengths) - lengths
    emit, move = rng.random((11, 3)) + 0.01, rng.random((3, 3)) + 0.01
    a, b = langid.forward_backward(emit, move, starts, lengths)
    got = a * b
    got /= got.sum(axis=1, keepdims=True)
    for s, n in zip(starts, lengths, strict=True):
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.prod([emit[s + i, k] for i, k in enumerate(path)]) * np.prod([move[i, j] for i, j in itertools.pairwise(path)])
            for i, k in enumerate(path):
                want[i, k] += w
        assert np.allclose(got[s : s + n], want / want.sum(axis=1, keepdims=True))


@pytest.fixture(scope="module")
def model(spark):
    docs = frames.table(spark, SF, "documents")
    return langid.fit(docs, langid.remainder("doc_id", 4) != 2)


def test_held_out_accuracy(spark, model):
    truth = {r.doc_id: r.lang for r in frames.table(spark, SF, "documents").collect()}
    got = langid.op8_language_id(spark, SF).collect()
    assert len(got) == len(truth) and set(got[0].asDict()) == {"doc_id", "held_out", "lang_pred", "score"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held)
    assert right > 0.97, right


def test_code_switching(spark, model):
    rows = frames.table(spark, SF, "documents").where("n_chars > 300").select("text", "lang").collect()
    say = {k: next(r.text for r in rows if r.lang == k).split()[5:25] for k in ("en", "fr", "de")}
    df = spark.createDataFrame([(" ".join(say["en"] + say["fr"] + say["de"]),)], "text string")
    r = langid.detect(df, model, with_words=True).first()
    assert 0.2 < r.score < 0.6
    seen = [w.lang for w in r.words]
    n = len(seen) // 3
    assert max(set(seen[2 : n - 4]), key=seen.count) == "en" and max(set(seen[n + 4 : 2 * n - 4]), key=seen[n:].count) == "fr"


def test_odd_rows(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 !! \n 99", "x"), (4, "the and of that", None), (4, "the and of that", None), (None, "les des et que", "x"), (6, "日本語", "x"), (7, "the and of " * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = langid.detect(df, model).collect()
    assert [r.lang_pred for r in got][:3] == ["und"] * 3 and all(r.score == 0 for r in got[:3])
    assert all(r.lang_pred in model.labels for r in got[3:]) and got[3] == got[4]
    assert langid.detect(df.limit(0), model).count() == 0
    empty = langid.fit(df.limit(0).withColumn("lang", F.lit("en")), F.lit(True))
    assert {r.lang_pred for r in langid.detect(df, empty).collect()} == {"und"}


def test_sample_of_very_many_rows():
    """About as many rows as are wanted, from 10 billion rows as from ten."""
    n, wanted = 10**10, 80
    share = (langid.threshold(n, wanted) + (1 << 63)) / (1 << 64)
    assert abs(share * n - wanted) < 1e-3 and langid.threshold(10, wanted) == langid.threshold(80, wanted) == (1 << 63) - 1
    assert langid.threshold(10**18, wanted) > -(1 << 63)


def test_sample_is_whole_and_takes_rare_languages(spark):
    rows = [(i, "the and of that " * 20_000 if i == 0 else f"the and of that {i}", "en") for i in range(3000)] + [(9000 + i, f"les des et que {i}", "fr") for i in range(3)] + [(None, "the same", "en")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    a, b = langid.fit(df, F.lit(True)), langid.fit(df.coalesce(1), F.lit(True))
    assert a.labels == b.labels == ["en", "fr"] and (a.weights == b.weights).all()


def test_detect_against_enumeration(spark, model):
    """lang_pred and score of short texts by all labellings of their words."""
    texts = ["the cat", "les des und", "word of the day", "und die", "a", "que es la casa", "12 34", "the les der que"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in langid.detect(df, model).collect()}
    k = len(model.labels)
    for i, t in enumerate(texts):
        letters, lengths, doc, _, _ = langid.words_of([t])
        if not len(lengths):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        emit = np.exp(model.scores(letters, np.cumsum(lengths) - lengths, lengths))
        moves, n = np.exp(model.moves), len(lengths)
        mass = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=n):
            w = np.prod([emit[j, x] for j, x in enumerate(path)]) * np.prod([moves[x, y] for x, y in itertools.pairwise(path)])
            for j, x in enumerate(path):
                mass[j, x] += w
        mean = (mass / mass.sum(axis=1, keepdims=True)).mean(axis=0)
        assert got[i].lang_pred == model.labels[mean.argmax()] and got[i].score == pytest.approx(mean.max(), rel=1e-6)


def test_remembered_words_keep_their_scores(model, monkeypatch):
    texts = ["the cat and the dog\nle chien", "", "der Hund und the cat", "el perro y la casa", "la maison und das Haus", "the dog le perro"]
    want = langid.Labeller(model).label(texts)[0]
    for most in (500_000, 6, 1):
        monkeypatch.setattr(langid, "MEMO_WORDS", most)
        use = langid.Labeller(model)
        for _ in range(2):
            got = np.concatenate([use.label([t])[0] for t in texts])
            assert np.allclose(got, want, rtol=1e-12, atol=0)
        assert len(use.hashes) == len(use.known) and (use.hashes[1:] > use.hashes[:-1]).all()
