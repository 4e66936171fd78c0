"""The pipeline against a brute-force version of each stage."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scanlens.llm import frames, langid, line_dedup

from .test_decontaminate import brute as brute_windows
from .test_near_duplicates import brute_components, brute_lines
from .test_tokens import tiktoken_encoding

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = frames.table(spark, SF, "documents")
    items = [(r.item_id, r.text) for r in frames.table(spark, SF, "benchmark").collect()]
    now = [(r.doc_id, r.text) for r in docs.collect()]
    labels = {r.doc_id: r.lang for r in docs.collect()}
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = frames.written(stage(spark, docs, SF), name)
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            seen[name] = sorted((r.doc_id, r.text) for r in docs.collect())
    kept = dict(seen["language"])
    assert all(kept[i] == t for i, t in now if i in kept) and len(kept) >= 0.95 * len(now)
    want = sorted((i, t) for i, t, n, k in brute_lines(seen["language"]) if n == k or t.strip(line_dedup.BLANK + "\n"))
    assert sum(a != b for a, b in zip(seen["lines"], want, strict=True)) <= 1
    want = [(i, t) for (i, t), c in zip(seen["lines"], sorted(brute_components(seen["lines"]), key=lambda r: r[0]), strict=True) if c[0] == c[2]]
    assert seen["near_duplicates"] == want
    dirty = {r[0] for r in brute_windows(want, items) if r[-1]}
    want = [x for x in want if x[0] not in dirty]
    assert seen["benchmark"] == want
    enc = tiktoken_encoding()
    rows = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in docs.collect()}
    for i, t in want:
        ids = enc.encode_ordinary(t)
        assert rows[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert len(rows) == len(want) and corpus_pipeline.run(spark, SF).count() == len(rows)
    assert set(labels) >= set(rows)


def test_odd_documents(spark):
    good = "the and of that this is a long english text with words, words and more of them"
    rows = [(1, good, "en", "s", 0), (1, good, "en", "s", 0), (2, good, None, None, None), (None, good + " again", "en", "s", 1), (3, None, "en", "s", 1), (4, "", "en", "s", 1), (5, "12 34", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = frames.written(stage(spark, docs, SF), name)
    got = docs.collect()
    assert [r.doc_id for r in got] == [1] and got[0].text == good and got[0].n_chars == len(good)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_language_rejects_mixed_text(spark):
    """A text with stretches of several languages goes, its parts alone stay; columns with clashing names stay as they are."""
    docs = frames.table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.lang: r.text.split()[:60] for r in docs.where("n_chars > 600").collect()}
    some = sorted(texts)[:4]
    mixed = " ".join(" ".join(texts[x][at : at + 15]) for at in range(0, 60, 15) for x in some)
    rows = [(10**6, mixed, "en", "s", 1)] + [(10**6 + 1 + i, " ".join(texts[x]), x, "s", 1) for i, x in enumerate(some)]
    more = docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumn("score", F.lit("own")).withColumn("a.b", F.lit(7))
    got = corpus_pipeline.language(spark, more, SF)
    assert got.columns == more.columns
    kept = {r.doc_id: (r.score, r["a.b"]) for r in got.where("doc_id >= 1000000").collect()}
    assert set(kept) == {10**6 + 1 + i for i in range(len(some))} and set(kept.values()) == {("own", 7)}


@pytest.fixture(scope="module", autouse=True)
def names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "benchmark", "tokens"]


def test_texts_go_to_python_once(spark):
    docs = frames.table(spark, SF, "documents")
    for stage in (corpus_pipeline.language, corpus_pipeline.benchmark):
        plan = stage(spark, docs, SF)._jdf.queryExecution().optimizedPlan()
        nodes = [plan]
        for node in nodes:
            children = node.children()
            nodes += [children.apply(i) for i in range(children.size())]
        (sent,) = [n.child().schema() for n in nodes if n.nodeName() == "MapInArrow"]
        assert sent.fieldNames().count("body") == 1 and len(sent.fieldNames()) == 3
        assert '"text"' not in sent.json()


def test_texts_of_other_types_still_go(spark):
    docs = spark.createDataFrame([(1, b"abc", "x")], "doc_id long, text binary, body string")
    rows, fields, names = frames.carried(docs, "text", [])
    assert rows.columns == ["c0", "c1", "c2", "body"] and names == docs.columns and rows.first().body == "abc"
    rows, fields, names = frames.carried(docs.withColumn("text", F.lit("t")), "text", ["doc_id"])
    assert rows.columns == ["body", "c1"] and tuple(rows.first()) == ("t", "x") and [f.name for f in fields] == ["body", "c1"] and names == ["text", "body"]


def test_worker_remembers_one_operator_at_a_time():
    import gc
    import weakref

    from scanlens.llm import bpe, frames, langid

    class Sent:
        value = (langid.train(["one two three four", "eins zwei drei vier"], ["en", "de"]), "model")

    coder = bpe.coder(bpe.RANKS)
    assert bpe.coder(bpe.RANKS) is coder
    gone = weakref.ref(coder)
    del coder
    use = langid.labeller(Sent)
    assert langid.labeller(Sent) is use
    gc.collect()
    assert gone() is None
    assert [owner for owner, _, _ in frames.REMEMBERED] == ["langid"]


def test_documents_go_to_python_in_bounded_batches(spark):
    from scanlens.llm import bpe, frames

    before = spark.conf.get(frames.ARROW_SETTING)
    try:
        for set_to, then in (("10000", str(frames.ARROW_ROWS)), ("0", str(frames.ARROW_ROWS)), ("7", "7")):
            spark.conf.set(frames.ARROW_SETTING, set_to)
            docs = spark.createDataFrame([(1, "one"), (2, None)], "doc_id long, text string")
            assert bpe.round_trip(docs).count() == 2
            assert spark.conf.get(frames.ARROW_SETTING) == then
    finally:
        spark.conf.set(frames.ARROW_SETTING, before)
