"""Operator 10 against a direct search."""

import hashlib
import random
import re

import pytest

from scanlens.llm import decontaminate, frames

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    grams = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            grams.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    sizes = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := grams.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(5)
    vocabulary = ["a", "b", "The", "é9", "漢字", "x1"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 4, 9, 10, 11, 14, 30]))) for i in range(12)] + [(99, None), (98, ""), (97, "only once. HERE;now a b c d e f g"), (None, "nameless item words"), (1, say(12))]
    docs = [(i, say(rng.choice([0, 1, 5, 40, 300])) + (items[i % 12][1] if i % 3 else "")) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "-- !!"), (103, "x only ONCE here now A b\nc d e f g y"), (103, "x only ONCE here now A b\nc d e f g y"), (None, "some nameless, item. Words")]
    return docs, items


@pytest.mark.parametrize("item_bytes", [1 << 25, 300])
def test_op10_small(spark, item_bytes):
    docs, items = cases()
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(df, bench, item_bytes=item_bytes)
    rows = out.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows), key=str) == brute(docs, items)
    texts = {"" if i is None else str(i): [] for i, _ in items}
    for i, t in items:
        texts["" if i is None else str(i)].append(words(t))
    for r in rows:
        w = words(r.text)
        for s in r.spans:
            assert any(w[s.doc_word : s.doc_word + s.length] == t[s.item_word : s.item_word + s.length] for t in texts[s.item])
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not r.contaminated for r in rows)


def test_op10_spans_are_longest(spark):
    words_ = [f"w{i}" for i in range(40)]
    df = spark.createDataFrame([(1, "z " + " ".join(words_[3:30]) + " q " + " ".join(words_[20:33]))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words_))], "item_id long, text string")
    spans = decontaminate.contamination(df, bench).first().spans
    assert [(s.item_word, s.doc_word, s.length) for s in spans] == [(3, 1, 27), (20, 29, 13)]


def test_op10_empty_sides(spark):
    docs, items = cases()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated or n_items > 0").count() == 0


def test_op10_documents(spark):
    docs = [(r.doc_id, r.text) for r in frames.table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in frames.table(spark, SF, "benchmark").collect()]
    got = decontaminate.op10_decontamination(spark, SF)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=str) == brute(docs, items) and any(r[-1] for r in rows)


@pytest.mark.parametrize("item_bytes", [1 << 25, 100])
def test_op10_repetitive_texts(spark, item_bytes):
    """An item of one word many times, in a text of that word: no list of all pairs of places."""
    items = [(1, "a " * 1000), (2, "a " * 1000), (3, "a " * 9), (4, "a b " * 400), (5, "b")]
    docs = [(1, "a " * 200_000), (2, "a " * 100_000 + "b " + "a " * 8), (3, "b a " * 30_000), (4, "c " * 50_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(df, bench, with_spans=False, item_bytes=item_bytes).drop("text").collect()
    assert sorted((tuple(r) for r in rows), key=str) == brute(docs, items)


def test_op10_spans_of_repetitive_texts():
    """Spans are exactly the longest runs on each diagonal."""
    import numpy as np

    rng = random.Random(8)
    for _ in range(60):
        say = lambda n: [rng.choice("aab") for _ in range(n)]
        docs, items, window = [say(rng.randrange(40)) for _ in range(3)], [say(rng.randrange(1, 12)) for _ in range(4)], rng.choice([1, 2, 4, 5])
        texts = sorted({" ".join(t) for t in items})
        own = decontaminate.Items([[t] for t in texts], texts, window)
        data, offsets = decontaminate.text_bytes(decontaminate.pa.array([" ".join(d) for d in docs], decontaminate.pa.large_string()))
        _, _, hashes, firsts = decontaminate.spans(data, offsets, decontaminate.ALNUM)
        shard = decontaminate.Shard(hashes, firsts, window)
        names = shard.item_words(own)
        text, item_word, place, length = shard.spans(own, names, *shard.ranges(own, names))
        got = sorted((texts[t], int(w), int(shard.doc[p]), int(p - shard.starts[shard.doc[p]]), int(n)) for t, w, p, n in zip(text, item_word, place, length, strict=True))
        want = []
        for t in texts:
            w = t.split()
            for d, x in enumerate(docs):
                for i in range(len(w)):
                    for j in range(len(x)):
                        if i and j and w[i - 1] == x[j - 1] and len(w) >= window:
                            continue
                        n = 0
                        while i + n < len(w) and j + n < len(x) and w[i + n] == x[j + n]:
                            n += 1
                        if n >= window or (len(w) < window and i == 0 and n == len(w)):
                            want.append((t, i, d, j, n))
        assert got == sorted(want)


def test_op10_blocks_of_items(spark):
    """Equal items are one text; blocks follow sizes."""
    items = [(i, "the same text of an item") for i in range(500)] + [(1000 + i, f"item number {i} " * 5) for i in range(300)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = list(decontaminate.blocks(bench, 4000, decontaminate.Scratch(spark, "test")))
    assert [last for *_, last in got] == [False] * (len(got) - 1) + [True] and len(got) > 4
    assert sum(len(texts) for _, texts, _ in got) == 301
    assert sorted(i for ids, _, _ in got for own in ids for i in own) == sorted(str(i) for i, _ in items)
    assert all(sum(len(t) + sum(map(len, own)) + 16 for own, t in zip(ids, texts, strict=True)) <= 4000 or len(texts) == 1 for ids, texts, _ in got)
