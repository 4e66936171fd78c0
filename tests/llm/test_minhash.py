"""Operator 11 against all pairs."""

import random
import re

import numpy as np
import pytest

from scanlens.llm import frames, jaccard_join, minhash_dedup

from .test_near_duplicates import cases, union_find

SF = "/root/testdata/sf0.001"


def brute(docs, size=2):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set())
    links = [(x, y) for x in range(len(sets)) for y in range(x) if sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    root, least = union_find(range(len(sets)), links), {}
    for x, (i, _) in enumerate(docs):
        if i is not None:
            least[root[x]] = min(least.get(root[x], i), i)
    named = [(i, len(s), least.get(root[x]) if s else i) for x, ((i, _), s) in enumerate(zip(docs, sets, strict=True))]
    return sorted(((*r, r[0] == r[2]) for r in named), key=str)


@pytest.mark.parametrize("block, few, bucket, frequent, pack", [(None, 6, 1_000_000, 256, 16 << 20), (7, 3, 3000, 5, 10_000)])
def test_op11(spark, monkeypatch, block, few, bucket, frequent, pack):
    if block:
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "BUCKET_KEYS", bucket)
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "PACK_BYTES", pack)
    docs = cases(11)
    df = spark.createDataFrame([(i, t, "clash", True) for i, t in docs], "doc_id long, text string, node string, kept boolean").repartition(3)
    assert sorted(map(tuple, minhash_dedup.minhash_components(df).collect()), key=str) == brute(docs)


def test_op11_documents(spark):
    docs = [(r.doc_id, r.text) for r in frames.table(spark, SF, "documents").collect()]
    got = minhash_dedup.op11_minhash_dedup(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs)


def test_op11_empty(spark):
    assert minhash_dedup.minhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    none = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert sorted(map(tuple, minhash_dedup.minhash_components(none).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_recall_at_the_threshold():
    """Of 1000 pairs of sets with J = 0.8, all but one at most share a key; of pairs with J = 0.2 few do."""
    rng = np.random.default_rng(7)
    found = {}
    for common, own in ((80, 10), (20, 40)):
        hits = 0
        for _ in range(1000):
            values = np.unique(rng.integers(0, 2**63, common + 2 * own).astype(np.uint64))
            both = rng.permutation(values)
            sets = [np.sort(both[: common + own]), np.sort(np.concatenate([both[:common], both[common + own :]]))]
            keys, owners, spare = minhash_dedup.tensor_keys(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
            assert len(keys) == 2 * minhash_dedup.TABLES == 90 and not spare.any()
            hits += bool(set(keys[owners == 0].tolist()) & set(keys[owners == 1].tolist()))
        found[common] = hits
    assert found[80] >= 999 and found[20] < 120


def test_half_keys_agree_as_often_as_the_sets_do():
    rng = np.random.default_rng(9)
    values = rng.permutation(np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64)))
    a, b = values[:800], values[200:]  # J = 0.6
    half = minhash_dedup.half_keys(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)]), halves=2000, rows=1)
    assert abs((half[0] == half[1]).mean() - 0.6) < 0.05


def test_percent(spark):
    with pytest.raises(ValueError, match="70 to 100"):
        minhash_dedup.minhash_components(spark.createDataFrame([], "doc_id long, text string"), percent=50)
