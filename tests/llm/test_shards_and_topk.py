"""Operators 1 and 4 against direct computation."""

import hashlib
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlens.llm import frames, shard_tree, topk

SF = "/root/testdata/sf0.001"


def brute_shard(key, tree):
    def pick(paths):
        draws = []
        for i, (path, w) in enumerate(paths):
            u = (int(hashlib.md5(f"{key}/{path}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
            draws.append((math.log(u) / w, i))
        return max(draws)[1]

    weigh = lambda f: sum(s.weight for s in tree if f(s))
    regions = sorted({s.region for s in tree})
    r = regions[pick([(x, weigh(lambda s: s.region == x)) for x in regions])]
    racks = sorted({s.rack for s in tree if s.region == r})
    k = racks[pick([(f"{r}/{x}", weigh(lambda s: (s.region, s.rack) == (r, x))) for x in racks])]
    shards = sorted((s for s in tree if (s.region, s.rack) == (r, k)), key=lambda s: s.shard)
    return shards[pick([(f"{r}/{k}/{s.shard}", s.weight) for s in shards])].shard


def check_placed(rows, tree, grown, id_name="doc_id"):
    slots = {}
    for r in rows:
        key = "null" if r[id_name] is None else str(r[id_name])
        assert r["shard"] == brute_shard(key, tree) and r["law"] == "key"
        assert r["grown_shard"] == (brute_shard(key, grown) if grown else None)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op1(spark):
    tree = shard_tree.even_tree(2, 4, 5)
    rows = shard_tree.op1_shard_tree(spark, SF).collect()
    check_placed(rows, tree, shard_tree.grown_by_branch(tree))
    texts = {r.doc_id: (r.text or "").encode() for r in frames.table(spark, SF, "documents").collect()}
    assert all((r["size"], r["text_crc32"]) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id])) for r in rows)
    assert len(rows) == len(texts) and all(r.grown_shard in (r.shard, 40) for r in rows)


def test_op1_odd_rows_and_weights(spark):
    rows = [(i, "é" * i, "clash") for i in range(300)] + [(None, None, "x"), (None, "", "x"), (5, "again", "x"), (5, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    tree = [shard_tree.Shard("a", "x", 0, 3.0), shard_tree.Shard("a", "x", 1), shard_tree.Shard("a", "y", 2), shard_tree.Shard("b", "x", 7, 2.0)]
    heavier = [*tree[:3], shard_tree.Shard("b", "x", 7, 4.0)]
    got = shard_tree.place(df, tree, grown=heavier).collect()
    check_placed(got, tree, heavier)
    assert all(r.grown_shard in (r.shard, 7) for r in got) and any(r.grown_shard != r.shard for r in got)
    assert sum(r["size"] == 16 for r in got) == 3 and len(got) == len(rows)
    assert shard_tree.place(df.limit(0), tree).count() == 0
    with pytest.raises(ValueError):
        shard_tree.place(df, [])


def test_op1_large_tree(spark):
    """2048 shards: the plan is as small as for a few. An inner weight moves rows within its region and rack only."""
    tree = shard_tree.even_tree(8, 16, 16)
    heavier = [shard_tree.Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 700 else 1.0) for s in tree]
    df = frames.table(spark, SF, "documents")
    began = time.perf_counter()
    got = shard_tree.place(df, tree, grown=heavier).collect()
    assert time.perf_counter() - began < 30
    check_placed(got, tree, heavier)
    where = {s.shard: (s.region, s.rack) for s in tree}
    changed = where[700]
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    for r in shard_tree.place(many, tree, grown=heavier).where("shard <> grown_shard").collect():
        # a heavier shard makes its rack and region heavier: rows come into the region, its rack, or the shard, and no other rows move
        assert where[r.grown_shard] == changed or (where[r.grown_shard][0] == changed[0] != where[r.shard][0])


def test_op1_many_equal_rows(spark, monkeypatch):
    """One id or no id for most rows: they come apart in spans, slots stay without gaps."""
    monkeypatch.setattr(shard_tree, "SPAN", 7)
    rows = [(None, "a")] * 100 + [(5, "b")] * 50 + [(None, f"text {i}") for i in range(60)] + [(i, "c") for i in range(40)]
    tree = shard_tree.even_tree(1, 2, 2)
    got = shard_tree.place(spark.createDataFrame(rows, "`doc.id` long, text string"), tree, id_col="doc.id")
    assert got.columns[0] == "doc.id" and got.count() == len(rows)
    check_placed(got.collect(), tree, None, "doc.id")


def test_op1_slots_in_many_groups(spark, monkeypatch):
    monkeypatch.setattr(shard_tree, "GROUP_ROWS", 3)
    tree = shard_tree.even_tree(1, 1, 2)
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    few = {r.doc_id: r.slot for r in shard_tree.place(df, tree).collect()}
    monkeypatch.setattr(shard_tree, "GROUP_ROWS", 10**6)
    assert few == {r.doc_id: r.slot for r in shard_tree.place(df, tree).collect()}


def test_op1_shares_follow_weights(spark):
    tree = [shard_tree.Shard("a", "x", 0, 1.0), shard_tree.Shard("b", "x", 1, 3.0)]
    df = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    assert 0.72 < shard_tree.place(df, tree).where("shard = 1").count() / 8000 < 0.78


def brute_top(rows, k, scale=64):
    v = {}
    for i, x in sorted(rows, key=lambda r: str(r)):
        if i is not None and x and all(c is not None and math.isfinite(c) for c in x):
            f = [math.floor(scale * float(np.float32(c))) for c in x]
            v[i] = min(v.get(i, f), f)
    out = []
    for q in sorted(v):
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:k]
            out += [(q, i + 1, c, -n) for i, (n, c) in enumerate(s)]
    return out


@pytest.mark.parametrize("query_block, bins, copies", [(2048, 128, 0), (3, 4, 400)])
def test_op4(spark, query_block, bins, copies):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.25]) for i in range(copies)]
    rows += [(500, None), (520, []), (540, [1.0, None]), (560, [float("nan")] * 6), (580, [float("inf")] * 6), (600, [2.0, -1.5]), (20, rows[20][1]), (40, [9.0] * 6), (None, [1.0] * 6), (620, [0.0] * 6)]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, query_block=query_block, bins=bins)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 20)


def test_op4_down_to_one_score(spark, monkeypatch):
    monkeypatch.setattr(topk, "SLACK", 0)
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 2) for _ in range(20)]) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for bins in (7, 50, 128):
        assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, bins=bins).collect())) == brute_top(rows, 20)


def test_op4_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, (64 * 192 + 128 * 64))]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 1"), F.col("vec_id") % 20 == 0).count() == 0


def test_op4_large_components(spark):
    rows = [(i, [float(np.float32(10.0**6 * (i + 1))), float(i)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, k=5).collect())) == brute_top(rows, 5)
