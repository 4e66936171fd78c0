"""Operators 5 and 6 and components against direct computation."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlens.llm import frames, jaccard_join, line_dedup
from scanlens.llm.components import components

SF = "/root/testdata/sf0.001"


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_sets(docs):
    out = []
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((i, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()))
    return out


def brute_components(docs):
    sets = shingle_sets(docs)
    links = []
    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                links.append((x, y))
    root = union_find(range(len(sets)), links)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[root[x]] = min(least.get(root[x], i), i)
    return sorted(((i, len(s), least.get(root[x]) if s else i) for x, (i, s) in enumerate(sets)), key=str)


def edited(rng, words, share):
    out = list(words)
    for _ in range(max(1, int(len(out) * share / 5))):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def cases(seed=4):
    rng = random.Random(seed)
    docs = [(None, "nobody knows this one, not at all"), (900, None), (901, ""), (902, " \n\t"), (903, "few words"), (904, "FEW words"), (905, "a b c d e"), (906, "a b c d e f g h"), (907, "a b c d e f g h i"), (907, "a b c d e f g h i")]
    n = 0
    for size in (8, 9, 12, 20, 40, 90, 200, 700):
        for _ in range(3):
            base = [f"w{rng.randrange(400)}" for _ in range(size)]
            for share in (0, 0.01, 0.05, 0.1, 0.15, 0.2, 0.3):
                docs.append((n, " ".join(edited(rng, base, share) if share else base)))
                n += 1
            docs.append((n, " ".join(base + base[:3])))
            n += 1
    passage = [f"p{i}" for i in range(30)]
    for i in range(60):  # a passage in many unrelated texts, large and small
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([3, 6, 30, 80]))]
        docs.append((2000 + i, " ".join(own + passage)))
    hot = [f"h{i}" for i in range(100)]
    for i in range(40):
        docs.append((3000 + i, " ".join(edited(rng, hot, 0.04))))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("block, few, bucket, frequent, pack", [(2048, 6, 1_000_000, 256, 16 << 20), (7, 3, 3000, 256, 16 << 20), (7, 3, 3000, 5, 10_000), (2048, 6, 1_000_000, 12, 16 << 20)])
def test_op5(spark, monkeypatch, block, few, bucket, frequent, pack):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "BUCKET_KEYS", bucket)
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "PACK_BYTES", pack)
    docs = cases()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, node string, size int").repartition(3)
    got = jaccard_join.near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(docs)


def test_op5_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.near_duplicates(df).count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.near_duplicates(none).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_op5_documents(spark):
    docs = [(r.doc_id, r.text) for r in frames.table(spark, SF, "documents").collect()]
    assert sorted(map(tuple, jaccard_join.op5_jaccard_join(spark, SF).collect()), key=str) == brute_components(docs)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for n in (5, 60, 900):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 5], rng.integers(0, 2**63, n // 3).astype(np.uint64)]))
        words = jaccard_join.folded([jaccard_join.sketch(a), jaccard_join.sketch(b)])
        assert np.bitwise_count(words[0] ^ words[1]).sum() <= len(np.setxor1d(a, b))


def test_every_linked_pair_shares_a_key():
    rng = random.Random(8)
    plan = jaccard_join.Plan()
    for _ in range(300):
        n = rng.choice([4, 5, 9, 12, 18, 30, 33, 54, 100, 260, 600])
        common = max(4, n - rng.randrange(0, n // 5 + 2))
        a = {rng.getrandbits(63) for _ in range(common)}
        b = set(a)
        for s in (a, b):
            for _ in range(rng.randrange(0, n // 6 + 2)):
                s.add(rng.getrandbits(63))
        if a == b or 100 * len(a & b) < 80 * len(a | b):
            continue
        values = [np.array(sorted(s), np.uint64) for s in (a, b)]
        keys, owners, _ = jaccard_join.segment_keys(np.concatenate(values), np.array([0, len(a), len(a) + len(b)]), plan)
        assert set(keys[owners == 0].tolist()) & set(keys[owners == 1].tolist())


@pytest.mark.parametrize("percent", [10, 34, 50, 65, 80, 90, 99])
def test_linked_pairs_share_a_key_at_any_percent(percent):
    rng = random.Random(percent)
    plan = jaccard_join.Plan(percent)
    for n in [*range(1, 30), 60, 100, 150] * 3:
        m = rng.randrange(n, 100 * n // percent + 1)  # the set of m holds the set of n: as far apart in size as links go
        if m == n:
            continue
        b = rng.sample(range(1 << 62), m)
        values = [np.array(sorted(s), np.uint64) for s in (b[:n], b)]
        keys, owners, _ = jaccard_join.segment_keys(np.concatenate(values), np.array([0, n, n + m]), plan)
        assert set(keys[owners == 0].tolist()) & set(keys[owners == 1].tolist())


def test_percent_out_of_range():
    for percent in (0, 101):
        with pytest.raises(ValueError, match="percent"):
            jaccard_join.Plan(percent)


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000)]
    root = union_find({x for e in links for x in e}, links)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == root and len(got) == len(root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dropped_tables_let_the_driver_collect(spark):
    beans = list(spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    scratch = frames.Scratch(spark, "collected")
    table = scratch.written(spark.range(3), "rows")
    before = whole()
    scratch.drop(table)
    assert whole() > before


def line_shingles(line):
    units, k = line.encode("utf-16-be"), line_dedup.SHINGLE
    return {units[2 * i : 2 * (i + k)] for i in range(len(units) // 2 - k + 1)}


def line_pairs(names):
    """All pairs of lines that link, by counting the shingles that they share."""
    sets = [line_shingles(x) for x in names]
    holders = defaultdict(list)
    for i, own in enumerate(sets):
        for g in own:
            holders[g].append(i)
    common = Counter(p for own in holders.values() for p in itertools.combinations(own, 2))
    return [(names[i], names[j]) for (i, j), c in common.items() if 100 * c >= line_dedup.PERCENT * (len(sets[i]) + len(sets[j]) - c)]


def brute_lines(docs):
    places = []
    for i, t in sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0)):
        places += [(i is None, i or 0, at, (i, t), line) for at, line in enumerate(t.split("\n") if t is not None else ()) if line.strip(line_dedup.BLANK)]
    names = sorted({p[4] for p in places})
    root = union_find(names, line_pairs(names))
    first = {}
    for p in sorted(places, key=lambda p: p[:3]):
        first.setdefault(root[p[4]], (p[3], p[2]))
    out = []
    for i, t in docs:
        own = t.split("\n") if t is not None else []
        keep = [x for at, x in enumerate(own) if not x.strip(line_dedup.BLANK) or first[root[x]] == ((i, t), at)]
        out.append((i, None if t is None else "\n".join(keep), len(own), len(keep)))
    return sorted(out, key=str)


def test_op6(spark):
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    bases = [say(n) for n in (6, 8, 12, 30, 60, 200, 3000) for _ in range(3)]
    docs = []
    for i in range(40):
        own = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(bases)
            if rng.random() < 0.5 and len(line) > 150:
                at = rng.randrange(len(line) - 5)
                line = line[:at] + "é漢" + line[at + 3 :]
            own.append(line if rng.random() < 0.8 else say(20))
        docs.append((i, "\n".join(own + ["short", ""])))
    docs += [(50, None), (51, ""), (52, "short\nshort"), (54, " \n \n\t\n\r"), (55, "short \nshor"), (None, docs[3][1]), (53, "a line of its own, at the end\r\nx"), (7, docs[7][1])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_lines int, h string").repartition(3)
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "h", "n_lines", "n_kept"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_kept) for r in got.collect()), key=str) == brute_lines(docs)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_op6_documents(spark):
    rows = frames.table(spark, SF, "documents").collect()
    got = {r.doc_id: (r.n_lines, r.n_kept, r.n_chars_kept) for r in line_dedup.op6_line_dedup(spark, SF).collect()}
    want = {i: (n, k, None if t is None else len(t)) for i, t, n, k in brute_lines([(r.doc_id, r.text) for r in rows])}
    assert len(got) == len(want) and sum(got[i] != want[i] for i in want) <= 1  # candidates are found with high probability


def variants(rng, line, changes, count):
    out = [line]
    for _ in range(count):
        x = list(line)
        for at in rng.sample(range(len(x)), changes):
            x[at] = rng.choice("ABCDEFGH")
        out.append("".join(x))
    return out


@pytest.mark.parametrize("block", [128, 7])
def test_op6_families_at_the_threshold(spark, monkeypatch, block):
    """Lines that share keys are all compared, not with the least one only."""
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    lines = [x for length, changes, count in ((110, 1, 20), (400, 3, 120), (300, 2, 60)) for x in variants(rng, say(length), changes, count)]
    rng.shuffle(lines)
    docs = list(enumerate(lines))
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    kept = lambda rows: {r[0] for r in rows if r[-1]}
    want = kept(brute_lines(docs))
    assert len(want) < 20 and len(kept((r.doc_id, r.n_kept) for r in got.collect()) ^ want) <= 3  # candidates are found with high probability


def test_op6_repeated_signs(spark):
    """Sizes are numbers of distinct shingles, which lines of any length can share."""
    docs = [(1, "=" * 40), (2, "=" * 300), (3, "ab " * 20), (4, "ab " * 200), (5, "word " * 2000), (6, "word " * 9)]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = sorted((r.doc_id, r.text, r.n_lines, r.n_kept) for r in got.collect())
    assert rows == brute_lines(docs) and [r[0] for r in rows if r[-1]] == [1, 3, 5]


def test_op6_edits_of_medium_lines(spark):
    """One character or one word changed in lines of 30 to 200 characters: those that link by their shingles are found."""
    rng = random.Random(12)
    lines = []
    for n in (30, 45, 60, 70, 80, 100, 140, 200):
        for _ in range(4):
            line = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(n))[:n]
            words = line.split(" ")
            words[rng.randrange(len(words))] = "other"
            lines += [line, line[:-1] + "X", "Y" + line[1:], line[: n // 2] + "Z" + line[n // 2 + 1 :], " ".join(words)]
    docs = list(enumerate(lines))
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    kept = lambda rows: {r[0] for r in rows if r[-1]}
    want = kept(brute_lines(docs))
    assert 32 <= len(want) < 100 and len(kept((r.doc_id, r.n_kept) for r in got.collect()) ^ want) <= 1


def test_op6_hashes_that_collide(spark, monkeypatch):
    """Different lines of one first hash: none is taken for another; exact repeats go all the same."""
    monkeypatch.setattr(line_dedup, "line_hash", lambda line: F.pmod(F.xxhash64(line), F.lit(23)))
    rng = random.Random(31)
    lines = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(80)) for _ in range(300)]
    docs = [(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(100)] + [(200, lines[5]), (201, f"{lines[7]}\nown line of this document")]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_kept) for r in got.collect()), key=str) == brute_lines(docs)


def test_op6_blocks_by_size(spark, monkeypatch):
    """Lines too long for a common block are blocks of their own, with the same result."""
    monkeypatch.setattr(line_dedup, "BLOCK_CHARS", 900)
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefghijklmnop ") for _ in range(400))
    docs = list(enumerate(variants(rng, line, 3, 60)))
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    kept = lambda rows: {r[0] for r in rows if r[-1]}
    assert len(kept((r.doc_id, r.n_kept) for r in got.collect()) ^ kept(brute_lines(docs))) <= 1


def test_op6_blocks_are_compared_by_generated_code(spark):
    """Large keys: no function with a lambda (Spark interprets those for each pair of lines), no texts in the blocks; all links are among the pairs."""
    rng = random.Random(17)
    names = variants(rng, "".join(rng.choice("abcdefghijklmnop ") for _ in range(400)), 5, 40)
    lines = spark.createDataFrame(list(enumerate(names)), "h long, line string")
    mixed = spark.createDataFrame([(key, i, i, len(names)) for key in (5, 6) for i in range(len(names))], "key long, h long, root long, many long")
    nodes = line_dedup.sketches(lines)
    every, first = (line_dedup.block_pairs(mixed, nodes, everyone) for everyone in (True, False))
    assert "line" not in nodes.columns and "lambda" not in every._jdf.queryExecution().executedPlan().toString()
    got = [(names[r.a], names[r.b]) for r in every.collect()]
    assert len(set(got)) == len(got) and set(map(frozenset, line_pairs(names))) <= set(map(frozenset, got))
    near = {(names[r.a], names[r.b]) for r in first.collect()}
    assert near <= set(got) and {p[0] for p in near} == {p[0] for p in got}


def test_op6_pairs_of_large_keys_come_once(spark):
    """The rows made for large keys are near pairs, each from one of its keys; none is lost by that."""
    rng = random.Random(23)
    names = variants(rng, "".join(rng.choice("abcdefghijklmnop ") for _ in range(400)), 5, 60)
    scratch = frames.Scratch(spark, "once")
    lines = scratch.written(spark.createDataFrame(list(enumerate(names)), "h long, line string"), "lines")
    signed = scratch.written(line_dedup.signatures(lines), "signed")
    mixed = scratch.written(line_dedup.mixed_members(line_dedup.key_members(signed, scratch), spark.createDataFrame([], "node long, root long")), "mixed")
    nodes = scratch.written(line_dedup.fine_nodes(lines, signed), "nodes")
    pairs = lambda df: [(r.a, r.b) for r in df.select("a", "b").collect()]
    close = line_dedup.block_close(mixed, nodes)
    every, once, few = pairs(line_dedup.block_close(mixed, nodes.drop(*[f"m{k}" for k in range(line_dedup.MINS)]))), pairs(close), set(pairs(line_dedup.few_pairs(mixed)))
    assert len(every) > 30 and set(once) <= set(every) and set(every) - set(once) <= few
    plan = close._jdf.queryExecution().executedPlan().toString()
    assert "explode(two" not in plan and plan.count("Generate explode") == 1  # a line's blocks
    size = {r.h: r.n for r in nodes.select("h", "n").collect()}
    assert all(size[i] == len({x[k : k + line_dedup.SHINGLE] for k in range(len(x) - line_dedup.SHINGLE + 1)}) for i, x in enumerate(names))


def test_op6_recall(spark):
    """Links of an exact join of all lines whose ends come into one component."""
    docs = frames.table(spark, "/root/testdata/sf0.01", "documents")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).where(F.btrim("line", F.lit(line_dedup.BLANK)) != "").distinct()
    hashes = {r.line: r.h for r in lines.withColumn("h", F.xxhash64("line")).collect()}
    links = line_pairs(sorted(hashes))
    scratch = frames.Scratch(spark, "recall")
    root = {r.node: r.root for r in components(line_dedup.line_links(docs, "text", scratch)).collect()}
    found = sum(root.get(hashes[a], a) == root.get(hashes[b], b) for a, b in links)
    print(f"recall: {found} of {len(links)} links")
    assert len(links) > 100 and found >= 0.99 * len(links)


def test_op6_plan_has_no_python(spark):
    plan = line_dedup.op6_line_dedup(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
