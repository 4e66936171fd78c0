"""Operator 13 against direct counting."""

import random
import re
from collections import Counter, defaultdict

import pytest

from scanlens.llm import divergence, frames

SF = "/root/testdata/sf0.001"


def brute(rows, least=10, top=10):
    """rows (text, lang, source)."""
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang].add(source)
        counts[lang, source].update(words)
        seen[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in seen[lang].items() if n >= least)

        def shares(count, kept=kept):
            size = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (size + 2 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(far(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, far(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def test_op13(spark):
    rows = [(r.text, r.lang, r.source) for r in frames.table(spark, SF, "documents").collect()]
    got = divergence.op13_source_divergence(spark, SF)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("least", [1, 3, 10])
def test_odd_rows(spark, least):
    rng = random.Random(least)
    words = ["the", "The", "été", "ÉTÉ", "日本", "a\U0001f600b", "x1y", "don't", "ß", "\x00nul", "z" * 3000, *[f"w{chr(97 + k)}" for k in range(20)]]
    rows = [(None, None, None), ("", "", ""), ("12 34 !?", "en", "empty"), ("solo solo", "xx", "one"), ("tie tie tie", "tt", "a"), ("tie tie tie", "tt", "b"), ("few", "yy", "p"), (None, "yy", "q"), ("few", "yy", None)]
    for _ in range(80):
        rows.append((" ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["en", "de", None]), rng.choice(["s", "t", "u", None, ""])))
    rows += [("hot " * 20_000 + "the end", "en", "s"), *[("copy of a text", "en", "t")] * 30]
    df = spark.createDataFrame([(t, a, s, 1, "x", 2) for t, a, s in rows], "text string, lang string, source string, n int, term string, p int").repartition(4)
    assert sorted(map(tuple, divergence.divergence(df, least_docs=least).collect())) == brute(rows, least)


def test_terms_are_summed_before_rows_are_made(spark):
    """No row for each occurrence of a term: only sums leave the step that reads texts."""
    texts = [("Hot hot " * 50_000 + "é", "en", "s"), ("hot", "en", "s"), ("hot1HOT2\x00", "en", "t"), ("日本hot", "en", None), ("", "en", "s"), ("12 !", None, None)]
    rows = spark.createDataFrame(texts, "text string, lang string, source string").na.fill("").coalesce(1)
    counts = divergence.term_counts(rows)
    assert sorted(map(tuple, counts.collect())) == [("en", "", "日本hot", 1, 1), ("en", "s", "hot", 100_001, 2), ("en", "s", "é", 1, 1), ("en", "t", "hot", 2, 1)]
    assert "Generate" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_empty(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
