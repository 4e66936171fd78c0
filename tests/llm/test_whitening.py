"""Operator 12 against whole-number arithmetic and a plain eigen-solve."""

import math
from fractions import Fraction

import numpy as np
import pytest

from scanlens.llm import frames, whitening

SF = "/root/testdata/sf0.01"


def brute(rows, scale=256, most=4):
    """rows (id, vector) to the whitening by exact sums of fractions; only the eigen-solve is in doubles."""
    good = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max(len(x) for _, x in good)
    good = [(i, x + [0] * (dim - len(x))) for i, x in good]
    fit = sorted({tuple(x) for _, x in good})
    n = len(fit)
    s = [sum(x[d] for x in fit) for d in range(dim)]
    a = np.array([[n * c - t for c, t in zip(x, s, strict=True)] for x in fit], object)
    cov = (a.T @ a) / 1
    cov = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in cov])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    used = int((e[:most] > 1e-13 * np.trace(cov)).sum())
    out = []
    for i, x in good:
        c = [n * p - t for p, t in zip(x, s, strict=True)]
        for k in range(used):
            out.append((i, k + 1, n, sum(p * p for p in c), float(np.dot(np.array(c, float) / n, v[:, k]) / math.sqrt(e[k])), e[k] / np.trace(cov)))
    return out


def compare(got, rows, tolerance=1e-8):
    want = brute(rows)
    key = lambda r: (str(r[0]), r[1], abs(round(r[4], 6)))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [(r[2], int(r[3])) for r in got] == [(r[2], r[3]) for r in want]
    for g, w in zip(got, want, strict=True):
        assert abs(abs(g[4]) - abs(w[4])) <= tolerance * max(1, abs(w[4]))
        assert abs(g[5] - w[5]) <= 1e-9 * w[5]
    for k in {r[1] for r in got}:  # one sign for all rows
        signs = {np.sign(g[4]) * np.sign(w[4]) for g, w in zip(got, want, strict=True) if g[1] == k and abs(w[4]) > 1e-3}
        assert len(signs) <= 1
    assert len({r[6] for r in got}) == 1 and got[0][6] <= 1e-9


def test_op12(spark):
    rows = [(r.vec_id, r.embedding) for r in frames.table(spark, SF, "embeddings").collect()]
    got = whitening.op12_whitening(spark, SF)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == 4 * len(rows)
    compare(got, rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 6)) * [9, 5, 3, 2, 1, 0.5] + 1000
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(5, rows[5][1])] * 7 + [(None, rows[9][1]), (70, None), (71, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (72, [float("nan")] * 6), (73, [float("-inf")] + [0.0] * 5), (74, []), (75, [1000.0, 1000.0])]
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], "vec_id long, embedding array<double>, n int, x string").repartition(5)
    compare([tuple(r) for r in whitening.whiten(df).collect()], rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_no_variance(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


def test_fewer_components(spark):
    rows = [(i, [float(i), 2.0 * i, 0.0, float(i * i % 7)]) for i in range(30)]
    got = [tuple(r) for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert {r[1] for r in got} == {1, 2}
    compare(got, rows)


def test_too_large(spark):
    df = spark.createDataFrame([(1, [1e300]), (2, [0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 2"):
        whitening.whiten(df).collect()


def test_sums_of_outer_products_are_exact_where_doubles_are_not():
    rng = np.random.default_rng(1)
    a = rng.integers(-(1 << 60), 1 << 60, (5000, 3))
    total = whitening.Sums(3, 3)
    whitening.add_outer(total, a)
    exact = a.astype(object).T @ a.astype(object)
    for i in range(3):
        for j in range(3):
            got = Fraction(total.high[i, j]) + Fraction(total.low[i, j])
            assert abs(got - int(exact[i, j])) <= Fraction(2) ** -100 * abs(int(exact[i, j])) * 2**10
    small = rng.integers(-(1 << 20), 1 << 20, (5000, 3))
    total = whitening.Sums(3, 3)
    whitening.add_outer(total, small)
    assert (total.high.astype(object) + total.low.astype(object) == small.astype(object).T @ small.astype(object)).all()


@pytest.mark.parametrize("most", [10, 1 << 30, 1 << 45, (1 << 62) - 1])
def test_squares(most):
    a = np.random.default_rng(most % 97).integers(-most, most + 1, (20, 5))
    assert [int(x) for x in whitening.squares(a, most).to_pylist()] == [sum(int(c) ** 2 for c in row) for row in a]


def test_error_free_transformations():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=200), rng.normal(size=200) * 1e9
    for x, y, (p, e), (s, r) in zip(a, b, zip(*whitening.two_product(a, b), strict=True), zip(*whitening.two_sum(a, b), strict=True), strict=True):
        assert Fraction(x) * Fraction(y) == Fraction(p) + Fraction(e)
        assert Fraction(x) + Fraction(y) == Fraction(s) + Fraction(r)
