"""Operator 12: embedding whitening with a compensated covariance.

Vectors are whole numbers x. With n distinct ones and their sums S, n * x - S is a centred vector (times n) without
any rounding. Its digits are cut into slices that are small enough for products and sums over a block of rows to be
exact in doubles (an error-free transformation of the matrix product), and blocks are added in double-double: a high
part and what rounding took from it, by two-sum. Tasks hand on both parts, row by row of the matrix, and these are
added in double-double again. The eigenvectors of that matrix, which is the driver's (dim x dim numbers), come from
LAPACK's syevd: reduction to tridiagonal form, then divide and conquer.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames
from .frames import Scratch, column
from .topk import matrix

#: Vectors' scale, components that are returned.
SCALE, COMPONENTS = 256, 4
#: Rows of a block and bits of a slice: a slice is at most 2^20 in size, so a block's sum of products is at most 2^51.
ROWS, SLICE = 2048, 21
#: Bits of a limb of an exact sum of squares.
LIMB = 24
#: The largest centred vector's entry in size.
LARGEST = 1 << 62
#: Share of the whole variance under which a component counts as none.
NOTHING = 1e-13


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b as its rounded value and the rest, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a * b as its rounded value and the rest, exactly, by halves of 26 bits."""

    def halves(x):
        c = x * 134217729.0
        high = c - (c - x)
        return high, x - high

    p = a * b
    (a1, a2), (b1, b2) = halves(a), halves(b)
    return p, ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2


class Sums:
    """Sums of arrays of one shape in double-double."""

    def __init__(self, *shape: int):
        self.high, self.low = np.zeros(shape), np.zeros(shape)

    def add(self, high: np.ndarray, low: np.ndarray | float = 0.0) -> None:
        s, e = two_sum(self.high, high)
        self.high, self.low = two_sum(s, e + (self.low + low))


def sliced(a: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as slices of SLICE bits, lowest first: a = sum of slice k times 2^(SLICE * k), each slice at most 2^(SLICE - 1) in size."""
    out, half = [], np.int64(1 << (SLICE - 1))
    while a.any() or not out:
        low = ((a + half) & np.int64((1 << SLICE) - 1)) - half
        out.append(low.astype(np.float64))
        a = (a - low) >> np.int64(SLICE)
    return out


def add_outer(sums: Sums, a: np.ndarray) -> None:
    """Add the outer products of the rows of a (whole numbers). Each product of slices is exact; so is the scaling by a power of two."""
    for at in range(0, len(a), ROWS):
        parts = sliced(a[at : at + ROWS])
        for i, one in enumerate(parts):
            for j in range(i + 1):
                product = one.T @ parts[j]
                if i != j:
                    product = product + product.T
                sums.add(np.ldexp(product, SLICE * (i + j)))


def squares(a: np.ndarray, most: int) -> pa.Array:
    """The exact sum of squares of each row, as decimals. most: the largest entry in size."""
    if a.shape[1] * most * most < 1 << 63:
        return pa.array((a * a).sum(axis=1)).cast(pa.decimal128(38, 0))
    mask = np.int64((1 << LIMB) - 1)
    x, y, z = a & mask, (a >> np.int64(LIMB)) & mask, a >> np.int64(2 * LIMB)
    terms = [(x * x, 0), (2 * x * y, 1), (y * y + 2 * x * z, 2), (2 * y * z, 3), (z * z, 4)]
    sums = [(t.sum(axis=1).tolist(), 1 << (LIMB * k)) for t, k in terms]
    return pa.array([Decimal(sum(s[r] * f for s, f in sums)) for r in range(len(a))], pa.decimal128(38, 0))


def quantised(vectors: DataFrame, vector: str, scale: int) -> DataFrame:
    """vectors with x: each entry c as floor(scale * c), a long. Without the rows whose vector is null or holds a null or non-finite entry."""
    v = frames.named(vector).cast("array<double>")
    rows = vectors.where(v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    fits = F.forall(v, lambda c: F.abs(c * F.lit(float(scale))) < F.lit(float(1 << 53)))
    v = F.when(fits, v).otherwise(F.raise_error(F.lit(f"an entry times {scale} is beyond 2^53")).cast("array<double>"))
    return rows.select("*", F.transform(v, lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("x"))


def merged(parts: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The sums of rows (i, high, low) of many tasks by i, in double-double: a row for each i at the driver."""

    def run(batches):
        held: dict[int, Sums] = {}
        for batch in batches:
            for i, high, low in zip(*(column(batch, c).to_pylist() for c in ("i", "high", "low")), strict=True):
                held.setdefault(i, Sums(len(high))).add(np.array(high), np.array(low))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), *(pa.array([list(getattr(s, c)) for s in held.values()], pa.list_(pa.float64())) for c in ("high", "low"))], ["i", "high", "low"])

    return {r.i: (np.array(r.high), np.array(r.low)) for r in parts.repartition("i").mapInArrow(run, parts.schema).collect()}


def rows_of(sums: Sums) -> pa.RecordBatch:
    """The rows of a matrix of sums, numbered."""
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums.high)), pa.int32()), *(pa.array(list(x), pa.list_(pa.float64())) for x in (sums.high, sums.low))], ["i", "high", "low"])


PARTS = "i int, high array<double>, low array<double>"


def fitted(fit: DataFrame, dim: int) -> tuple[int, list[int], int]:
    """The number of vectors (x), the sums by dimension, and the largest entry in size."""

    def run(batches):
        n, most, sums = 0, 0, [0] * dim
        for batch in batches:
            x = matrix(column(batch, "x"), dim)
            if len(x):
                n, most = n + len(x), max(most, int(np.abs(x).max(initial=0)))
                # halves, so that no sum of a batch passes 64 bits
                sums = [s + (h << 27) + lo for s, h, lo in zip(sums, (x >> np.int64(27)).sum(axis=0).tolist(), (x & np.int64((1 << 27) - 1)).sum(axis=0).tolist(), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(map(Decimal, sums), pa.decimal128(38, 0)), pa.array([n] * dim), pa.array([most] * dim)], ["i", "s", "n", "most"])

    found = fit.mapInArrow(run, "i int, s decimal(38,0), n long, most long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("most").alias("most")).collect()
    found.sort(key=lambda r: r.i)
    return found[0].n, [int(r.s) for r in found], found[0].most


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row with a sound vector and each component.

    The fit list holds each distinct x once; n, the mean and the covariance are those of the list. deviation is
    the exact sum of (n * x - S)^2, a decimal; whitened the projection on a unit eigenvector over the root of its
    eigenvalue; explained its share of the variance; identity_error the largest entry of the whitened list's
    covariance minus the identity, measured on the whitened values.

    Null ids stay, repeated rows stay; other columns are left out. Shorter vectors count as filled up with zeros.
    There are fewer components where the vectors have fewer dimensions or no variance in more; without any
    variance (one distinct vector, say) or any vector there are no rows. Of equal eigenvalues any basis is taken.
    An entry whose product with the scale passes 2^53, or a list so large that n * x - S passes 62 bits, is an error.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    rows = quantised(vectors.select(frames.named(id_col).alias("id"), frames.named(vector).alias("v")), "v", scale).select("id", "x")
    out = f"`{id_col.replace('`', '``')}` {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    sizes = rows.agg(F.max(F.size("x")).alias("most"), F.min(F.size("x")).alias("least")).first()
    dim = sizes.most or 0
    if not dim:
        return spark.createDataFrame([], out)
    filled = F.col("x") if sizes.least == dim else F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("x")))
    fit = scratch.written(rows.select(filled.alias("x")).distinct(), "fit")
    n, sums, most = fitted(fit, dim)
    reach = n * most + max(map(abs, sums))  # of n * x - S
    if reach >= LARGEST:
        raise ValueError("these vectors, times their number, don't fit 62 bits")
    s = np.array(sums, np.int64)

    def centred(lists: pa.Array) -> np.ndarray:
        return n * matrix(lists, dim) - s

    def cover(batches):
        total = Sums(dim, dim)
        for batch in batches:
            add_outer(total, centred(column(batch, "x")))
        yield rows_of(total)

    found = merged(fit.mapInArrow(cover, PARTS))
    high, low = (np.array([found[i][k] for i in range(dim)]) for k in (0, 1))
    covariance = (high + low) / float(n) / float(n) / float(n)
    values, axes = np.linalg.eigh(covariance)
    values, axes, trace = values[::-1], axes[:, ::-1], float(np.trace(covariance))
    used = int((values[:components] > NOTHING * trace).sum()) if trace > 0 else 0
    if not used:
        scratch.drop(fit)
        return spark.createDataFrame([], out)
    project = axes[:, :used] / np.sqrt(values[:used]) / float(n)
    explained = values[:used] / trace

    def check(batches):
        total = Sums(used + 1, used)  # the products of each two components, and at the end their sums
        for batch in batches:
            w = centred(column(batch, "x")).astype(np.float64) @ project
            for row in range(0, len(w), ROWS):
                part = w[row : row + ROWS]
                high, low = two_product(part[:, :, None], part[:, None, :])
                high, low = np.concatenate([high, part[:, None, :]], axis=1), np.concatenate([low, np.zeros((len(part), 1, used))], axis=1)
                while len(high) > 1:  # halves onto each other
                    if len(high) % 2:
                        high, low = np.concatenate([high, np.zeros((1, *high.shape[1:]))]), np.concatenate([low, np.zeros((1, *low.shape[1:]))])
                    half = len(high) // 2
                    total_high, rest = two_sum(high[:half], high[half:])
                    high, low = total_high, rest + low[:half] + low[half:]
                if len(high):
                    total.add(high[0], low[0])
        yield rows_of(total)

    found = merged(fit.mapInArrow(check, PARTS))
    products = np.array([(found[i][0] + found[i][1]) / n for i in range(used + 1)])
    error = float(np.abs(products[:used] - np.outer(products[used], products[used]) - np.eye(used)).max())
    scratch.drop(fit)

    def apply(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                a = centred(column(part, "x"))
                each = np.repeat(np.arange(len(a)), used)
                constant = lambda v, kind: pa.array(np.full(len(each), v), kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        column(part, "id").take(pa.array(each)), pa.array(np.tile(np.arange(1, used + 1), len(a)), pa.int32()), constant(n, pa.int64()), squares(a, reach).take(pa.array(each)),
                        pa.array((a.astype(np.float64) @ project).ravel()), pa.array(np.tile(explained, len(a))), constant(error, pa.float64()),
                    ],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(apply, out)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened on four components. (A deviation beyond 64 bits is an error here, not in `whiten`.)"""
    return whiten(frames.table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
