"""Operator 4: exact top-k search by distributed histogram selection.

Every pass scores all candidates against a block of queries. The first passes only count: each task makes a
histogram of the scores of each query, the histograms are summed, and the bin that holds the kth score is cut
into bins again, until it is one score or few rows reach it. The last pass keeps what reaches that bin, and of
equal scores at the edge the smallest ids.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import frames
from .frames import column

#: Queries that are sent to all workers at once, bins of a histogram, and candidates that are scored in one step.
QUERY_BLOCK, BINS, STEP = 2048, 128, 512
#: Counting ends when no query has more rows than this at or over its edge, besides k.
SLACK = 44


def prepared(vectors: DataFrame, *, id_col: str, vector: str, scale: int) -> DataFrame:
    """(id, v): each component x as floor(scale * x), x as a double. Left out: null ids, and vectors that are null, empty, or hold a null or non-finite component. Rows of one id count once (the least vector)."""
    x = F.col(f"`{vector}`").cast("array<double>")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull()).where(fine)
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of lists, shorter ones filled with zeros."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (n == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(n), dim), flat.dtype)
    out[np.repeat(np.arange(len(n)), n), frames.ragged(np.zeros(len(n), np.int64), n)] = flat
    return out


class Scorer:
    """Scores of a block of queries, in the cheapest arithmetic that is exact. largest: the largest component of all vectors in size."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, largest: int):
        self.ids, self.dim = ids, queries.shape[1]
        bound = self.dim * largest * int(np.abs(queries).max(initial=0))
        self.kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
        self.queries = queries.astype(self.kind)

    def steps(self, batches):
        """(candidate ids, scores by query and candidate, which of these are a query and itself) of STEP candidates at a time."""
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                ids = column(part, "id").to_numpy()
                scores = self.queries @ matrix(column(part, "v"), self.dim).astype(self.kind).T
                place = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
                own = np.flatnonzero(self.ids[place] == ids)
                yield ids, scores, (place[own], own)


def select_block(candidates: DataFrame, queries: DataFrame, k: int, largest: int, bins: int) -> DataFrame | None:
    """The k best of each query of a block, None if the block has no query."""
    got = queries.collect()  # QUERY_BLOCK bounds it, but for chance
    if not got:
        return None
    spark = candidates.sparkSession
    got.sort(key=lambda r: r.id)
    dim = candidates.agg(F.max(F.size("v"))).first()[0]
    ids, block = np.array([r.id for r in got], np.int64), np.zeros((len(got), dim), np.int64)
    for i, r in enumerate(got):
        block[i, : len(r.v)] = r.v
    sums = [sum(abs(x) for x in row) for row in block.tolist()]
    if largest * max(sums) >= (1 << 62) - 1:
        raise ValueError("inner products of these vectors don't fit 64-bit integers")
    reach = np.array([largest * x + 1 for x in sums], np.int64)  # no score of the query is larger in size
    low, high, width = -reach, reach + 1, -(-(2 * reach + 1) // bins)
    wanted, over = np.full(len(ids), k), np.zeros(len(ids), np.int64)  # of the bins at hand; rows at or over `low`
    scorer = spark.sparkContext.broadcast((ids, block, largest))
    open_ = np.ones(len(ids), bool)
    while open_.any():
        state = spark.sparkContext.broadcast((low, high, width, open_))

        def count(batches, scorer=scorer, state=state):
            use, (low, high, width, open_) = Scorer(*scorer.value), state.value
            rows = np.flatnonzero(open_)
            use.queries = use.queries[rows]
            back = np.full(len(open_), -1)
            back[rows] = np.arange(len(rows))
            total = np.zeros(len(rows) * bins, np.int64)
            whole = use.kind is np.int64  # floats would round these scores
            lows, highs, widths = (x[rows].astype(np.int64 if whole else np.float64)[:, None] for x in (low, high, width))
            first = np.arange(len(rows))[:, None] * bins
            for _, scores, (q, c) in use.steps(batches):
                place = (scores - lows) // widths if whole else np.floor((scores - lows) / widths)
                inside = (place >= 0) & (scores < highs)
                mine = back[q] >= 0
                inside[back[q[mine]], c[mine]] = False
                total += np.bincount((place + first)[inside].astype(np.int64), minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(rows[some // bins]), pa.array((some % bins).astype(np.int64)), pa.array(total[some])], ["q", "bin", "n"])

        counted = candidates.mapInArrow(count, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.col("bin").desc())
        edges = counted.withColumn("sum", F.sum("n").over(down))
        need = spark.createDataFrame([(int(q), int(wanted[q])) for q in np.flatnonzero(open_)], "q long, wanted long")
        edges = edges.join(F.broadcast(need), "q").where((F.col("sum") >= F.col("wanted")) & (F.col("sum") - F.col("n") < F.col("wanted")))
        found = {r.q: r for r in edges.collect()}  # a row for each query of the block
        for q in np.flatnonzero(open_).tolist():
            r = found.get(q)
            if r is None:  # fewer than k candidates: all of them
                open_[q] = False
                continue
            low[q] += r.bin * width[q]
            high[q] = min(high[q], low[q] + width[q])
            over[q] = k - wanted[q] + r.sum
            wanted[q] -= r.sum - r.n
            if width[q] == 1 or over[q] <= k + SLACK:
                open_[q] = False
            else:
                width[q] = -(-width[q] // bins)
        state.unpersist()
    tied = (width == 1) & (over > k + SLACK)
    final = spark.sparkContext.broadcast((low, np.where(tied, wanted, 0)))

    def keep(batches):
        use, (low, ties) = Scorer(*scorer.value), final.value
        for at, scores, (q, c) in use.steps(batches):
            reached = scores >= low[:, None]
            reached[q, c] = False
            query, place = np.nonzero(reached)
            value = scores[query, place].astype(np.int64)
            edge = (ties[query] > 0) & (value == low[query])
            if edge.any():  # of a step's rows at the edge no more than are wanted altogether, the smallest ids
                order = np.lexsort((at[place], ~edge, query))
                query, place, value, edge = query[order], place[order], value[order], edge[order]
                head = np.searchsorted(query, query, "left")
                ok = ~edge | (np.arange(len(query)) - head < ties[query])
                query, place, value = query[ok], place[ok], value[ok]
            yield pa.RecordBatch.from_arrays([pa.array(use.ids[query]), pa.array(at[place]), pa.array(value)], ["query_id", "vec_id", "score"])

    rows = candidates.mapInArrow(keep, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector: str = "embedding", query_block: int = QUERY_BLOCK, bins: int = BINS) -> DataFrame:
    """The k largest integer inner products of each query (rows for which is_query holds) with all other rows; ties go to the smaller id; all candidates if there are fewer.

    Shorter vectors count as filled up with zeros. Queries are taken in blocks, each scored against all
    candidates; nothing but a block of queries and its edges is at the driver. See `prepared` for nulls and
    repeated rows. No query or no candidate gives no row. Scores must fit 63 bits.
    """
    spark = vectors.sparkSession
    if k < 1 or bins < 2:
        raise ValueError("k >= 1 and bins >= 2 are needed")
    rows = prepared(vectors, id_col=id_col, vector=vector, scale=scale)
    chosen = vectors.where(is_query & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id")).distinct()
    all_rows = frames.written(rows, "vectors")
    chosen = frames.written(all_rows.join(chosen, "id", "left_semi"), "queries")
    n, most = chosen.count(), all_rows.agg(F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))).first()[0]
    blocks = -(-n // query_block)
    # blocks by a hash differ in size by chance, so they are made a little smaller
    parts = [chosen] if blocks <= 1 else [chosen.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i) for i in range(blocks)]
    found = [x for p in parts if n and (x := select_block(all_rows, p, k, int(most), bins)) is not None]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if len(found) > 4:
        found = [frames.written(x, "top") for x in found]
    return reduce(DataFrame.unionByName, found)


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every embedding whose vec_id is divisible by 20, among all others."""
    return top_k(frames.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL = {
    "op4_top_k": """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id % 20 = 0 AND q.id <> c.id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
""",
}
