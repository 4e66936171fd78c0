"""Operator 11: MinHash near-dedup with tensored banding.

A table's key of four minima would take four hash functions a table. Here small collections of HALVES keys of
ROWS minima each are made, and every two of a collection make the key of a table: 45 tables from 36 hash functions
instead of 180. (One collection of all halves would be a table for every two of them, 153: more to shuffle, for a
chance that is small already.) Two sets are candidates if they agree in two halves of a collection. At the
threshold, 0.8, a half agrees with 0.64, fewer than two of six with 0.025, and so in all three collections with
1.6e-5; that is the chance of not looking at a pair there.

Candidates go the way of the n-gram Jaccard join: bit sketches rule pairs out, the full sets confirm the rest, and
keys whose members are still of different components have all of these compared, so no link depends on which
member of a key came first. Components of links are the classes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames, jaccard_join
from .jaccard_join import COMPONENTS_SQL, PERCENT
from .pretoken import mix

#: Words of a shingle, collections, halves of each, minima of a half.
SIZE, COLLECTIONS, HALVES, ROWS = 2, 3, 6, 2
TABLES = COLLECTIONS * HALVES * (HALVES - 1) // 2


def factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """What the hash functions XOR with and multiply by (odd)."""
    return mix(np.arange(1, n + 1, dtype=np.uint64)), mix(np.arange(n + 1, 2 * n + 1, dtype=np.uint64)) | np.uint64(1)


def half_keys(values: np.ndarray, firsts: np.ndarray, halves: int = COLLECTIONS * HALVES, rows: int = ROWS) -> np.ndarray:
    """The collections of sets that aren't empty (rows) as numbers (columns): each mixes `rows` minima of the shingle hashes."""
    flips, odds = factors(halves * rows)
    out = np.zeros((len(firsts) - 1, halves), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(halves * rows):
            least = np.minimum.reduceat((values ^ flips[k]) * odds[k], firsts[:-1])
            out[:, k // rows] = mix(out[:, k // rows] + mix(least + np.uint64(k)))
    return out


def tensor_keys(values: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of all tables, the set of each, and how many keys a set may leave out (none)."""
    docs = np.flatnonzero(np.diff(firsts))
    spare = np.zeros(len(firsts) - 1, np.int64)
    if not len(docs):
        return np.empty(0, np.uint64), np.empty(0, np.int64), spare
    n = np.diff(firsts)[docs]
    half = half_keys(values[frames.ragged(firsts[docs], n)], np.append(0, np.cumsum(n)))
    i, j = np.triu_indices(COLLECTIONS * HALVES, 1)
    i, j = i[i // HALVES == j // HALVES], j[i // HALVES == j // HALVES]
    with np.errstate(over="ignore"):
        table = mix((i * COLLECTIONS * HALVES + j).astype(np.uint64) + np.uint64(1))
        keys = mix(half[:, i] * np.uint64(0x9E3779B97F4A7C15) + mix(half[:, j] + table))
    return keys.ravel(), np.repeat(docs, len(i)), spare


def minhash_components(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Per row: the id, n_shingles, component_id (the smallest id that links reach) and kept (id = component_id).

    Nulls, empty and very long texts, ties, repeated rows and empty tables are as in jaccard_join.near_duplicates:
    rows without words are their own component (kept), rows of one text share one, a null id is a component's
    name (and kept) only if no other id is in it; repeated rows stay, and other columns aren't kept. Only a
    percent near the tables' one (70 to 100) finds its links with high probability; others are refused.
    """
    if not 70 <= percent <= 100:
        raise ValueError("these tables are made for a similarity of 70 to 100 percent")
    out = jaccard_join.near_duplicates(docs, id_col=id_col, text=text, size=size, percent=percent, keys=tensor_keys, keys_each=TABLES)
    return out.withColumn("kept", frames.named(id_col).eqNullSafe(F.col("component_id")))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of J >= 0.8 on 2-word shingles."""
    return minhash_components(frames.table(spark, sf_dir, "documents"))


#: op11_minhash_dedup in DuckDB.
SQL = f"SELECT *, doc_id = component_id AS kept FROM ({COMPONENTS_SQL.replace('{size}', str(SIZE))})"
