"""Operator 13: source divergence audit, how the words of each source differ from those of others in its language.

Plain relational steps: terms are counted by language, source and term, within pieces of the texts first; a language
keeps the terms of enough documents; its groups (sources) are crossed with these, so that terms that a group lacks
stand there with zero; a join of that table with itself on language and term gives each two sources their
divergence, and a ranked window the terms that set a source apart. All arithmetic is on whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import frames
from .frames import Scratch
from .words import LOWER

#: Fixed value: the bytes of terms, [^\x00-\x40\x5B-\x60\x7B-\x7F]. (Those from 0x80 on all belong to terms, so runs of bytes are runs of characters.)
TERM = np.zeros(256, bool)
TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of whole texts whose terms are counted together.
PIECE_BYTES = 8 << 20
#: Documents that a kept term needs, ranks of the terms of a group, parts into which a language's terms are dealt when they are crossed with its groups.
LEAST_DOCS, TOP, DEALT = 10, 10, 64


def shares(count: str, size: str, kept: str) -> Column:
    """The smoothed share of a term in billionths, plus one, rounded down. (Decimals, as the product may pass 64 bits.)"""
    return F.expr(f"1 + cast(1000000000 as decimal(10, 0)) * cast({count} + 2 as decimal(20, 0)) div cast({size} + 2 * {kept} as decimal(20, 0))")


#: How far two shares are apart.
APART = "(p - q) * (p - q) div (p + q)"


def piece_counts(piece: pa.RecordBatch) -> pa.RecordBatch:
    """term_counts() of some whole texts, by array operations: a number for each term and group, and one sort of the occurrences by group, term and row."""
    data, offsets = frames.text_bytes(frames.column(piece, "text"))
    starts, ends, before = term_spans(data, offsets)
    places = np.concatenate([[0], np.cumsum(ends - starts)])
    terms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(LOWER[data[TERM[data]]])]).dictionary_encode()
    lang, source = (frames.column(piece, c).dictionary_encode() for c in ("lang", "source"))
    groups = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    n_terms, n_rows = len(terms.dictionary), piece.num_rows
    row = np.repeat(np.arange(n_rows), np.diff(before))
    found = np.sort((groups[row] * n_terms + terms.indices.to_numpy()) * n_rows + row)
    in_row = np.concatenate([[True], found[1:] != found[:-1]])[: len(found)]
    found //= n_rows
    at = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])[: len(found)])
    group, term = np.divmod(found[at], n_terms) if n_terms else (at, at)
    n, docs = np.diff(np.append(at, len(found))), np.add.reduceat(in_row, at, dtype=np.int64) if len(at) else at
    names = [x.dictionary.take(pa.array(i)).cast(pa.string()) for x, i in ((lang, group // len(source.dictionary)), (source, group % len(source.dictionary)), (terms, term))]
    return pa.RecordBatch.from_arrays([*names, pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all terms, and the number of terms before each text (one more than texts)."""
    inside = TERM[data]
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    some = offsets[1:] > offsets[:-1]  # terms don't go on from one text into the next
    heads, tails = offsets[:-1][some], offsets[1:][some] - 1
    head[heads], tail[tails] = inside[heads], inside[tails]
    starts = np.flatnonzero(head)
    return starts, np.flatnonzero(tail) + 1, np.searchsorted(starts, offsets)


def term_counts(rows: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): the occurrences of each term in a group, and the group's documents with it. What is shuffled has been summed over PIECE_BYTES of texts."""

    def counted(batches):
        for piece in frames.pieces(batches, "text", PIECE_BYTES):
            yield piece_counts(piece)

    sums = rows.select("text", "lang", "source").mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    return sums.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def crossed(groups: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Every group with every kept term of its language. The terms of a language are dealt into DEALT parts, and its groups go to each part, so that no task has a whole language."""
    parts = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    return vocabulary.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(DEALT)).cast("int")).join(parts, ["lang", "part"]).drop("part")


def divergence(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its divergence from each other source of the language (part `pair`, all of them), and the terms that are most above the language's share (part `term`, the first `top`).

    Null texts, languages and sources count as ''. Every row is a document, repeated rows too. A group without
    terms has all counts zero; a language without kept terms has pairs of value 0 and no terms; one with a single
    source has no pairs. Ties go to the smaller item (by UTF-8 bytes). Other columns are left out; an empty table
    gives an empty one. Of a very long text no more than its own row is in memory.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    name = lambda c: F.coalesce(frames.named(c).cast("string"), F.lit(""))
    rows = docs.select(name(text).alias("text"), name(lang).alias("lang"), name(source).alias("source"))
    counts = scratch.written(term_counts(rows), "counts")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    vocabulary = scratch.written(vocabulary.drop("docs"), "vocabulary")
    kept = scratch.written(counts.drop("docs").join(vocabulary.select("lang", "term"), ["lang", "term"], "left_semi"), "kept")
    scratch.drop(counts)
    groups = rows.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("own")), ["lang", "source"], "left")
    groups = groups.join(vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("every")), "lang", "left")
    groups = scratch.written(groups.na.fill(0, ["own", "kept", "every"]), "groups")
    dense = crossed(groups, vocabulary).join(kept, ["lang", "source", "term"], "left").na.fill(0, ["n"])
    dense = scratch.written(dense.select("lang", "source", "term", "n", shares("n", "own", "kept").alias("p"), shares("total", "every", "kept").alias("q")), "dense")
    scratch.drop(vocabulary, kept)

    one, other = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    pairs = one.join(other, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.expr(APART)).alias("value"))
    bare = groups.where("kept = 0").select("lang", "source")  # sources of languages without kept terms
    pairs = pairs.unionByName(bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source < item").withColumn("value", F.lit(0).cast("long")))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = scratch.written(pairs.select("lang", both.alias("s"), "value").select("lang", "s.source", "s.item", "value"), "pairs")
    terms = dense.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), F.expr(APART).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    ranked = lambda part, rows: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank)
    out = frames.written(ranked("pair", pairs).unionByName(ranked("term", terms).where(F.col("rank") <= top)), "divergence")
    scratch.drop(groups, dense, pairs)
    return out


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of all documents against the others of their language."""
    return divergence(frames.table(spark, sf_dir, "documents"))


#: op13_source_divergence in DuckDB.
SQL = r"""WITH d AS (
 SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT row, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL),
v AS (SELECT lang, term, count(*) AS total FROM o GROUP BY ALL HAVING count(DISTINCT row) >= 10),
l AS (SELECT lang, count(*) AS kept, sum(total) AS every FROM v GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(n) AS own FROM c JOIN v USING (lang, term) GROUP BY 1, 2),
e AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
  1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.own, 0) + 2 * l.kept) AS p, 1 + (1000000000::HUGEINT * (v.total + 2)) // (l.every + 2 * l.kept) AS q
  FROM g JOIN v USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
b AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM e x JOIN e y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(b.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN b ON b.lang = x.lang AND b.source = x.source AND b.item = y.source
 UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM e WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 10"""
