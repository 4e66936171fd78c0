"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it's written as Parquet and read again as the
next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlens.llm import bpe, decontaminate, frames, jaccard_join, langid, line_dedup

#: Mean posterior that a document's language needs.
LEAST_SCORE = 0.5


def wrapped(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text): the documents' other columns in one struct, so that no name of theirs clashes with an operator's. The text isn't in it: each copy would go to the Python workers and back."""
    return docs.select(F.struct(*[frames.named(c).alias(c) for c in docs.columns if c != "text"]).alias("doc"), "doc_id", "text")


def unwrapped(rows: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    changed = {"text": F.col("text")} | changed
    return rows.select(*[changed[c] if c in changed else F.col("doc")[c] for c in names]).toDF(*names)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are of one language for the most part. Texts that are null or without a letter go, and texts in which no language has LEAST_SCORE."""
    model = langid.fit(docs, F.lit(True))
    seen = langid.detect(wrapped(docs), model)
    return unwrapped(seen.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line resembles; documents of which nothing is left go. n_chars follows the text."""
    left = line_dedup.dedup_lines(wrapped(docs))
    left = left.where((F.col("n_kept") == F.col("n_lines")) | (F.btrim("text", F.lit(line_dedup.BLANK + "\n")) != ""))
    return unwrapped(left, docs.columns, n_chars=F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest id. Rows of the same id and text are one document."""
    rows = wrapped(docs).withColumn("row", line_dedup.row_key("doc_id", "text"))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row")
    groups = jaccard_join.near_duplicates(rows.select(key.alias("id"), "text"), id_col="id")
    firsts = frames.written(groups.where(F.col("id") == F.col("component_id")).select(F.col("id.row").alias("row")).distinct(), "firsts")
    return unwrapped(rows.join(firsts, "row", "left_semi").dropDuplicates(["row"]), docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands."""
    return unwrapped(decontaminate.decontaminate(wrapped(docs), frames.table(spark, sf_dir, "benchmark")), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number and digest of each document's ids, and the digest of what they decode to."""
    return bpe.round_trip(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("tokens", tokens)]

#: MinHash candidates, hashes and merges can't be said in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of sf_dir."""
    docs = frames.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = frames.written(docs, f"stage-{name}")
    return docs
