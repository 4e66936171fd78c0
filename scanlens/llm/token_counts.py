"""Operator 2: token counts through a digest cache.

The cache is a Parquet table (content, tokenizer, n_tokens): the SHA-256 of a text and that of the tokenizer
file to a stored count. Only distinct texts that the cache lacks are encoded, and their counts are appended.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames
from .frames import column, pieces
from .library import encoder, file_digest

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LIMIT = 512
CACHE = "content string, tokenizer string, n_tokens long"


def whole(text: Column) -> Column:
    """The normalised content: the text itself, null as empty. (Anything stronger would change the counts.)"""
    return F.coalesce(text, F.lit(""))


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The cache at path, None if nothing has been written there."""
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def count_tokens(docs: DataFrame, cache_path: str, *, tokenizer_path: str = TOKENIZER, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs without its text, with n_bytes, n_tokens and over_limit (n_tokens > limit).

    cache_path: a folder in shared storage; made at the first use, appended to later. Copies are put together
    by digest before and after the shuffle, so a text that fills a third of the table is encoded once. Null
    texts count as empty ones (0 tokens); all rows stay, repeated ones too; ids aren't looked at; an empty
    table gives an empty table. An append is one Spark job: if it fails nothing of it is seen. Runs that append
    the same digests at once, first runs too, leave equal entries, which are read as one.
    """
    spark, version = docs.sparkSession, file_digest(tokenizer_path)
    body = whole(frames.named(text))
    content = F.sha2(body.cast("binary"), 256).alias("content")
    append_misses(docs.select(content, body.alias("body")), cache_path, tokenizer_path)
    stored = read_cache(spark, cache_path)
    stored = stored.where(F.col("tokenizer") == version).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))
    own = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    # the documents' columns are in one struct, so that no name of theirs can clash with ours
    narrow = docs.select(F.struct(*[frames.named(c) for c in own]).alias("doc"), F.octet_length(body).cast("long").alias("n_bytes"), content)
    out = narrow.join(stored, "content", "left")
    return out.select(*[F.col("doc")[c].alias(c) for c in own], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def missing(texts: DataFrame, cache_path: str, version: str) -> DataFrame:
    """(content, body): the distinct texts that the cache lacks for a tokenizer."""
    distinct = texts.groupBy("content").agg(F.first("body").alias("body"))
    known = read_cache(texts.sparkSession, cache_path)
    return distinct if known is None else distinct.join(known.where(F.col("tokenizer") == version).select("content"), "content", "left_anti")


def append_misses(texts: DataFrame, cache_path: str, tokenizer_path: str = TOKENIZER) -> None:
    """Encode those of the texts (content, body) that the cache lacks, and append their counts to it."""
    version = file_digest(tokenizer_path)

    def run(batches):
        use = encoder(tokenizer_path)
        for part in pieces(batches, "body"):
            content, counts = column(part, "content"), pa.array(use.count(column(part, "body").to_pylist()))
            yield pa.RecordBatch.from_arrays([content, pa.array([version] * part.num_rows, pa.string()), counts], ["content", "tokenizer", "n_tokens"])

    counted = missing(texts, cache_path, version).mapInArrow(run, CACHE)
    counted.write.mode("append").parquet(cache_path)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, by a cache that is new for this call: a first call fills it with the texts whose digest begins with 0 to 7, a second one, on all documents, finds these there and encodes the rest."""
    docs, cache = frames.table(spark, sf_dir, "documents").select("doc_id", "text"), frames.new_folder(spark, "token-cache")
    body = whole(F.col("text"))
    texts = docs.select(F.sha2(body.cast("binary"), 256).alias("content"), body.alias("body"))
    append_misses(texts.where(F.col("content") < "8"), cache)
    return count_tokens(docs, cache)
