"""Operator 7: token ids in binary segments whose document boundaries are Elias-Fano encoded.

A dataset is a Parquet folder; each row is a segment of whole documents in ascending key order:
stripe, seq (segments are ordered by both), n_docs, n_ids, width (bytes of an id), ids (all ids one after the
other, little-endian), ends (Elias-Fano: where each document ends), n_null (documents without key, first),
base and keys (Elias-Fano of key - base). Parquet's commit makes a write atomic, on any file system.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import frames
from .elias_fano import EliasFano, pack
from .frames import column, pieces
from .library import encoder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
#: Ids after which a segment is closed.
SEGMENT_IDS = 2 << 20
#: Keys of a segment are less than this apart, so that what is encoded of them fits a signed long.
REACH = 1 << 62
SEGMENT = "stripe int, seq int, n_docs long, n_ids long, width int, ids binary, ends binary, n_null long, base long, keys binary"


def write(docs: DataFrame, path: str, *, id_col: str = "doc_id", text: str = "text", tokenizer_path: str = TOKENIZER, end_id: int | None = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode the texts and write them to path in ascending order of an integer id_col.

    Texts are dealt out by ranges of the key and sorted by (key, text) in each, so tasks hold one segment of
    ids at a time, however the keys are spread. Null and empty texts have the end id alone; null keys come
    first; repeated rows are kept; other columns are not looked at; no rows make a dataset without segments.
    """
    rows = docs.select(frames.named(id_col).cast("long").alias("key"), frames.named(text).cast("string").alias("text"))

    def run(batches):
        use = encoder(tokenizer_path)
        width = 2 if use.width == 2 and (end_id or 0) < 1 << 16 else 4
        kind = f"<u{width}"
        stripe, seq = TaskContext.get().partitionId(), 0
        keys, nulls, ids, counts, held = [], 0, [], [], 0

        def close():
            n = np.concatenate(counts)
            k = np.concatenate(keys)
            base = int(k[0]) if len(k) else 0
            return pa.RecordBatch.from_pylist(
                [{"stripe": stripe, "seq": seq, "n_docs": len(n), "n_ids": int(n.sum()), "width": width, "ids": np.concatenate(ids).tobytes(), "ends": pack(np.cumsum(n)), "n_null": nulls, "base": base, "keys": pack(k - base)}],
                schema=pa.schema([("stripe", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("ends", pa.binary()), ("n_null", pa.int64()), ("base", pa.int64()), ("keys", pa.binary())]),
            )

        for part in (x for piece in pieces(batches, "text") for x in within_reach(piece)):
            own = column(part, "key").drop_null()
            if len(own) and any(map(len, keys)) and own[-1].as_py() - int(next(k for k in keys if len(k))[0]) >= REACH:
                yield close()
                seq += 1
                keys, nulls, ids, counts, held = [], 0, [], [], 0
            got, n = use.encode(column(part, "text").fill_null("").to_pylist())
            if end_id is not None:
                got, n = np.insert(got, np.cumsum(n), end_id), n + 1
            key = column(part, "key")
            nulls += key.null_count
            keys.append(key.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
            ids.append(got.astype(kind))
            counts.append(n)
            held += len(got)
            if held >= segment_ids:
                yield close()
                seq += 1
                keys, nulls, ids, counts, held = [], 0, [], [], 0
        if counts:
            yield close()

    by = F.col("key").asc_nulls_first()
    # the beginning of a text spreads the rows of one key, in the order of whole texts
    dealt = rows.repartitionByRange(by, F.substring("text", 1, 64)).sortWithinPartitions(by, "text")
    frames.write(dealt.mapInArrow(run, SEGMENT), path)


def within_reach(part: pa.RecordBatch):
    """Rows, sorted by key, in slices whose keys are less than REACH apart."""
    keys, at = column(part, "key"), 0
    nulls = keys.null_count  # null keys come first
    while at < part.num_rows:
        first = max(at, nulls)
        to = part.num_rows
        if first < to and keys[to - 1].as_py() - keys[first].as_py() >= REACH:
            to = first + int(np.searchsorted(keys[first:].to_numpy(), keys[first].as_py() + REACH - 1, "right")) if keys[first].as_py() < (1 << 63) - REACH else to
        yield part.slice(at, to - at)
        at = to


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with `first`, the number of ids in all segments before. Sums per stripe (a row for each task of the write) are summed in one place, the rest within stripes."""
    segs = spark.read.schema(SEGMENT).parquet(path)
    stripes = segs.groupBy("stripe").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
    stripes = stripes.select("stripe", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("stripe_first"))
    within = Window.partitionBy("stripe").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    heads = segs.select("stripe", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("within"))
    firsts = heads.join(stripes, "stripe").select("stripe", "seq", (F.col("stripe_first") + F.col("within")).alias("first"))
    return segs.join(frames.small(firsts), ["stripe", "seq"])  # a row for each segment of about SEGMENT_IDS ids


class Segment:
    """One segment in memory: random access through select."""

    def __init__(self, row):
        self.ids = np.frombuffer(row["ids"], f"<u{row['width']}")
        self.ends, self.keys = EliasFano(row["ends"]), EliasFano(row["keys"])
        self.n_docs, self.n_null, self.base = row["n_docs"], row["n_null"], row["base"]

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the segment."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def key(self, i: int) -> int | None:
        return None if i < self.n_null else self.base + self.keys.select(i - self.n_null)


def read(spark: SparkSession, path: str, *, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """A row for each document, from the files alone: its key, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and, with_ids, its ids."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row)
                ends = segment.ends.all()
                starts = np.append(0, ends[:-1]) if len(ends) else ends
                wide = segment.ids.astype("<u4")
                keys = [None] * row["n_null"] + (segment.keys.all() + row["base"]).tolist()
                cols = [pa.array(keys, pa.int64()), pa.array(starts + row["first"]), pa.array(ends - starts), pa.array([zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())]
                names = [id_col, "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(wide.astype(np.int64))))
                    names.append("ids")
                out = pa.RecordBatch.from_arrays(cols, names)
                yield from (out.slice(at, 4096) for at in range(0, out.num_rows, 4096))

    kinds = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return segments(spark, path).select("width", "n_docs", "ids", "ends", "n_null", "base", "keys", "first").mapInArrow(run, kinds)


def lookup(spark: SparkSession, path: str, wanted: list[int], *, id_col: str = "doc_id") -> DataFrame:
    """(id, start, ids) of the documents of some ids (a list as long as a message to all workers may be), by select: a binary search among a segment's keys and one look at its boundaries, with nothing else decoded."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                segment, found = Segment(row), []
                for key in wanted:
                    low, high = segment.n_null, segment.n_docs
                    while low < high:
                        middle = (low + high) // 2
                        low, high = (middle + 1, high) if segment.key(middle) < key else (low, middle)
                    while low < segment.n_docs and segment.key(low) == key:
                        found.append((key, row["first"] + (segment.ends.select(low - 1) if low else 0), segment.document(low).tolist()))
                        low += 1
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.list_(pa.int64()))], ["id", "start", "ids"])

    rows = segments(spark, path).where(F.col("n_docs") > F.col("n_null")).where(F.col("base") <= max(wanted, default=0))
    return rows.select("width", "n_docs", "ids", "ends", "n_null", "base", "keys", "first").mapInArrow(run, "id long, start long, ids array<long>").withColumnRenamed("id", id_col)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as binary segments and read back where each document lies and what its ids are."""
    path = frames.new_folder(spark, "token-files")
    write(frames.table(spark, sf_dir, "documents"), path)
    return read(spark, path, with_ids=False)
