"""Small helpers that all operators share: shared folders, written tables, Arrow texts in bounded pieces."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step looks at; a longer single text is a step of its own.
PIECE_BYTES = 2 << 20
#: Rows (16 bytes or so) up to which a table whose rows have been counted is broadcast.
BROADCAST_ROWS = 1_000_000
#: Documents that Spark hands to a Python worker at once, at most, and its setting for that (10000 texts of some KB, on both sides and for each task, are a good part of an executor's memory).
ARROW_ROWS, ARROW_SETTING = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Spark's setting that deletes the shuffle files of a query at its end.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a local session gets one of our own; on a cluster that's an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: it names the folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder name in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str) -> None:
    """Write df as Parquet. Spark deletes the shuffle files of the write as soon as it's done, on all executors."""
    conf = df.sparkSession.conf
    before = conf.get(FILE_CLEANUP, None)
    conf.set(FILE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(FILE_CLEANUP) if before is None else conf.set(FILE_CLEANUP, before)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def written(df: DataFrame, what: str = "table") -> DataFrame:
    """Write df in the shared folder and read it again: cuts the lineage, and every later reader sees the same rows whatever executor is lost."""
    path = new_folder(df.sparkSession, what)
    write(df, path)
    return read(df.sparkSession, path, df.schema)


class Scratch:
    """Tables of one job in the shared folder, deleted as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.folder, self.n, self.paths = spark, new_folder(spark, what), 0, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """df as a written table; an older table of the same name stays until it's dropped."""
        self.n += 1
        path = f"{self.folder}/{name}-{self.n}"
        write(df, path)
        out = read(self.spark, path, df.schema)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, _ = self.paths.pop(id(t))
            drop_folder(self.spark, path)
        settle(self.spark)


def settle(spark: SparkSession) -> None:
    """Let the driver free what finished steps have left: plans, broadcast tables, generated classes. (Of hundreds of short queries in a row this fills its memory, as nothing is collected until the heap is full; spark.cleaner.periodicGC does the same by the clock.)"""
    gc.collect()  # handles of Java objects in cycles of Python's
    spark.sparkContext._jvm.System.gc()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours through Hadoop's file system, so that it works for any scheme."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def named(name: str) -> Column:
    """The column of that name, whatever signs it's made of."""
    return F.col("`" + name.replace("`", "``") + "`")


#: What this Python worker remembers: the operator, a key, the value.
REMEMBERED: list[tuple[str, Any, Any]] = []


def remembered(owner: str, key: Any, make: Callable[[], Any]) -> Any:
    """make(), kept by the worker for its next task: of one operator and key at a time, or what one stage remembers would stay while the next ones run in the same workers."""
    if not REMEMBERED or REMEMBERED[0][:2] != (owner, key):
        REMEMBERED.clear()
        give_back()
        REMEMBERED.append((owner, key, make()))
    return REMEMBERED[0][2]


def give_back() -> None:
    """Hand memory that Python, Arrow and the C library hold, but don't use, back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session hands at most ARROW_ROWS rows to a Python worker at once; a smaller setting stays."""
    now = int(spark.conf.get(ARROW_SETTING))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(ARROW_SETTING, str(ARROW_ROWS))


def carried(docs: DataFrame, text: str, made: list[str], *, keep_text: bool = True) -> tuple[DataFrame, list[T.StructField], list[str]]:
    """docs as an operator on Arrow batches takes them: columns c0, c1, ... (all but those it makes, and the text unless keep_text) and `body`, the text; the fields of the first; their own names, which no inner name can clash with. A text that is kept and a string goes once: its field is `body` itself."""
    bounded_batches(docs.sparkSession)
    own = [f for f in docs.schema.fields if f.name not in made and (keep_text or f.name != text)]
    fields = [T.StructField("body" if f.name == text and f.dataType == T.StringType() else f"c{i}", f.dataType) for i, f in enumerate(own)]
    columns = [named(f.name).alias(c.name) for f, c in zip(own, fields, strict=True)]
    if not any(c.name == "body" for c in fields):
        columns.append(named(text).cast("string").alias("body"))
    return docs.select(*columns), fields, [f.name for f in own]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the offsets of its rows (nulls are empty)."""
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    n, first = len(column), column.offset
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[first : first + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batches, column: str, size: int = PIECE_BYTES):
    """Cut record batches into slices of about `size` bytes of text; every row is in exactly one slice and is never cut itself."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64) + 16)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start..start+length of every pair, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows (it's counted: use written tables)."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
