"""Folders in any file system that Spark reads."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _at(spark, path)
    return system.exists(at)


def names(spark: SparkSession, path: str, folders: bool) -> list[str]:
    system, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(at) if s.isDirectory() == folders) if system.exists(at) else []


def subfolders(spark: SparkSession, path: str) -> list[str]:
    return names(spark, path, True)


def files(spark: SparkSession, path: str) -> list[str]:
    return names(spark, path, False)


def text_of(spark: SparkSession, path: str) -> str:
    """A small file's text, read by the driver."""
    system, at = _at(spark, path)
    stream = system.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def status(spark: SparkSession, path: str) -> tuple[int, int]:
    """A file's size, and when it was changed (milliseconds)."""
    system, at = _at(spark, path)
    found = system.getFileStatus(at)
    return found.getLen(), found.getModificationTime()


def put(spark: SparkSession, path: str, text: str) -> None:
    """Make a small file anew."""
    system, at = _at(spark, path)
    stream = system.create(at, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def age(spark: SparkSession, path: str) -> float:
    """Seconds since a file or folder was changed, by the driver's clock."""
    system, at = _at(spark, path)
    return time.time() - system.getFileStatus(at).getModificationTime() / 1000


def drop(spark: SparkSession, path: str) -> None:
    system, at = _at(spark, path)
    system.delete(at, True)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file with its whole text, unless it's there; whether it was made. Of many writers at once one succeeds: the text is written under a name of its own, and gets the wanted name by a link (local) or a rename that doesn't overwrite (HDFS and stores with such a rename)."""
    system, at = _at(spark, path)
    folder, _, name = path.rpartition("/")
    _, own = _at(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    stream = system.create(own, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if system.getUri().getScheme() == "file":
            os.link(own.toUri().getPath(), at.toUri().getPath())
        else:
            jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
            rename = jvm.org.apache.hadoop.fs.Options.Rename
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri()).rename(own, at, gateway.new_array(rename, 0))
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        return False
    finally:
        system.delete(own, False)


def new_shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder name where the driver and all executors read and write: in spark.checkpoint.dir, or, in a local session without one, in a temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: it names the folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="spark-")
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"
