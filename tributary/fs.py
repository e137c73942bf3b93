"""File access through the file system that the session uses, so any store Spark can reach works."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme; one that is given without is in the session's default file system."""
    fs, p = _at(spark, path)
    return fs.makeQualified(p).toString()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def files(spark: SparkSession, path: str, recursive: bool = True) -> list[str]:
    """All files below a path, as full names; an absent path has none."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return []
    it, out = fs.listFiles(p, recursive), []
    while it.hasNext():
        out.append(it.next().getPath().toString())
    return sorted(out)


def is_empty(spark: SparkSession, path: str) -> bool:
    """True where the path is absent or holds no file at any depth."""
    fs, p = _at(spark, path)
    return not fs.exists(p) or not fs.listFiles(p, True).hasNext()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole text; False, and nothing changed, where it exists already.

    Written beside and moved by an operation that fails on an existing target (a hard link on local disks, a rename
    without overwriting elsewhere), so of two writers one wins and no reader sees a part.
    """
    fs, p = _at(spark, path)
    jvm = spark._jvm
    side = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
    out = fs.create(side, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(side.toUri().getPath(), p.toUri().getPath())
        else:
            no_overwrite = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(side, p, no_overwrite)
    except (FileExistsError, Py4JJavaError):
        if not fs.exists(p):
            raise
        return False
    finally:
        fs.delete(side, False)
    return True


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    fs, p = _at(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)
