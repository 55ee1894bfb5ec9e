"""Files by path or URI: through Spark's file systems on the driver, and as streams in tasks."""

from __future__ import annotations

import os
from urllib.parse import urlsplit

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _system(spark, path)
    return system.exists(where)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    where, system = _system(spark, path)
    return system.getContentSummary(where).getLength()


def remove(spark: SparkSession, path: str) -> None:
    where, system = _system(spark, path)
    system.delete(where, True)


def open_stream(path: str):
    """A seekable binary stream of a path that this machine sees, or of a URI that Arrow has a file system for."""
    parts = urlsplit(path)
    if len(parts.scheme) < 2:
        return open(path, "rb")
    if parts.scheme == "file":
        return open(parts.path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def stream_size(stream) -> int:
    at = stream.tell()
    size = stream.seek(0, os.SEEK_END)
    stream.seek(at)
    return size
