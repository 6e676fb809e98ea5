"""Small files and folders on any file system that Spark reaches, through Hadoop's FileSystem."""

from __future__ import annotations

import contextlib
import json
import os
from collections.abc import Iterator
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class LockedError(RuntimeError):
    pass


def _at(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def qualified(spark: SparkSession, path: str) -> str:
    """The one spelling of a path: with scheme and authority, without a slash at the end."""
    fs, found = _at(spark, path)
    return fs.makeQualified(found).toString().rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    fs, found = _at(spark, path)
    return fs.exists(found)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it isn't there."""
    fs, found = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(found)) if fs.exists(found) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, found = _at(spark, path)
    fs.delete(found, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, found = _at(spark, old)
    if not fs.rename(found, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError("the staged copy could not be renamed")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None if it isn't there."""
    fs, found = _at(spark, path)
    if not fs.exists(found):
        return None
    stream = fs.open(found)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file; an existing one is an error."""
    fs, found = _at(spark, path)
    stream = fs.create(found, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


@contextlib.contextmanager
def lock(spark: SparkSession, path: str) -> Iterator[None]:
    """One holder of the file at path; a second one fails at once. A lock that an interrupted holder left is never
    removed by itself: the message says whose it is."""
    try:
        write_text(spark, path, json.dumps({"pid": os.getpid(), "host": os.uname().nodename, "at": datetime.now(UTC).isoformat(timespec="seconds")}))
    except Py4JJavaError:
        held = read_text(spark, path)
        if held is None:
            raise
        raise LockedError(f"locked by {held}; if that process is gone, inspect what it did and delete {path}") from None
    try:
        yield
    finally:
        delete(spark, path)
