"""Small control files on any file system Spark can reach."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    _, fs, p = _fs(spark, path)
    return fs.exists(p)


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it doesn't exist."""
    _, fs, p = _fs(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    jvm, fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_once(spark: SparkSession, path: str, text: str) -> None:
    """Make a file that isn't there yet: the file system refuses to create it twice, so of two writers one fails with FileExistsError.

    A writer lost in the middle leaves a file that is no whole JSON; numbered_json() passes over it.
    """
    _, fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    try:
        stream = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            raise FileExistsError(path) from e
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def numbered_json(spark: SparkSession, folder: str) -> tuple[dict | None, int]:
    """(the whole file with the greatest number, the next number that is free) of a folder of N.json files."""
    numbers = sorted((int(n.split(".")[0]) for n in list_names(spark, folder) if n.endswith(".json")), reverse=True)
    following = numbers[0] + 1 if numbers else 1
    for n in numbers:
        try:
            return json.loads(read_text(spark, f"{folder}/{n}.json")), following
        except ValueError:
            continue  # its writer was lost
    return None, following


def remove(spark: SparkSession, path: str) -> None:
    _, fs, p = _fs(spark, path)
    fs.delete(p, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder removed when the driver's JVM ends."""
    _, fs, p = _fs(spark, path)
    fs.mkdirs(p)  # only what exists is noted
    fs.deleteOnExit(p)
