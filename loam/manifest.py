"""Versions of a small JSON table in one folder of any Hadoop file system: `<folder>/<version>.json`.

A version is created exclusively and never changed: of two writers that make the same version, the second one gets a
`Conflict` and must read again. A file that is not complete JSON (its writer has died, or writes still) is no version to readers,
and a conflict to writers until `clear` removes it."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has made this version."""


def file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def files(spark: SparkSession, folder: str) -> dict[int, object]:
    """The status of each version's file, complete or not."""
    fs, jpath = file_system(spark, folder)
    if not fs.exists(jpath):
        return {}
    names = {s.getPath().getName(): s for s in fs.listStatus(jpath)}
    return {int(n[:-5]): s for n, s in names.items() if n.endswith(".json") and n[:-5].isdigit()}


def content(spark: SparkSession, folder: str, version: int) -> dict | None:
    """What a version holds; None if it is not complete."""
    fs, jpath = file_system(spark, f"{folder}/{version}.json")
    stream = fs.open(jpath)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:
        return None
    finally:
        stream.close()


def newest(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """The newest complete version and what it holds; -1 and None without any."""
    for version in sorted(files(spark, folder), reverse=True):
        held = content(spark, folder, version)
        if held is not None:
            return version, held
    return -1, None


def create(spark: SparkSession, folder: str, version: int, held: dict) -> None:
    fs, jpath = file_system(spark, f"{folder}/{version}.json")
    if any(v >= version for v in files(spark, folder)):
        raise Conflict(f"{folder}: version {version} exists")
    try:
        stream = fs.create(jpath, False)
    except Py4JJavaError as e:
        if fs.exists(jpath):
            raise Conflict(f"{folder}: version {version} exists") from e
        raise
    stream.write(bytearray(json.dumps(held).encode()))
    stream.close()


def clear(spark: SparkSession, folder: str, before_ms: int) -> None:
    """Removes incomplete versions last written before that time, in milliseconds since 1970."""
    fs, _ = file_system(spark, folder)
    for version, status in files(spark, folder).items():
        if status.getModificationTime() < before_ms and content(spark, folder, version) is None:
            fs.delete(status.getPath(), False)
