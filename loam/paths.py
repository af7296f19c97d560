"""Where tables between steps are kept: a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; a temporary folder only where it is unset and all runs on one machine (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="loam-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the JVM ends."""
    path = f"{shared_dir(spark)}/loam/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path
