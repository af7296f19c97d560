"""State = fold of the change log: for each key the row with the largest seq wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import DELETE, PUT


def latest(log: DataFrame) -> DataFrame:
    """(key, seq, is_deleted, value): the newest version of each key, tombstones kept, by partial aggregation."""
    rows = log.where(F.col("op").isin(PUT, DELETE))
    out = rows.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(F.struct("op", "value"), "seq").alias("v"))
    return out.select("key", "seq", (F.col("v.op") == DELETE).alias("is_deleted"), F.when(F.col("v.op") == PUT, F.col("v.value")).alias("value"))


def latest_by_rank(log: DataFrame) -> DataFrame:
    """The same by a window, for callers that need other columns of the winning row."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("seq").desc()))
    rows = log.where(F.col("op").isin(PUT, DELETE)).withColumn("rank", rank).where("rank = 1")
    return rows.select("key", "seq", (F.col("op") == DELETE).alias("is_deleted"), F.when(F.col("op") == PUT, F.col("value")).alias("value"))


def live(versions: DataFrame) -> DataFrame:
    """(key, value) of versions that are no tombstones."""
    return versions.where(~F.col("is_deleted")).select("key", "value")


def state(log: DataFrame) -> DataFrame:
    return live(latest(log))


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The state after replaying the log up to and including `seq`."""
    return state(log.where(F.col("seq") <= seq))


def merge(runs: DataFrame, by: str = "seq", newest: str = "max") -> DataFrame:
    """One row a key of a union of runs: the one with the largest (or, for priorities, smallest) `by`."""
    pick = F.max_by if newest == "max" else F.min_by
    row = F.struct("seq", "is_deleted", "value")
    return runs.groupBy("key").agg(pick(row, by).alias("r")).select("key", "r.*")
