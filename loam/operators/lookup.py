"""Reads: point and batch lookups, ordered scans, ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fold import latest, live


def get(log: DataFrame, key: str) -> DataFrame:
    """(key, found, is_deleted, value), at most one row; the key filter reaches the scan."""
    rows = latest(log.where(F.col("key") == key))
    return rows.select("key", F.lit(True).alias("found"), "is_deleted", "value")


def multi_get(versions: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probed key: found (any version), is_deleted, and the live value."""
    j = probes.select("key").distinct().join(versions.withColumn("found", F.lit(True)), "key", "left")
    return j.select("key", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"), "value")


def missing(versions: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.select("key").distinct().join(live(versions), "key", "left_anti")


def existing(versions: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.select("key").distinct().join(live(versions), "key", "left_semi")


def between(rows: DataFrame, low: str = "", high: str = "") -> DataFrame:
    """Keys in [low, high] in byte order; an empty side is open."""
    if low:
        rows = rows.where(F.col("key") >= low)
    if high:
        rows = rows.where(F.col("key") <= high)
    return rows


def place_among(key: Column, bounds: list[str]) -> Column:
    """How many of the sorted bounds are below the key: first among every step-th one, then within that step."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    below = lambda some: F.size(F.filter(some, lambda b: b < key))
    coarse = F.lit(0)
    if bounds[step - 1 :: step]:
        coarse = below(F.array(*map(F.lit, bounds[step - 1 :: step])))
    return (coarse * step + below(F.slice(F.array(*map(F.lit, bounds)), coarse * step + 1, F.lit(step)))).cast("int")


def ordinals(rows: DataFrame, parts: int | None = None, sample: int = 100) -> DataFrame:
    """Adds `rank` from 1 in key order without one task that sorts everything.

    Keys are dealt to `parts` ranges (as many as shuffle partitions) by bounds that are settled before: quantiles of the
    `sample` * parts keys with the smallest hashes. A row's rank is its place in its range after the sizes of the ranges before."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = sorted({r.key for r in rows.select("key").orderBy(F.xxhash64("key")).limit(sample * parts).collect()})
    bounds = sorted({some[len(some) * i // parts] for i in range(1, parts)}) if some else []
    dealt = rows.withColumn("_part", place_among(F.col("key"), bounds))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("key"))
    return dealt.withColumn("_at", place).join(F.broadcast(offsets), F.col("_part") == F.col("_p")).withColumn("rank", (F.col("_from") + F.col("_at")).cast("bigint")).drop("_part", "_p", "_from", "_at")


def first_keys(rows: DataFrame, n: int) -> DataFrame:
    """The n smallest keys (a top-k, no full sort)."""
    return rows.orderBy("key").limit(n)


def successor(rows: DataFrame, key: str) -> DataFrame:
    """The least key, and the least key above `key`."""
    return rows.agg(F.min("key").alias("least"), F.min(F.when(F.col("key") > key, F.col("key"))).alias("successor"))


def delete_returning(versions: DataFrame, keys: DataFrame) -> DataFrame:
    """The live values that deleting these keys takes away; keys without one are left out."""
    return keys.select("key").distinct().join(live(versions), "key").select("key", F.col("value").alias("old_value"))
