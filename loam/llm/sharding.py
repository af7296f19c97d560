"""Rendezvous hashing of stable record keys over weighted shards.

Each key scores every shard by weight / -ln(u), u in (0, 1) from a hash of key and shard alone, and goes to the
highest score: shares follow the weights, and a further shard only takes keys into itself. No shuffle is needed to
place a row. Slots number each shard's rows without gaps through per-cell counts, so no shard is sorted in one task.

Defined results: null text counts as empty (size 1, crc 0); rows with a null key share one place by that key; equal
keys share a shard and have slots of their own. Extra columns are kept out; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash52, numbered

CELLS = 4096


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, with the highest score for the key; the lower one of equals."""
    scores = []
    for i, w in enumerate(weights):
        u = (hash52(key.cast("string"), F.lit(str(i))) + F.lit(0.5)) / F.lit(float(1 << 52))
        scores.append(F.struct((F.lit(float(w)) / -F.log(u)).alias("score"), F.lit(-i).alias("i")))
    return (-F.greatest(*scores)["i"]).cast("int") if len(scores) > 1 else F.lit(0)


def shard(docs: DataFrame, shards: int = 8, weights: Sequence[float] | None = None) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard)."""
    weights = list(weights or [1.0] * shards)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("shard", rendezvous(F.col("doc_id"), weights)).withColumn("grown_shard", rendezvous(F.col("doc_id"), [*weights, sum(weights) / len(weights)]))
    rows = numbered(rows, "shard", (hash52(F.col("doc_id").cast("string"), F.lit("cell"), F.col("text_crc32").cast("string")) % CELLS).cast("int"), [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
