"""Change logs: rows (seq, op, key, value) derived from tables, normalised at ingest, kept as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DELETE, LOG, PUT, SENTINEL


def change_log(rows: DataFrame, seq: Column, deleted: Column, key: Column, value: Column) -> DataFrame:
    """A log from any table: a row deletes its key where `deleted` holds, and puts it otherwise."""
    return rows.select(seq.cast("bigint").alias("seq"), F.when(deleted, DELETE).otherwise(PUT).alias("op"), key.cast("string").alias("key"), value.cast("string").alias("value"))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return change_log(e, F.col("event_id"), F.col("event_type") == "error", F.col("user_id"), F.concat("event_type", F.lit(":"), "props"))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return change_log(o, F.col("o_orderkey"), F.col("o_orderstatus") == "F", F.col("o_custkey"), F.col("o_orderpriority"))


def conversations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return change_log(c, F.col("conv_id") * 1000 + F.col("turn"), F.col("role") == "assistant", F.col("conv_id"), F.col("text"))


def documents_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return change_log(d, F.col("doc_id"), F.lit(False), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")), F.col("text"))


def generated_log(spark: SparkSession, n: int, key: str, value: str, deletes: list[str] | None = None) -> DataFrame:
    """Puts 1..n with printf patterns for key and value, then deletes of the listed keys."""
    puts = spark.range(1, n + 1).select(F.col("id").alias("seq"), F.lit(PUT).alias("op"), F.format_string(key, "id").alias("key"), F.format_string(value, "id").alias("value"))
    for i, k in enumerate(deletes or [], n + 1):
        puts = puts.union(spark.range(1).select(F.lit(i).cast("bigint"), F.lit(DELETE), F.lit(k), F.lit(None).cast("string")))
    return puts


def normalised(log: DataFrame, sentinel: bool = True) -> DataFrame:
    """Known operations only; with `sentinel`, puts of the sentinel value are deletes. Deletes carry no value."""
    op = F.when((F.col("op") == PUT) & (F.col("value") == SENTINEL), DELETE).otherwise(F.col("op")) if sentinel else F.col("op")
    log = log.where(F.col("op").isin(PUT, DELETE)).withColumn("op", op)
    return log.withColumn("value", F.when(F.col("op") == PUT, F.col("value")))


def record_bytes() -> Column:
    """Bytes of a record in the buffer: key and value, a delete counted as the sentinel."""
    return (F.octet_length("key") + F.when(F.col("op") == DELETE, F.lit(len(SENTINEL))).otherwise(F.coalesce(F.octet_length("value"), F.lit(0)))).cast("bigint")


def entry_bytes() -> Column:
    """Bytes of an entry in a binary log: operation, key length and key, and for a put value length and value."""
    return (F.lit(5) + F.octet_length("key") + F.when(F.col("op") == PUT, F.lit(4) + F.octet_length("value")).otherwise(F.lit(0))).cast("bigint")


def append(log: DataFrame, path: str) -> None:
    log.select("seq", "op", "key", "value").write.mode("append").parquet(path)


def replay(spark: SparkSession, path: str | list[str], after: int = -1) -> DataFrame:
    """The known operations of a log, or of several folders of one, with a larger seq; order them by seq where order matters."""
    return spark.read.schema(LOG).parquet(*([path] if isinstance(path, str) else path)).where((F.col("seq") > after) & F.col("op").isin(PUT, DELETE))
