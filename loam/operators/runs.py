"""Flush epochs and sorted runs with their manifest."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import DELETE, PUT
from ..sources.changelog import record_bytes

BLOCK = 1 << 16


def running_offsets(sums: DataFrame, levels: int = 2) -> DataFrame:
    """(_b, _from): the sum of `_sum` over all rows of smaller `_block`. Blocks are summed in blocks of their own, so the last window
    holds one row for BLOCK ** (levels + 1) records, and every other one BLOCK rows at most."""
    if levels == 0:
        before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        return sums.select(F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_from"))
    sums = sums.withColumn("_over", F.floor(F.col("_block") / BLOCK))
    above = running_offsets(sums.groupBy(F.col("_over").alias("_block")).agg(F.sum("_sum").alias("_sum")), levels - 1)
    before = Window.partitionBy("_over").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    rows = sums.withColumn("_in", F.coalesce(F.sum("_sum").over(before), F.lit(0))).join(above, F.col("_over") == F.col("_b"))
    return rows.select(F.col("_block").alias("_b"), (F.col("_from") + F.col("_in")).alias("_from"))


def with_epochs(log: DataFrame, memtable_size: int) -> DataFrame:
    """Adds `bytes` and `epoch`, the buffer in which a record falls: floor of the bytes before it over the buffer's size.

    The running sum takes steps, blocks of blocks of seq and then rows of a block, so the log is never sorted in one task."""
    log = log.withColumn("bytes", record_bytes()).withColumn("_block", F.floor(F.col("seq") / BLOCK))
    offsets = running_offsets(log.groupBy("_block").agg(F.sum("bytes").alias("_sum")), 1)
    inside = F.coalesce(F.sum("bytes").over(Window.partitionBy("_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = log.withColumn("_in", inside).join(offsets, F.col("_block") == F.col("_b"))
    return rows.withColumn("epoch", F.floor((F.col("_from") + F.col("_in")) / memtable_size).cast("bigint")).drop("_block", "_b", "_from", "_in")


def exact_flushes(log: DataFrame, memtable_size: int) -> DataFrame:
    """(n_flushes, tail_bytes) where the buffer restarts at 0 after each flush: a recurrence over the records' sizes in
    seq order, read as one stream of numbers with constant memory."""

    def run(batches):
        flushes = held = 0
        for batch in batches:
            for b in batch.column(0).to_pylist():
                held += b
                if held >= memtable_size:
                    flushes, held = flushes + 1, 0
        yield pa.RecordBatch.from_pydict({"n_flushes": [flushes], "tail_bytes": [held]})

    rows = log.select("seq", record_bytes().alias("bytes")).orderBy("seq").select("bytes")
    return rows.coalesce(1).mapInArrow(run, "n_flushes bigint, tail_bytes bigint")


def run_rows(log: DataFrame, memtable_size: int) -> DataFrame:
    """(run_id, level, key, seq, is_deleted, value): of each epoch the newest version of each key, tombstones kept."""
    rows = with_epochs(log, memtable_size)
    out = rows.groupBy("epoch", "key").agg(F.max("seq").alias("seq"), F.max_by(F.struct("op", "value"), "seq").alias("v"))
    return out.select(F.col("epoch").alias("run_id"), F.lit(0).alias("level"), "key", "seq", (F.col("v.op") == DELETE).alias("is_deleted"), F.when(F.col("v.op") == PUT, F.col("v.value")).alias("value"))


def manifest(runs: DataFrame) -> DataFrame:
    """One row a run: ranges of keys and seq, entries, tombstones, bytes."""
    size = (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("bigint")
    return runs.groupBy("run_id", "level").agg(
        F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"),
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.count("*").alias("n_entries"),
        F.sum(F.col("is_deleted").cast("bigint")).alias("n_tombstones"),
        F.sum(size).alias("n_bytes"),
    )


def may_hold(catalog: DataFrame, key: str) -> DataFrame:
    """Runs whose key range holds the key; the others need not be read."""
    return catalog.where((F.col("min_key") <= key) & (F.col("max_key") >= key))


def write_runs(runs: DataFrame, path: str) -> None:
    """Runs with each one's rows together in one file, in key order."""
    runs.repartition("run_id").sortWithinPartitions("run_id", "key").write.parquet(path)


def order_faults(rows: DataFrame) -> DataFrame:
    """(n_rows, n_out_of_order, n_repeated) of runs read back from files with columns run_id and key, each file in its own order:
    neighbours whose keys fall or repeat, and keys that two files of a run have."""
    rows = rows.select("run_id", "key", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    rows = rows.withColumn("before", F.lag("key").over(Window.partitionBy("file", "run_id").orderBy("at")))
    keys = rows.groupBy("run_id", "key").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("before") > F.col("key"), F.lit(False)).cast("bigint")).alias("falls"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return keys.agg(total("n").alias("n_rows"), total("falls").alias("n_out_of_order"), total(F.col("n") - 1).alias("n_repeated"))
