"""The log as a stream: files of changes go micro-batch by micro-batch into runs; the state is their fold by seq.

A batch's run is written under its batch id, so a replayed batch replaces itself, and the fold is idempotent anyway."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.fold import latest, live, merge
from ..schema import LOG, RUN
from ..sources.changelog import normalised
from ..store import KeyedStore


def ingest(spark: SparkSession, log_path: str, runs_path: str, checkpoint: str, per_trigger: int = 1) -> None:
    """Reads all files of the log that are there, `per_trigger` at a time, into runs; call again for what came later."""

    def flush(batch: DataFrame, batch_id: int) -> None:
        latest(batch).select("key", "seq", "is_deleted", "value").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{runs_path}/batch={batch_id}")

    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", per_trigger).parquet(log_path)
    query = normalised(stream).writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def state(spark: SparkSession, runs_path: str) -> DataFrame:
    return live(merge(spark.read.schema(RUN).option("recursiveFileLookup", "true").parquet(runs_path)))


def ingest_into(store: KeyedStore, log_path: str, checkpoint: str, name: str = "log", per_trigger: int = 1) -> None:
    """The same into a store: each micro-batch is a level-0 run in the manifest, with compaction and vacuum behind it. A batch
    that is replayed after a failure is known by its number and left out. Files may come in any order of their seqs; call the store's
    `complete` once all up to a seq have come, so that compaction may forget tombstones."""

    def flush(batch: DataFrame, batch_id: int) -> None:
        store.add_batch(batch, name, batch_id)

    stream = store.spark.readStream.schema(LOG).option("maxFilesPerTrigger", per_trigger).parquet(log_path)
    normalised(stream).writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
