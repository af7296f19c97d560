"""Constants, row types, settings and errors of the keyed-table engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

PUT, DELETE = 0, 1
#: A put of this value is a delete, where callers rely on the old convention.
SENTINEL = "__TOMBSTONE__"
MAX_LEVEL = 9

LOG = T.StructType([T.StructField("seq", T.LongType(), False), T.StructField("op", T.IntegerType(), False), T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType())])
RUN = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("seq", T.LongType(), False), T.StructField("is_deleted", T.BooleanType(), False), T.StructField("value", T.StringType())])
STATE = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType(), False)])


@dataclass(frozen=True)
class StoreConfig:
    """Settings of a store; bytes count keys and values. `max_immutable`: full buffers that may wait in the log before the oldest
    is flushed; `retention_s`: how long readers of an older version find what it names."""

    memtable_size: int = 4 << 20
    compaction_factor: int = 4
    bits_per_key: int = 10
    max_immutable: int = 2
    retention_s: float = 3600.0

    def __post_init__(self) -> None:
        if self.memtable_size <= 0 or self.compaction_factor < 2 or self.max_immutable < 0 or self.retention_s < 0:
            raise ValueError(f"settings out of range: {self}")


class StoreClosed(RuntimeError):
    """The store was used after close()."""


class KeyNotFound(KeyError):
    """No live value for the key."""
