"""Queries over change logs: state, lookups, ranges, replay. Each has its SQL oracle beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fold, lookup
from ..paths import new_path
from ..schema import StoreConfig
from ..sources import changelog as C
from ..store import KeyedStore
from ..streaming import ingest

QUERIES: dict = {}
ORACLES: dict = {}

EVENTS = "log AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS op, CAST(user_id AS VARCHAR) AS key, event_type || ':' || props AS value FROM events)"
VERSIONS = "latest AS (SELECT key, max(seq) AS seq, arg_max(op, seq) = 1 AS is_deleted, CASE WHEN arg_max(op, seq) = 0 THEN arg_max(value, seq) END AS value FROM log WHERE op IN (0, 1) GROUP BY key)"
WITH = f"WITH {EVENTS}, {VERSIONS} "
#: Probed keys: every user, and as many that never wrote.
PROBES = "probes AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events UNION SELECT DISTINCT 'x' || CAST(user_id AS VARCHAR) FROM events)"


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.events_log(spark, sf_dir)


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("key")).distinct()
    return users.union(users.select(F.concat(F.lit("x"), "key")))


@query(f"{WITH} SELECT key, value FROM latest WHERE NOT is_deleted")
def kv_latest_state(spark, sf_dir):
    return fold.state(log(spark, sf_dir))


@query(f"{WITH} SELECT key, seq, is_deleted, value FROM latest")
def kv_latest_with_tombstones(spark, sf_dir):
    return fold.latest(log(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT key, seq, op = 1 AS is_deleted, CASE WHEN op = 0 THEN value END AS value FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1")
def kv_latest_window(spark, sf_dir):
    return fold.latest_by_rank(log(spark, sf_dir))


@query("WITH log AS (SELECT o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS op, CAST(o_custkey AS VARCHAR) AS key, o_orderpriority AS value FROM orders), " + VERSIONS + " SELECT key, value FROM latest WHERE NOT is_deleted")
def kv_orders_state(spark, sf_dir):
    return fold.state(C.orders_log(spark, sf_dir))


@query("WITH log AS (SELECT conv_id * 1000 + turn AS seq, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS op, CAST(conv_id AS VARCHAR) AS key, text AS value FROM conversations), " + VERSIONS + " SELECT key, value FROM latest WHERE NOT is_deleted")
def kv_conversations_state(spark, sf_dir):
    return fold.state(C.conversations_log(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT op, CAST(count(*) AS BIGINT) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM log WHERE op IN (0, 1) GROUP BY op")
def wal_replay_ops(spark, sf_dir):
    rows = C.normalised(log(spark, sf_dir))
    return rows.groupBy("op").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(f"WITH e AS (SELECT * FROM events WHERE event_id <= 500), {EVENTS.replace('FROM events', 'FROM e')}, {VERSIONS} SELECT key, value FROM latest WHERE NOT is_deleted")
def wal_replay_prefix(spark, sf_dir):
    return fold.as_of(log(spark, sf_dir), 500)


@query(f"WITH {EVENTS} SELECT op, CAST(count(*) AS BIGINT) AS n, CAST(sum(5 + strlen(key) + CASE WHEN op = 0 THEN 4 + strlen(value) ELSE 0 END) AS BIGINT) AS n_bytes FROM log GROUP BY op")
def wal_record_bytes(spark, sf_dir):
    return log(spark, sf_dir).groupBy("op").agg(F.count("*").alias("n"), F.sum(C.entry_bytes()).alias("n_bytes"))


@query(f"{WITH} SELECT key, true AS found, is_deleted, value FROM latest WHERE key = '7'")
def kv_get_point(spark, sf_dir):
    return lookup.get(log(spark, sf_dir), "7")


@query(f"{WITH}, {PROBES} SELECT p.key, l.key IS NOT NULL AS found, coalesce(is_deleted, false) AS is_deleted, value FROM probes p LEFT JOIN latest l ON p.key = l.key")
def kv_multi_get(spark, sf_dir):
    return lookup.multi_get(fold.latest(log(spark, sf_dir)), probes(spark, sf_dir))


@query(f"{WITH}, {PROBES} SELECT key FROM probes p WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.key = p.key AND NOT is_deleted)")
def kv_multi_get_missing(spark, sf_dir):
    return lookup.missing(fold.latest(log(spark, sf_dir)), probes(spark, sf_dir))


@query(f"{WITH}, {PROBES} SELECT key FROM probes p WHERE EXISTS (SELECT 1 FROM latest l WHERE l.key = p.key AND NOT is_deleted)")
def kv_exists(spark, sf_dir):
    return lookup.existing(fold.latest(log(spark, sf_dir)), probes(spark, sf_dir))


@query(f"{WITH} SELECT key FROM latest WHERE is_deleted")
def kv_has_tombstone(spark, sf_dir):
    return fold.latest(log(spark, sf_dir)).where("is_deleted").select("key")


@query(f"WITH {EVENTS} SELECT key, CAST(count(*) AS BIGINT) AS n_deletes FROM (SELECT key, op, min(CASE WHEN op = 0 THEN seq END) OVER (PARTITION BY key) AS first_put, seq FROM log) WHERE op = 1 AND (first_put IS NULL OR seq < first_put) GROUP BY key")
def kv_blind_delete(spark, sf_dir):
    rows = log(spark, sf_dir)
    first = rows.where("op = 0").groupBy("key").agg(F.min("seq").alias("first_put"))
    blind = rows.where("op = 1").join(first, "key", "left").where("first_put is null or seq < first_put")
    return blind.groupBy("key").agg(F.count("*").alias("n_deletes"))


@query("WITH log AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 1 WHEN value < 1 THEN 1 ELSE 0 END AS op, CAST(user_id AS VARCHAR) AS key, event_type AS value FROM events), " + VERSIONS + " SELECT key, value FROM latest WHERE NOT is_deleted")
def kv_sentinel_value(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.when(F.col("value") < 1, C.SENTINEL).otherwise(F.col("event_type"))
    return fold.state(C.normalised(C.change_log(e, F.col("event_id"), F.col("event_type") == "error", F.col("user_id"), value)))


@query("WITH log AS (SELECT doc_id AS seq, 0 AS op, lang || '/' || CAST(doc_id AS VARCHAR) AS key, text AS value FROM documents) SELECT CAST(sum(strlen(key) + strlen(value)) AS BIGINT) AS n_bytes, CAST(count(DISTINCT key) AS BIGINT) AS n_keys FROM log")
def kv_memtable_size_count(spark, sf_dir):
    return C.documents_log(spark, sf_dir).agg(F.sum(C.record_bytes()).alias("n_bytes"), F.count_distinct("key").alias("n_keys"))


@query(f"{WITH} SELECT key, value, CAST(row_number() OVER (ORDER BY key) AS BIGINT) AS rank FROM latest WHERE NOT is_deleted")
def kv_inorder(spark, sf_dir):
    return lookup.ordinals(fold.state(log(spark, sf_dir)))


@query(f"{WITH} SELECT key, value FROM latest WHERE NOT is_deleted ORDER BY key LIMIT 10")
def kv_inorder_first_n(spark, sf_dir):
    return lookup.first_keys(fold.state(log(spark, sf_dir)), 10)


@query(f"{WITH} SELECT min(key) AS least, min(CASE WHEN key > '5' THEN key END) AS successor FROM latest WHERE NOT is_deleted")
def kv_min_successor(spark, sf_dir):
    return lookup.successor(fold.state(log(spark, sf_dir)), "5")


@query(f"{WITH} SELECT key, value FROM latest WHERE NOT is_deleted AND key >= '12' AND key <= '70'")
def kv_range_closed(spark, sf_dir):
    return lookup.between(fold.state(log(spark, sf_dir)), "12", "70")


@query(f"{WITH} SELECT key, value FROM latest WHERE NOT is_deleted AND key >= '12'")
def kv_range_from(spark, sf_dir):
    return lookup.between(fold.state(log(spark, sf_dir)), "12")


@query(f"{WITH} SELECT key, value FROM latest WHERE NOT is_deleted AND key <= '70'")
def kv_range_to(spark, sf_dir):
    return lookup.between(fold.state(log(spark, sf_dir)), "", "70")


@query(f"{WITH} SELECT key, value FROM latest WHERE NOT is_deleted")
def kv_range_all(spark, sf_dir):
    return lookup.between(fold.state(log(spark, sf_dir)))


@query(f"{WITH} SELECT key, seq, is_deleted, value FROM latest WHERE key >= '12' AND key <= '70'")
def kv_range_with_tombstones(spark, sf_dir):
    return lookup.between(fold.latest(log(spark, sf_dir)), "12", "70")


@query(f"{WITH}, {PROBES} SELECT p.key, value AS old_value FROM probes p JOIN latest l ON p.key = l.key WHERE NOT is_deleted")
def kv_delete_returning(spark, sf_dir):
    return lookup.delete_returning(fold.latest(log(spark, sf_dir)), probes(spark, sf_dir))


@query("WITH k AS (SELECT printf('key-%04d', i) AS key, printf('value-%04d', i) AS value FROM range(1, 1001) t(i)) SELECT key, value FROM k WHERE key NOT IN ('key-0100', 'key-0200', 'key-0300', 'key-0400', 'key-0500')")
def example_walkthrough(spark, sf_dir):
    return fold.state(C.generated_log(spark, 1000, "key-%04d", "value-%04d", [f"key-{i:04d}" for i in range(100, 501, 100)]))


@query("SELECT CAST(count(*) AS BIGINT) AS n_reads, CAST(sum(CASE WHEN (i * 17) % 10000 BETWEEN 1 AND 10000 THEN 1 ELSE 0 END) AS BIGINT) AS n_hits FROM range(0, 1000) t(i)")
def bench_read_hit_rate(spark, sf_dir):
    versions = fold.latest(C.generated_log(spark, 10000, "bench-key-%05d", "bench-value-%05d"))
    reads = spark.range(1000).select(F.format_string("bench-key-%05d", F.col("id") * 17 % 10000).alias("key"))
    j = reads.join(versions, "key", "left")
    return j.agg(F.count("*").alias("n_reads"), F.sum(F.col("seq").isNotNull().cast("bigint")).alias("n_hits"))


@query(f"{WITH} SELECT key, value FROM latest WHERE NOT is_deleted")
def stream_ingest_state(spark, sf_dir):
    base = new_path(spark, "stream")
    log(spark, sf_dir).repartitionByRange(4, "seq").write.parquet(f"{base}/log")
    ingest.ingest(spark, f"{base}/log", f"{base}/runs", f"{base}/checkpoint", per_trigger=2)
    return ingest.state(spark, f"{base}/runs")


def stored(spark: SparkSession, sf_dir: str, **settings) -> KeyedStore:
    """A store of the events log, written as a stream of four parts."""
    base = new_path(spark, "store")
    log(spark, sf_dir).repartitionByRange(4, "seq").sortWithinPartitions("seq").write.parquet(f"{base}-log")
    store = KeyedStore.open(spark, base, StoreConfig(**settings))
    ingest.ingest_into(store, f"{base}-log", f"{base}-checkpoint")
    return store


@query(f"{WITH} SELECT key, value FROM latest WHERE NOT is_deleted")
def store_state(spark, sf_dir):
    """The state through the store: a stream into runs, with compaction behind it."""
    return stored(spark, sf_dir, compaction_factor=3).state()


@query(f"{WITH} SELECT '7' AS key, true AS found, is_deleted, value FROM latest WHERE key = '7' UNION ALL SELECT 'absent', false, false, NULL")
def run_get(spark, sf_dir):
    """Lookups in one run, the whole log compacted: a key that is there, live or deleted, and one that is not."""
    store = KeyedStore.open(spark, new_path(spark, "store"))
    store.write(log(spark, sf_dir))
    store.flush()
    run = store.runs[0]["run_id"]
    rows = [(key, found, dead, value) for key in ("7", "absent") for value, found, dead in [store.get_from_run(run, key)]]
    return spark.createDataFrame(rows, "key string, found boolean, is_deleted boolean, value string")


@query(f"{WITH} SELECT key, may_contain FROM (SELECT key, true AS may_contain FROM latest ORDER BY key LIMIT 5)")
def run_may_contain(spark, sf_dir):
    """The stored filter of a run knows its keys, here the five least."""
    store = KeyedStore.open(spark, new_path(spark, "store"))
    store.write(log(spark, sf_dir))
    store.flush()
    run = store.runs[0]["run_id"]
    keys = [r.key for r in lookup.first_keys(store.iterate(run), 5).collect()]
    return spark.createDataFrame([(k, store.may_contain(run, k)) for k in keys], "key string, may_contain boolean")
