"""Queries over flush epochs, runs, levels and compaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bloom
from ..operators import compaction, fold, runs
from ..paths import new_path
from .filters import HASHED, located
from .keyed import EVENTS, VERSIONS, log

QUERIES: dict = {}
ORACLES: dict = {}
SIZE, FACTOR = 4096, 4

EPOCHS = "epochs AS (SELECT *, (sum(bytes) OVER (ORDER BY seq) - bytes) // 4096 AS epoch FROM (SELECT *, strlen(key) + CASE WHEN op = 1 THEN 13 ELSE strlen(value) END AS bytes FROM log))"
RUNS = "runs AS (SELECT CAST(epoch AS BIGINT) AS run_id, 0 AS level, key, max(seq) AS seq, arg_max(op, seq) = 1 AS is_deleted, CASE WHEN arg_max(op, seq) = 0 THEN arg_max(value, seq) END AS value FROM epochs GROUP BY epoch, key)"
OLDEST = f"inputs AS (SELECT * FROM runs WHERE run_id < {FACTOR})"
MERGED = "merged AS (SELECT key, max(seq) AS seq, arg_max(is_deleted, seq) AS is_deleted, CASE WHEN NOT arg_max(is_deleted, seq) THEN arg_max(value, seq) END AS value FROM inputs GROUP BY key)"
WITH = f"WITH {EVENTS}, {EPOCHS}, {RUNS}"


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


def all_runs(spark, sf_dir):
    return runs.run_rows(log(spark, sf_dir), SIZE)


@query(f"WITH {EVENTS}, {EPOCHS} SELECT CAST(epoch AS BIGINT) AS epoch, CAST(count(*) AS BIGINT) AS n_records, CAST(sum(bytes) AS BIGINT) AS n_bytes FROM epochs GROUP BY epoch")
def flush_epochs(spark, sf_dir):
    return runs.with_epochs(log(spark, sf_dir), SIZE).groupBy("epoch").agg(F.count("*").alias("n_records"), F.sum("bytes").alias("n_bytes"))


@query(
    f"WITH {EVENTS}, packed AS (SELECT list_reduce(list(CAST(strlen(key) + CASE WHEN op = 1 THEN 13 ELSE strlen(value) END AS BIGINT) ORDER BY seq), lambda s, b: CASE WHEN (s % 4294967296) + b >= 4096 THEN (s // 4294967296 + 1) * 4294967296 ELSE s + b END, CAST(0 AS BIGINT)) AS s FROM log) SELECT CAST(s // 4294967296 AS BIGINT) AS n_flushes, CAST(s % 4294967296 AS BIGINT) AS tail_bytes FROM packed"
)
def flush_epochs_exact(spark, sf_dir):
    return runs.exact_flushes(log(spark, sf_dir), SIZE)


@query(f"{WITH} SELECT run_id, level, key, seq, is_deleted, value FROM runs")
def run_contents(spark, sf_dir):
    return all_runs(spark, sf_dir)


MANIFEST = "manifest AS (SELECT run_id, level, min(seq) AS min_seq, max(seq) AS max_seq, min(key) AS min_key, max(key) AS max_key, CAST(count(*) AS BIGINT) AS n_entries, CAST(sum(CAST(is_deleted AS INT)) AS BIGINT) AS n_tombstones, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS n_bytes FROM runs GROUP BY run_id, level)"


@query(f"{WITH}, {MANIFEST} SELECT * FROM manifest")
def run_manifest(spark, sf_dir):
    return runs.manifest(all_runs(spark, sf_dir))


@query(f"{WITH}, {MANIFEST} SELECT run_id FROM manifest WHERE min_key <= '7' AND max_key >= '7'")
def run_prune_minmax(spark, sf_dir):
    return runs.may_hold(runs.manifest(all_runs(spark, sf_dir)), "7").select("run_id")


@query(
    f"{WITH}, keys AS (SELECT DISTINCT key FROM runs UNION SELECT '7'), {HASHED}, loc AS ({located(4, 200)}), probe AS (SELECT DISTINCT pos FROM loc WHERE key = '7') SELECT run_id FROM (SELECT DISTINCT run_id, pos FROM runs r JOIN loc l ON l.key = r.key) x JOIN probe p ON p.pos = x.pos GROUP BY run_id HAVING count(*) = (SELECT count(*) FROM probe)"
)
def run_prune_bloom(spark, sf_dir):
    return bloom.runs_to_read(all_runs(spark, sf_dir), "7", 4, 200)


@query(f"{WITH}, {MANIFEST} SELECT level, CAST(count(*) AS BIGINT) AS n_runs FROM manifest GROUP BY level")
def level_counts(spark, sf_dir):
    return runs.manifest(all_runs(spark, sf_dir)).groupBy("level").agg(F.count("*").alias("n_runs"))


@query(f"{WITH}, {MANIFEST} SELECT count(*) >= {FACTOR} AS should_compact FROM manifest WHERE level = 0")
def should_compact(spark, sf_dir):
    return runs.manifest(all_runs(spark, sf_dir)).where("level = 0").agg((F.count("*") >= FACTOR).alias("should_compact"))


@query(f"{WITH}, {OLDEST} SELECT key, arg_min(seq, {FACTOR} - run_id) AS seq, arg_min(is_deleted, {FACTOR} - run_id) AS is_deleted, CASE WHEN NOT arg_min(is_deleted, {FACTOR} - run_id) THEN arg_min(value, {FACTOR} - run_id) END AS value FROM inputs GROUP BY key")
def merge_runs_newest_wins(spark, sf_dir):
    """Runs listed newest first: the smallest priority wins."""
    inputs = all_runs(spark, sf_dir).where(F.col("run_id") < FACTOR).withColumn("prio", FACTOR - F.col("run_id"))
    return fold.merge(inputs, "prio", "min")


@query(f"{WITH}, {OLDEST}, {MERGED} SELECT * FROM merged")
def compaction_l0_l1(spark, sf_dir):
    return fold.merge(all_runs(spark, sf_dir).where(F.col("run_id") < FACTOR))


@query(
    f"{WITH}, inputs AS (SELECT * FROM runs WHERE run_id BETWEEN 1 AND {FACTOR}), {MERGED} SELECT * FROM merged m WHERE NOT is_deleted OR EXISTS (SELECT 1 FROM runs r WHERE r.run_id < 1 AND r.key = m.key)"
)
def compaction_gc(spark, sf_dir):
    """The runs 1 to FACTOR merged; a tombstone stays where the older run 0 holds its key."""
    rows = all_runs(spark, sf_dir)
    return compaction.merged(rows.where(F.col("run_id").between(1, FACTOR)), rows.where("run_id < 1"))


@query(f"WITH {EVENTS}, {VERSIONS} SELECT CAST(count(*) AS BIGINT) AS n_keys, CAST(0 AS BIGINT) AS n_different FROM latest WHERE NOT is_deleted")
def compaction_full_equals_state(spark, sf_dir):
    full = fold.live(compaction.merged(all_runs(spark, sf_dir)))
    state = fold.state(log(spark, sf_dir)).select(F.col("key").alias("k"), F.col("value").alias("v"))
    j = full.join(state, F.col("key") == F.col("k"), "full")
    return j.agg(F.sum(F.col("k").isNotNull().cast("bigint")).alias("n_keys"), F.sum((~F.col("value").eqNullSafe(F.col("v"))).cast("bigint")).alias("n_different"))


@query(f"{WITH}, g AS (SELECT run_id // {FACTOR} AS merge_id, key FROM runs) SELECT CAST(merge_id AS BIGINT) AS merge_id, CAST(count(*) AS BIGINT) AS rows_before, CAST(count(DISTINCT key) AS BIGINT) AS rows_after FROM g GROUP BY merge_id")
def compaction_savings(spark, sf_dir):
    g = all_runs(spark, sf_dir).withColumn("merge_id", F.floor(F.col("run_id") / FACTOR).cast("bigint"))
    return g.groupBy("merge_id", "key").agg(F.count("*").alias("n")).groupBy("merge_id").agg(F.sum("n").alias("rows_before"), F.count("*").alias("rows_after"))


@query(f"{WITH} SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_out_of_order, CAST(0 AS BIGINT) AS n_repeated FROM runs")
def layout_invariants(spark, sf_dir):
    """Runs as they stand in their files: keys rise, and each stands once in a run; both counts of faults must be 0."""
    path = new_path(spark, "runs")
    runs.write_runs(all_runs(spark, sf_dir), path)
    return runs.order_faults(spark.read.parquet(path))
