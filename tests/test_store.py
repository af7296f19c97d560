"""The store: lifecycle, layout invariance, defects of older designs that must not come back."""

import random

import pytest
from pyspark.sql import functions as F

from loam.manifest import Conflict
from loam.operators import compaction, fold, lookup, runs
from loam.schema import LOG, KeyNotFound, StoreClosed, StoreConfig
from loam.sources.changelog import normalised
from loam.store import KeyedStore
from loam.streaming import ingest

EDGE = [
    (0, 0, "a", "1"), (1, 0, "a", "2"), (2, 0, "b", "x"), (3, 1, "b", None), (4, 0, "b", "again"), (5, 1, "never", None),
    (6, 0, "empty", ""), (7, 0, "", "empty key"), (8, 0, "é", "accent"), (9, 0, "s", "v"), (10, 0, "s", "__TOMBSTONE__"), (11, 7, "a", "unknown op"),
]
EDGE_STATE = {"a": "2", "b": "again", "empty": "", "": "empty key", "é": "accent"}


def model(rows):
    out = {}
    for _, op, k, v in sorted(rows, key=lambda r: r[0]):
        if op == 0 and v != "__TOMBSTONE__":
            out[k] = v
        elif op in (0, 1):
            out.pop(k, None)
    return out


def as_dict(df):
    return {r.key: r.value for r in df.collect()}


def test_edges(spark):
    rows = spark.createDataFrame(EDGE, LOG)
    assert model(EDGE) == EDGE_STATE == as_dict(fold.state(normalised(rows)))


def test_lifecycle(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    s = KeyedStore.open(spark, path, StoreConfig(memtable_size=1 << 20))
    s.put("k", "1")
    s.put("k", "2")
    assert s.get("k") == "2"
    s.delete("k")
    with pytest.raises(KeyNotFound):
        s.get("k")
    s.delete("absent")
    s.put("k", "3")
    s.close()
    s.close()
    with pytest.raises(StoreClosed):
        s.get("k")
    again = KeyedStore.open(spark, path)
    assert again.get("k") == "3" and as_dict(again.state()) == {"k": "3"}
    again.put("z", "")
    assert as_dict(KeyedStore.open(spark, path).state()) == {"k": "3", "z": ""}  # unflushed changes survive


@pytest.mark.parametrize("waiting", [0, 2])
def test_layout_does_not_change_answers(spark, tmp_path, waiting):
    """State from the log = from runs = after compaction = after reopening, over repeated keys, deletes and re-puts."""
    r = random.Random(5)
    rows = [(i, int(r.random() < 0.3), f"k{r.randint(0, 12):02d}", None) for i in range(200)]
    rows = [(i, op, k, None if op else f"v{i}") for i, op, k, _ in rows]
    s = KeyedStore.open(spark, f"file://{tmp_path}/s", StoreConfig(memtable_size=300, compaction_factor=3, max_immutable=waiting, retention_s=0))
    for a in range(0, 200, 25):
        s.write(spark.createDataFrame(rows[a : a + 25], LOG))
        assert as_dict(s.state()) == model(rows[: a + 25])
    assert any(x["level"] > 0 for x in s.runs) or waiting
    want = model(rows)
    s.close()
    s = KeyedStore.open(spark, f"file://{tmp_path}/s")
    assert as_dict(s.state()) == want
    assert [x.key for x in s.scan("k03", "k07").collect()] == [k for k in sorted(want) if "k03" <= k <= "k07"]
    probes = spark.createDataFrame([("k01",), ("nope",)], "key string")
    got = {x.key: x for x in s.multi_get(probes).collect()}
    assert not got["nope"].found and got["k01"].value == want.get("k01")


def test_tombstone_stays_while_an_older_run_holds_the_key(spark):
    rows = spark.createDataFrame([("a", 5, True, None), ("b", 6, True, None)], "key string, seq long, is_deleted boolean, value string")
    older = spark.createDataFrame([("a", 1, False, "old")], rows.schema)
    assert [x.key for x in compaction.merged(rows, older).collect()] == ["a"]
    assert compaction.merged(rows).count() == 0


def test_pass_plan():
    assert compaction.passes(35, 4) == {0: 3, 1: 4, 2: 1}
    assert compaction.passes(42, 4) == {0: 2, 1: 2, 2: 2}
    assert compaction.passes(447, 4) == {0: 3, 1: 3, 2: 3, 3: 2, 4: 1}


def test_settings():
    with pytest.raises(ValueError):
        StoreConfig(compaction_factor=1)
    assert StoreConfig().memtable_size == 4194304


def test_flush_counts(spark):
    from loam.operators.runs import exact_flushes
    from loam.plans.keyed import log

    assert exact_flushes(log(spark, "/root/testdata/sf0.001"), 4096).first().n_flushes == 4
    assert exact_flushes(log(spark, "/root/testdata/sf0.01"), 4096).first().n_flushes == 42


def test_stream_takes_up_where_it_stopped(spark, tmp_path):
    base = f"file://{tmp_path}"
    first = spark.createDataFrame([(0, 0, "a", "1"), (1, 0, "b", "1")], LOG)
    first.coalesce(1).write.parquet(f"{base}/log")
    ingest.ingest(spark, f"{base}/log", f"{base}/runs", f"{base}/cp")
    spark.createDataFrame([(2, 1, "a", None), (3, 0, "b", "2")], LOG).coalesce(1).write.mode("append").parquet(f"{base}/log")
    ingest.ingest(spark, f"{base}/log", f"{base}/runs", f"{base}/cp")
    assert as_dict(ingest.state(spark, f"{base}/runs")) == {"b": "2"}


def test_bloom_golden(spark):
    from loam.functions import bloom as B

    p = spark.createDataFrame([(1000, 10), (0, 10), (1000, 0), (1000, 20)], "n int, b int").select(B.probes(F.col("n"), F.col("b")), B.bits(F.col("n"), F.col("b")))
    assert [tuple(r) for r in p.collect()] == [(7, 10000), (7, 10), (7, 10000), (14, 20000)]
    keys = spark.createDataFrame([("",), ("a",), ("hello",), ("é",)], "key string")
    assert [r.h for r in keys.select(B.fnv("key").alias("h")).collect()] == [2166136261, 3826002220, 1335831723, 513665217]
    a = keys.where("key = 'a'").select(B.locations(B.fnv("key"), 7, 10000).alias("p")).first().p
    assert a == [2284, 5937, 4946, 7903, 8824, 5021, 1486]
    empty = spark.createDataFrame([], "pos bigint")
    assert not B.may_contain(keys, empty, 7, 10000).where("may_contain").count()


def folders(path, name):
    import os

    return sorted(x for x in os.listdir(path / "s" / name) if not x.startswith("."))


def test_two_writers(spark, tmp_path):
    """The later writer fences the earlier one, whose next write is refused; nothing acknowledged is lost, no seq given twice."""
    path = f"file://{tmp_path}/s"
    one, two = KeyedStore.open(spark, path), KeyedStore.open(spark, path)
    one.put("x", "1")
    two.put("y", "2")
    with pytest.raises(Conflict):
        one.put("z", "3")
    with pytest.raises(Conflict):
        one.flush()
    two.flush()
    again = KeyedStore.open(spark, path)
    assert as_dict(again.state()) == {"x": "1", "y": "2"} and again.next_seq == 2
    assert {r.key: r.seq for r in again.versions().collect()} == {"x": 0, "y": 1}


def test_readers_keep_their_version(spark, tmp_path):
    """A reader opened before a compaction reads on after it; vacuum removes what no version in its time needs."""
    path = f"file://{tmp_path}/s"
    s = KeyedStore.open(spark, path, StoreConfig(compaction_factor=2))
    s.put("a", "1")
    s.flush()
    s.put("b", "2")
    reader = KeyedStore.open(spark, path)
    s.flush()
    s.put("a", "3")
    s.flush()
    s.flush()
    assert [r["level"] for r in s.runs] == [1, 0]
    assert as_dict(reader.state()) == {"a": "1", "b": "2"} and reader.get("a") == "1"
    assert len(folders(tmp_path, "log")) == 3 and len(folders(tmp_path, "runs")) == 4
    s.vacuum(0)
    assert folders(tmp_path, "log") == [] and len(folders(tmp_path, "runs")) == len(folders(tmp_path, "blooms")) == 2 and len(folders(tmp_path, "manifest")) == 1
    assert as_dict(KeyedStore.open(spark, path).state()) == {"a": "3", "b": "2"}


def test_version_is_kept_from_when_it_was_replaced(spark, tmp_path):
    """A version made long ago and replaced just now still serves its readers."""
    import os
    import time

    path = f"file://{tmp_path}/s"
    s = KeyedStore.open(spark, path, StoreConfig(compaction_factor=2))
    for i in range(2):
        s.put("a", str(i))
        s.flush()
    reader = KeyedStore.open(spark, path)
    ago = time.time() - 9000
    for top, names, files in os.walk(tmp_path / "s"):
        for x in [*names, *files]:
            os.utime(os.path.join(top, x), (ago, ago))
    s.put("a", "2")
    s.flush()
    s.vacuum()
    assert as_dict(reader.state()) == {"a": "1"} and as_dict(s.state()) == {"a": "2"}


def test_unfinished_version_is_none(spark, tmp_path):
    from loam import manifest

    path = f"file://{tmp_path}/s"
    s = KeyedStore.open(spark, path)
    s.put("a", "1")
    (tmp_path / "s" / "manifest" / "9.json").write_text('{"runs": [')
    assert as_dict(KeyedStore.open(spark, path).state()) == {"a": "1"}
    with pytest.raises(Conflict):
        s.put("b", "2")
    manifest.clear(spark, f"{path}/manifest", 1 << 60)
    s.put("b", "2")
    assert as_dict(s.state()) == {"a": "1", "b": "2"}


def test_full_buffers_wait(spark, tmp_path):
    s = KeyedStore.open(spark, f"file://{tmp_path}/s", StoreConfig(memtable_size=10, max_immutable=2))
    for i in range(4):
        s.put(f"key{i}", "0123456789")
        assert len(s.frozen) == min(i + 1, 2) and len(s.runs) == max(0, i - 1)
    s.put_many([("key0", None), ("more", "x"), ("key9", "y" * 20)])
    assert as_dict(s.state()) == {"key1": "0123456789", "key2": "0123456789", "key3": "0123456789", "more": "x", "key9": "y" * 20}
    with pytest.raises(ValueError):
        s.write(spark.createDataFrame([(2, 0, "late", "z")], LOG))


def test_single_runs(spark, tmp_path):
    """Lookups in one run by its stored filter; a get reads no run whose filter denies the key."""
    s = KeyedStore.open(spark, f"file://{tmp_path}/s", StoreConfig(compaction_factor=9))
    s.put_many([("a", "1"), ("b", "2"), ("z", "3")])
    s.flush()
    s.put_many([("a", "4"), ("b", None), ("y", "5")])
    s.flush()
    old, new = (r["run_id"] for r in s.runs)
    assert s.get_from_run(old, "b") == ("2", True, False) and s.get_from_run(new, "b") == (None, True, True) and s.get_from_run(new, "z") == (None, False, False)
    assert [r.key for r in s.iterate(new).collect()] == ["a", "b", "y"] and [r.key for r in s.cursor("a", "y")] == ["a", "y"]
    assert s.may_contain(old, "a") and [r["run_id"] for r in s.holding("y")] == [new]
    absent = [k for k in ("bb", "c", "cc", "m", "q", "xyz") if not s.holding(k)]
    assert len(absent) >= 4
    from loam.operators.fold import merge

    plan = s.read(s.runs).where(F.col("key") == "a")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,a)" in plan.split("PushedFilters")[1] and merge(s.read(s.runs)).count() == 4


def test_stream_into_a_store(spark, tmp_path):
    """Batches become runs with compaction behind them; one that comes again is left out."""
    base = f"file://{tmp_path}"
    rows = [(i, int(i % 7 == 0), f"k{i % 11:02d}", None if i % 7 == 0 else f"v{i}") for i in range(60)]
    spark.createDataFrame(rows, LOG).repartitionByRange(5, "seq").write.parquet(f"{base}/in")
    s = KeyedStore.open(spark, f"{base}/s", StoreConfig(compaction_factor=2))
    ingest.ingest_into(s, f"{base}/in", f"{base}/cp")
    assert as_dict(s.state()) == model(rows) and any(r["level"] > 0 for r in s.runs)
    before = s.version
    s.add_batch(spark.createDataFrame([(99, 0, "k00", "twice")], LOG), "log", 0)
    assert s.version == before and as_dict(KeyedStore.open(spark, f"{base}/s").state()) == model(rows)
    s.put("k00", "later")
    assert s.get("k00") == "later"


@pytest.mark.parametrize("seed", range(3))
def test_stream_in_any_order(spark, tmp_path, seed):
    """Batches whose seqs fall: older puts that come after a compaction don't come back over tombstones."""
    r = random.Random(seed)
    rows = [(i, int(r.random() < 0.4), f"k{r.randint(0, 9)}", None) for i in range(80)]
    rows = [(i, op, k, None if op else f"v{i}") for i, op, k, _ in rows]
    parts = [rows[a : a + 10] for a in range(0, 80, 10)]
    r.shuffle(parts)
    parts.sort(key=lambda p: -p[0][0] if seed == 0 else 0)  # newest first, or any order
    s = KeyedStore.open(spark, f"file://{tmp_path}/s", StoreConfig(compaction_factor=2))
    for i, part in enumerate(parts):
        s.add_batch(spark.createDataFrame(part, LOG), "log", i)
        assert as_dict(s.state()) == model([x for p in parts[: i + 1] for x in p])
    assert any(x["level"] > 0 for x in s.runs) and s.held["forgotten"] == -1
    kept = sum(x["n_tombstones"] for x in s.runs)
    s.complete(79)
    for i in range(80, 84):
        s.put(f"k{i}", "x")
        s.flush()
    for _ in range(4):
        s.compact()
    assert sum(x["n_tombstones"] for x in s.runs) < kept and s.held["forgotten"] > 0
    assert as_dict(s.state()) == {**model(rows), **{f"k{i}": "x" for i in range(80, 84)}}
    with pytest.raises(ValueError):
        s.add_batch(spark.createDataFrame([(0, 0, "k0", "late")], LOG), "log", 99)


def test_ranks_of_many_keys(spark):
    """Ranks over a million keys in few and many ranges: each one once, in key order."""
    n = 1_000_000
    rows = spark.range(n).select(F.format_string("k%07d", F.col("id")).alias("key"), F.col("id").alias("at"))
    for parts in (4, 37):
        got = lookup.ordinals(rows.repartition(6), parts)
        assert got.where("rank <> at + 1").count() == 0 and got.select("rank").distinct().count() == n
    few = spark.createDataFrame([("b",), ("a",), ("é",), ("",)], "key string")
    assert [r.key for r in lookup.ordinals(few, 9).orderBy("rank").collect()] == ["", "a", "b", "é"]
    assert lookup.ordinals(few.where("false")).count() == 0


def test_order_faults_are_found(spark, tmp_path):
    """Files whose keys fall, repeat, or stand in two files of a run."""
    good = spark.createDataFrame([(1, 0, k, 0) for k in "abc"], "run_id int, level int, key string, seq int")
    runs.write_runs(good, f"{tmp_path}/good")
    assert tuple(runs.order_faults(spark.read.parquet(f"{tmp_path}/good")).first()) == (3, 0, 0)
    for i, keys in enumerate(["acb", "abb", "cba"]):
        spark.createDataFrame([(1, k) for k in keys], "run_id int, key string").coalesce(1).write.parquet(f"{tmp_path}/bad{i}")
    found = [tuple(runs.order_faults(spark.read.parquet(f"{tmp_path}/bad{i}")).first()) for i in range(3)]
    assert found == [(3, 1, 0), (3, 0, 1), (3, 2, 0)]
    good.select("run_id", "key").coalesce(1).write.mode("append").parquet(f"{tmp_path}/bad0")
    assert runs.order_faults(spark.read.parquet(f"{tmp_path}/bad0")).first().n_repeated == 3


def test_running_sums_in_blocks_of_blocks(spark):
    import itertools

    r = random.Random(8)
    at = sorted(r.sample(range(1 << 36), 300))
    sizes = [r.randint(0, 9) for _ in at]
    rows = spark.createDataFrame(list(zip(at, sizes)), "_block long, _sum long")
    want = dict(zip(at, itertools.accumulate([0, *sizes[:-1]])))
    for levels in (0, 1, 2):
        assert {x._b: x._from for x in runs.running_offsets(rows, levels).collect()} == want


def test_shared_folder_off_one_machine():
    from loam.paths import shared_dir

    class Far:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://somewhere"

    with pytest.raises(ValueError):
        shared_dir(Far)
