"""KeyedStore: a log, sorted runs with their Bloom filters, and a manifest under one base path.

Layout: `log/<first seq>-<last seq>-<bytes>-<id>/` (one Parquet folder a write), `runs/<id>/` (one Parquet run, sorted by key, with
Parquet Bloom filters on key), `blooms/<id>/` (the non-zero bytes of the run's own filter, sorted by place), `manifest/<version>.json`
(live runs; `upto`, the largest flushed seq; the writer).

One writer at a time, by fencing: a store's first write makes a manifest version with its name, and then reads the log; a store
that finds a newer version than its own has been fenced and raises `Conflict`, at a write after it has taken the write back.
So no acknowledged write is lost and no seq is given out twice. The batches of a stream may come in any order of their seqs: while a store
has streams, compaction forgets only tombstones up to the seq that `complete` names, and a batch older than what it has
forgotten is refused. Readers pin the version they opened: runs and log
folders go only in `vacuum`, once no manifest version younger than the retention names or needs them."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import manifest
from .functions import bloom
from .operators import compaction
from .operators.fold import latest, live, merge
from .operators.lookup import between, multi_get
from .schema import DELETE, LOG, MAX_LEVEL, PUT, RUN, KeyNotFound, StoreClosed, StoreConfig
from .sources.changelog import normalised, record_bytes, replay

EMPTY = {"runs": [], "upto": -1, "writer": None, "streams": {}, "complete": -1, "forgotten": -1}


class KeyedStore:
    """Open with `KeyedStore.open`; writes go to the log at once, and to runs by flush."""

    def __init__(self, spark: SparkSession, path: str, config: StoreConfig):
        self.spark, self.path, self.config, self.closed = spark, path.rstrip("/"), config, False
        self.fs, _ = manifest.file_system(spark, self.path)
        self.writer: str | None = None
        self.refresh()

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: StoreConfig | None = None) -> KeyedStore:
        """Opens or creates: reads the newest manifest; the log after `upto` is the buffer. No Spark job is run."""
        return cls(spark, path, config or StoreConfig())

    def at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def refresh(self) -> None:
        """Takes over the newest version and the log as it is."""
        self.version, held = manifest.newest(self.spark, f"{self.path}/manifest")
        self.held = held or EMPTY
        self.log = sorted(x for x in self.log_folders() if x[1] > self.upto)  # (first seq, last seq, bytes, name)
        self.frozen: list[int] = []  # last seqs of full buffers that wait to be flushed
        self.next_seq = max([self.upto, *(r["max_seq"] for r in self.runs), *(x[1] for x in self.log)]) + 1

    @property
    def runs(self) -> list[dict]:
        return self.held["runs"]

    @property
    def upto(self) -> int:
        return self.held["upto"]

    def log_folders(self) -> list[tuple[int, int, int, str]]:
        if not self.fs.exists(self.at("log")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.at("log"))]
        return [(*map(int, n.split("-")[:3]), n) for n in names if not n.startswith("_")]

    def check(self) -> None:
        if self.closed:
            raise StoreClosed(self.path)

    # writes

    def claim(self) -> None:
        """Makes this store the writer, or checks that it still is."""
        self.check()
        if self.writer is None:
            writer = uuid.uuid4().hex
            while self.writer is None:
                self.refresh()
                try:
                    self.commit(writer=writer)
                    self.writer = writer
                except manifest.Conflict:
                    continue
            self.refresh()  # what earlier writers have logged meanwhile
        elif max(manifest.files(self.spark, f"{self.path}/manifest"), default=-1) != self.version:
            raise manifest.Conflict(f"{self.path}: another writer has taken over")

    def write(self, log: DataFrame) -> None:
        """Appends rows (seq, op, key, value) as one unit; seq must rise above all before."""
        self.claim()
        name = f"_{uuid.uuid4().hex}"
        normalised(log).select("seq", "op", "key", "value").write.parquet(f"{self.path}/log/{name}")
        s = self.spark.read.schema(LOG).parquet(f"{self.path}/log/{name}").agg(F.min("seq"), F.max("seq"), F.sum(record_bytes()), F.count("*")).first()
        if not s[3] or s[0] < self.next_seq:
            self.fs.delete(self.at(f"log/{name}"), True)
            if s[3]:
                raise ValueError(f"seq {s[0]} is not above those written, next is {self.next_seq}")
            return
        self.appended(name, s[0], s[1], s[2])

    def put_many(self, rows: list[tuple[str, str | None]]) -> None:
        """Puts of many pairs in one write; a value of None deletes. They get consecutive seqs; no job but the write is run."""
        self.claim()
        if not rows:
            return
        data = [(self.next_seq + i, DELETE if v is None else PUT, k, v) for i, (k, v) in enumerate(rows)]
        frame = normalised(self.spark.createDataFrame(data, LOG)).coalesce(1)
        name = f"_{uuid.uuid4().hex}"
        frame.write.parquet(f"{self.path}/log/{name}")
        size = sum(len(k.encode()) + (13 if v is None else len(v.encode())) for k, v in rows)
        self.appended(name, data[0][0], data[-1][0], size)

    def appended(self, name: str, first: int, last: int, size: int) -> None:
        """Shows a written log folder, takes it back if the store has been fenced meanwhile, and flushes when buffers are full."""
        final = f"{first}-{last}-{size}-{name[1:]}"
        self.fs.rename(self.at(f"log/{name}"), self.at(f"log/{final}"))
        try:
            self.claim()
        except manifest.Conflict:
            self.fs.delete(self.at(f"log/{final}"), True)
            raise
        self.log.append((first, last, size, final))
        self.next_seq = last + 1
        begin = self.frozen[-1] if self.frozen else self.upto
        if sum(x[2] for x in self.log if x[1] > begin) >= self.config.memtable_size:
            self.frozen.append(last)
        while len(self.frozen) > self.config.max_immutable:
            self.flush_upto(self.frozen[0])

    def put(self, key: str, value: str) -> None:
        self.put_many([(key, value)])

    def delete(self, key: str) -> None:
        """Writes a tombstone, whether or not the key exists."""
        self.put_many([(key, None)])

    # reads

    def buffered(self, upto: int | None = None) -> DataFrame:
        """The logged changes that no run holds yet."""
        paths = [f"{self.path}/log/{x[3]}" for x in self.log if x[1] > self.upto and (upto is None or x[0] <= upto)]
        if not paths:
            return self.spark.createDataFrame([], LOG)
        return replay(self.spark, paths, self.upto)

    def read(self, runs: list[dict]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.schema(RUN).parquet(*[f"{self.path}/runs/{r['run_id']}" for r in runs])

    def versions(self, low: str = "", high: str = "") -> DataFrame:
        """The newest version of each key in the range: runs outside it are not read."""
        self.check()
        runs = [r for r in self.runs if (not high or r["min_key"] <= high) and (not low or r["max_key"] >= low)]
        return merge(between(latest(self.buffered()), low, high).unionByName(between(self.read(runs), low, high)))

    def state(self) -> DataFrame:
        return live(self.versions())

    def scan(self, low: str = "", high: str = "") -> DataFrame:
        return live(self.versions(low, high)).orderBy("key")

    def cursor(self, low: str = "", high: str = "") -> Iterator[Row]:
        """The rows (key, value) of a range in key order, one after the other; partitions are fetched as they are reached."""
        return self.scan(low, high).toLocalIterator()

    def get(self, key: str) -> str:
        self.check()
        runs = self.holding(key)
        rows = latest(self.buffered().where(F.col("key") == key)).unionByName(self.read(runs).where(F.col("key") == key))
        found = live(merge(rows)).collect()
        if not found:
            raise KeyNotFound(key)
        return found[0].value

    def multi_get(self, probes: DataFrame) -> DataFrame:
        return multi_get(self.versions(), probes)

    # single runs

    def run_of(self, run_id: str) -> dict:
        self.check()
        return next(r for r in self.runs if r["run_id"] == run_id)

    def holding(self, key: str) -> list[dict]:
        """Runs that may hold the key: by their key ranges, and then by k bytes of each one's stored filter."""
        runs = [r for r in self.runs if r["min_key"] <= key <= r["max_key"]]
        asked = None
        for r in runs:
            places = set(bloom.places(key, r["bloom_k"], r["bloom_m"]))
            bytes_ = self.spark.read.schema("byte bigint, bits int").parquet(f"{self.path}/blooms/{r['run_id']}").where(F.col("byte").isin(sorted({p >> 3 for p in places})))
            part = bytes_.select(F.lit(r["run_id"]).alias("run_id"), "byte", "bits")
            asked = part if asked is None else asked.union(part)
        set_ = {(x.run_id, x.byte): x.bits for x in asked.collect()} if asked is not None else {}  # at most k rows a run
        may = lambda r: all(set_.get((r["run_id"], p >> 3), 0) >> (p & 7) & 1 for p in bloom.places(key, r["bloom_k"], r["bloom_m"]))
        return [r for r in runs if may(r)]

    def may_contain(self, run_id: str, key: str) -> bool:
        """The filter's answer for one run; no row of the run is read."""
        self.run_of(run_id)
        return any(r["run_id"] == run_id for r in self.holding(key))

    def get_from_run(self, run_id: str, key: str) -> tuple[str | None, bool, bool]:
        """(value, found, is_tombstone) of a key in one run."""
        run = self.run_of(run_id)
        found = self.read([run]).where(F.col("key") == key).collect() if self.may_contain(run_id, key) else []
        return (found[0].value, True, found[0].is_deleted) if found else (None, False, False)

    def iterate(self, run_id: str) -> DataFrame:
        """A run's rows in key order, tombstones kept."""
        return self.read([self.run_of(run_id)]).orderBy("key")

    # layout

    def add_run(self, rows: DataFrame, level: int) -> dict | None:
        """Writes a sorted run and its filter, and returns its manifest entry; None if there are no rows."""
        run_id = uuid.uuid4().hex
        path = f"{self.path}/runs/{run_id}"
        rows = rows.select("key", "seq", "is_deleted", "value").repartitionByRange("key").sortWithinPartitions("key")
        rows.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)
        size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
        held = self.spark.read.schema(RUN).parquet(path)
        s = held.agg(F.min("seq"), F.max("seq"), F.min("key"), F.max("key"), F.count("*"), F.sum(F.col("is_deleted").cast("bigint")), F.sum(size)).first()
        if not s[4]:
            self.fs.delete(self.at(f"runs/{run_id}"), True)
            return None
        m, k = bloom.sizes(s[4], self.config.bits_per_key)
        bloom.encoded(bloom.filter_bits(held, k, m)).repartitionByRange("byte").sortWithinPartitions("byte").write.parquet(f"{self.path}/blooms/{run_id}")
        return dict(zip(("run_id", "level", "min_seq", "max_seq", "min_key", "max_key", "n_entries", "n_tombstones", "n_bytes", "bloom_m", "bloom_k"), (run_id, level, *s, m, k)))

    def commit(self, **changes) -> None:
        """The next manifest version, made exclusively; then it is what this store reads."""
        held = {**self.held, **changes}
        manifest.create(self.spark, f"{self.path}/manifest", self.version + 1, held)
        self.version, self.held = self.version + 1, held
        self.log = [x for x in self.log if x[1] > self.upto]
        self.frozen = [x for x in self.frozen if x > self.upto]

    def flush_upto(self, last: int) -> None:
        run = self.add_run(latest(self.buffered(last).where(F.col("seq") <= last)), 0)
        self.commit(runs=[*self.runs, *([run] if run else [])], upto=last)
        self.tend()

    def flush(self) -> None:
        """The buffered changes become a level-0 run; compaction follows when enough have gathered."""
        if not self.log and not self.closed:
            return
        self.claim()
        if self.log:
            self.flush_upto(max(x[1] for x in self.log))

    def add_batch(self, log: DataFrame, stream: str, batch_id: int) -> None:
        """A micro-batch of a stream as a level-0 run; one that the manifest names as done is left out. A batch that reaches below a
        tombstone that compaction has forgotten is an error: its older versions would come back."""
        self.claim()
        if self.held["streams"].get(stream, -1) >= batch_id:
            return
        run = self.add_run(latest(log), 0)
        if run and run["min_seq"] <= self.held["forgotten"]:
            for name in ("runs", "blooms"):
                self.fs.delete(self.at(f"{name}/{run['run_id']}"), True)
            raise ValueError(f"seq {run['min_seq']} is not above {self.held['forgotten']}, up to which tombstones are forgotten")
        self.commit(runs=[*self.runs, *([run] if run else [])], streams={**self.held["streams"], stream: batch_id})
        self.next_seq = max(self.next_seq, (run or {"max_seq": -1})["max_seq"] + 1)
        self.tend()

    def complete(self, seq: int) -> None:
        """Says that all changes up to `seq` have come, so that compaction may forget tombstones up to there."""
        self.claim()
        self.commit(complete=max(seq, self.held["complete"]))

    def tend(self) -> None:
        """What follows a new run: compaction when due, and removal of what nothing needs any more."""
        if sum(r["level"] == 0 for r in self.runs) >= self.config.compaction_factor:
            self.compact()
        self.vacuum()

    def compact(self) -> None:
        """One pass over the levels. Inputs stay for the readers of older versions."""
        self.claim()
        complete = self.held["complete"] if self.held["streams"] else None  # a store's own writes come in order
        levels: dict[int, list[tuple[str, int]]] = {}
        for r in self.runs:
            levels.setdefault(r["level"], []).append((r["run_id"], r["max_seq"]))
        for m in compaction.plan(levels, self.config.compaction_factor, MAX_LEVEL):
            inputs = [r for r in self.runs if r["run_id"] in m.run_ids]
            older = [r for r in self.runs if r not in inputs and r["min_seq"] < max(x["max_seq"] for x in inputs)]
            run = self.add_run(compaction.merged(self.read(inputs), self.read(older) if older else None, complete), m.level + 1)
            last = max([r["max_seq"] for r in inputs if r["n_tombstones"]], default=-1)
            forgotten = max(self.held["forgotten"], last if complete is None else min(last, complete))
            self.commit(runs=[r for r in self.runs if r not in inputs] + ([run] if run else []), forgotten=forgotten)

    def vacuum(self, retention_s: float | None = None) -> None:
        """Removes manifest versions that were replaced longer ago than the retention, and the runs, filters and log folders that those left
        don't need; unfinished files of that age as well."""
        self.claim()
        before = int((time.time() - (self.config.retention_s if retention_s is None else retention_s)) * 1000)
        folder, kept = f"{self.path}/manifest", [self.held]
        manifest.clear(self.spark, folder, before)
        replaced = None  # when the version before was made, which replaced this one
        for version, status in sorted(manifest.files(self.spark, folder).items(), reverse=True):
            if replaced is not None:
                held = manifest.content(self.spark, folder, version)
                if held is not None and replaced >= before:
                    kept.append(held)
                else:
                    self.fs.delete(status.getPath(), False)
            replaced = status.getModificationTime()
        used, upto = {r["run_id"] for h in kept for r in h["runs"]}, min(h["upto"] for h in kept)
        for name in ("runs", "blooms"):
            for s in self.fs.listStatus(self.at(name)) if self.fs.exists(self.at(name)) else []:
                if s.getPath().getName() not in used and s.getModificationTime() < before:
                    self.fs.delete(s.getPath(), True)
        for s in self.fs.listStatus(self.at("log")) if self.fs.exists(self.at("log")) else []:
            name = s.getPath().getName()
            if s.getModificationTime() < before and (name.startswith("_") or int(name.split("-")[1]) <= upto):
                self.fs.delete(s.getPath(), True)

    def close(self) -> None:
        """Flushes what is buffered; closing twice is harmless."""
        if not self.closed:
            self.flush()
            self.closed = True
