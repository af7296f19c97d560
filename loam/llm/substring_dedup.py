"""Substring dedup over a log-structured fingerprint index.

Windows of `size` consecutive words are not stored one by one. The smallest hash among a window's k-word grams
(k = size/2, leftmost of equals) is its anchor; consecutive windows of a text with one anchor form a segment, so a
text leaves about one index row for a dozen words. A row is (a: anchor hash, g: hash of all the segment's words by
an independent family, doc_id, place). What windows a text shares is decided from its segments alone:

* equal (a, g): the segment stands word for word in a smaller doc_id, so all of it is covered;
* equal a, another g: some of its windows may still be shared. The smallest doc_id of each (a, g) is read again at every
  place that holds it, and these windows alone are compared by two independent 64-bit hashes (the verification).

`FingerprintIndex` keeps sorted immutable runs, one a batch, on shared storage, dealt to buckets when they are written. A new
batch's run is merge-joined with each live run, bucket by bucket; what shares an anchor goes with the batch into one stream
sorted by (a, g, doc_id). When `fanout` runs have gathered, they are compacted by merge joins into one that keeps the smallest
doc_id of each (a, g). Batches must come in ascending doc_id order to give the same as one batch. Of a passage that very
many texts share, each Arrow batch of texts settles all but its smallest doc_id by itself, before anything is moved.

Defined results: null, blank or short texts: nothing removed. A null doc_id neither loses words nor takes any. Rows
with the same doc_id don't cover each other. Extra columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .. import manifest
from ..paths import new_path
from . import text as T
from .common import Marker, drop, drop_path, only, partitions, small_arrow_batches, written

SEGMENT = "a bigint, g bigint, doc_id bigint, tag int, at int, n int"
SEGMENT_COLUMNS = ("a", "g", "doc_id", "tag", "at", "n")
_SEGMENT = pa.schema([("whole", pa.bool_()), ("a", pa.int64()), ("g", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int32()), ("at", pa.int32()), ("n", pa.int32())])
SPAN = "whole boolean, doc_id bigint, tag int, at int, n int"
_SPAN = pa.schema([("whole", pa.bool_()), ("doc_id", pa.int64()), ("tag", pa.int32()), ("at", pa.int32()), ("n", pa.int32())])


def window_min(h: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the leftmost minimum of h[i:i+width]."""
    at, have = np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(h[right] < h[left], right, left)
        have += step
    return at


def segments(size: int):
    """All segments of the texts. Of equal (a, g) in one batch only the smallest doc_id's are open; the others are covered."""
    k = size // 2

    def run(batches):
        for batch in batches:
            ids, tags, texts = (batch.column(c) for c in ("doc_id", "tag", "text"))
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            for lo, hi in T.chunks(texts):
                w = T.Words(texts[lo:hi])
                if len(w.start) < size:
                    continue
                gram, whole = T.sequences(w.hashes(), k), T.sequences(w.hashes(1), size, 1)
                at = window_min(gram, size - k + 1)
                ok = np.flatnonzero(w.doc[: len(whole)] == w.doc[size - 1 :])
                if not len(ok):
                    continue
                new = np.ones(len(ok), bool)
                new[1:] = (at[ok[1:]] != at[ok[:-1]]) | (ok[1:] != ok[:-1] + 1)
                start = ok[new]
                count = np.diff(np.concatenate([np.flatnonzero(new), [len(ok)]]))
                # first and last window, which leave out no word of a segment, say all its words
                g = T.mix(T.mix(whole[start]) + whole[start + count - 1] + (at[start] - start + 1000 * count).astype(np.uint64))
                a, row = gram[at[start]], w.doc[start]
                # a periodic text repeats one segment end to end: such a row of equals is one span
                same = (a[1:] == a[:-1]) & (g[1:] == g[:-1]) & (row[1:] == row[:-1]) & (start[1:] == start[:-1] + count[:-1])
                first = np.flatnonzero(np.concatenate([[True], ~same]))
                a, g, row, start, count = a[first], g[first], row[first], start[first], np.add.reduceat(count, first)
                for held, x in zip(out, (a.view(np.int64), g.view(np.int64), row + lo, start - w.first[row], count)):
                    held.append(x)
            if out[0]:
                a, g, row, at, n = (np.concatenate(x) for x in out)
                doc = ids.to_numpy()[row]
                order = np.lexsort((doc, g, a))
                begin = np.flatnonzero(np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (g[order][1:] != g[order][:-1])]))
                low = np.empty(len(a), np.int64)
                low[order] = np.repeat(doc[order][begin], np.diff(np.concatenate([begin, [len(a)]])))
                yield pa.RecordBatch.from_arrays([pa.array(doc > low), pa.array(a), pa.array(g), pa.array(doc), tags.take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], schema=_SEGMENT)
        T.give_back()

    return run


def merged(batches):
    """From segments sorted by (a, g, doc_id): spans covered whole, and where an anchor has several g those to be verified.

    To be verified are, of each (a, g), the first row and all new rows of its smallest doc_id; an old one stands for its
    equals. Held from batch to batch: the last (a, g), its smallest doc_id, and such rows while it is its anchor's only g."""
    at_a = at_g = owner = None
    several, held = False, []
    for batch in batches:
        c = {name: batch.column(name).to_numpy() for name in ("a", "g", "doc_id", "tag", "at", "n")}
        c["old"] = batch.column("old").to_numpy(zero_copy_only=False)
        a, g, doc = c["a"], c["g"], c["doc_id"]
        if not len(a):
            continue
        new_a, new_g = np.ones(len(a), bool), np.ones(len(a), bool)
        new_a[1:] = a[1:] != a[:-1]
        new_a[0] = at_a is None or a[0] != at_a
        new_g[1:] = g[1:] != g[:-1]
        new_g[0] = at_g is None or g[0] != at_g
        new_g |= new_a
        start = np.flatnonzero(new_g)
        of = np.cumsum(new_g) - 1
        low = np.where(of >= 0, doc[start[np.maximum(of, 0)]] if len(start) else 0, owner if owner is not None else 0)
        yield from spans(c, np.flatnonzero(~c["old"] & (doc > low)), True)
        # the rows to be verified of each (a, g), by anchor
        open_rows = new_g | (~c["old"] & (doc == low))
        group = np.cumsum(new_a)  # 0: the anchor that was open before
        size = np.bincount(group[start], minlength=int(group[-1]) + 1)
        show = size >= 2
        show[0] = several or size[0] > 0
        if show[0]:
            for x in held:
                yield from spans(x, np.arange(len(x["a"])), False)
            held = []
        only_doc = np.zeros(len(size), bool)
        begin = np.flatnonzero(new_a)
        if len(begin):
            lowest, highest = np.minimum.reduceat(doc, begin), np.maximum.reduceat(doc, begin)
            fresh = np.logical_or.reduceat(~c["old"], begin)
            only_doc[1:] = (lowest == highest) | ~fresh
            only_doc[-1] = False  # may go on
            held = []
        yield from spans(c, np.flatnonzero(open_rows & (show & ~only_doc)[group]), False)
        several = bool(show[-1])
        if not several:
            last = np.flatnonzero(open_rows & (group == group[-1]))
            held.append({k: v[last] for k, v in c.items()})
        at_a, at_g, owner = a[-1], g[-1], low[-1]


def spans(c, rows, whole):
    if len(rows):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), whole)), *(pa.array(c[x][rows]) for x in ("doc_id", "tag", "at", "n"))], schema=_SPAN)


WINDOW = "w1 bigint, w2 bigint, doc_id bigint, tag int, at int"
_WINDOW = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int32()), ("at", pa.int32())])


def windows(size: int):
    """Hashes of the windows that start in the listed spans."""

    def run(batches):
        for batch in batches:
            ids, tags, texts, lists = (batch.column(c) for c in ("doc_id", "tag", "text", "spans"))
            for lo, hi in T.chunks(texts):
                w = T.Words(texts[lo:hi])
                part = lists[lo:hi]
                count = np.diff(part.offsets.to_numpy())
                flat = part.flatten()
                at, n = flat.field("at").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
                row = np.repeat(np.repeat(np.arange(hi - lo), count), n)
                pos = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                both = np.unique(np.stack([row, pos], 1), axis=0)
                row, pos = both[:, 0], both[:, 1]
                start = w.first[row] + pos
                h = [T.sequences(w.hashes(j), size, j)[start].view(np.int64) for j in (0, 1)]
                where = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), ids[lo:hi].take(where), tags[lo:hi].take(where), pa.array(pos.astype(np.int32))], schema=_WINDOW)
        T.give_back()

    return run


class FingerprintIndex:
    """Sorted immutable runs of segments in one folder of shared storage, with a manifest; `documents` gives the texts to verify against.

    A run is dealt to buckets by its anchors and sorted once, when it is written; later it is merge-joined bucket by bucket, and
    only rows whose anchor the new batch has as well are moved. A manifest version names the live runs; an index
    opened at its path goes on from there. `path` and `buckets` are taken from the manifest of an index that exists."""

    def __init__(self, documents: DataFrame, size: int = 50, fanout: int = 2, path: str | None = None, buckets: int | None = None):
        self.spark, self.size, self.fanout = documents.sparkSession, size, fanout
        self.path, self.documents, self.spans = path or new_path(self.spark, "index"), documents, []
        self.version, held = manifest.newest(self.spark, f"{self.path}/manifest")
        held = held or {"runs": [], "buckets": buckets or partitions(self.spark)}
        self.runs, self.buckets = held["runs"], held["buckets"]
        # of results these say nothing: sorted files count as sorted, and a join on (a, g) takes buckets of a
        self.spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")

    def run(self, rows: DataFrame, dealt: bool = False) -> str:
        """Writes a run; `dealt`: the rows come in its buckets already."""
        name = f"run_{uuid.uuid4().hex}"
        rows = rows if dealt else rows.repartition(self.buckets, "a")
        rows.select(*SEGMENT_COLUMNS).write.bucketBy(self.buckets, "a").sortBy("a", "g").option("path", f"{self.path}/{name}").format("parquet").saveAsTable(name)
        return name

    def rows(self, name: str) -> DataFrame:
        """A run, known to this session's catalog as a bucketed table."""
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({SEGMENT}) USING parquet CLUSTERED BY (a) SORTED BY (a, g) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(name)

    def matched(self, name: str, anchors: DataFrame) -> DataFrame:
        """Rows of an old run whose anchor is among those of another, both read bucket by bucket."""
        return self.rows(name).join(anchors.hint("merge"), "a", "left_semi")

    def add(self, batch: DataFrame) -> DataFrame:
        """Indexes a batch; returns its spans: (whole: covered, else to be verified; doc_id, tag, at, n)."""
        if len(self.runs) >= self.fanout:
            self.compact()
        found = written(batch.where("doc_id is not null").select("doc_id", "tag", "text").mapInArrow(segments(self.size), f"whole boolean, {SEGMENT}"), "segments")
        fresh = found.where("not whole").drop("whole")
        name = self.run(fresh)
        rows = fresh.withColumn("old", F.lit(False))
        for old in self.runs:
            rows = rows.union(self.matched(old, self.rows(name).select("a")).withColumn("old", F.lit(True)))
        stream = rows.repartition(partitions(self.spark), "a").sortWithinPartitions("a", "g", "doc_id")
        spans = found.where("whole").select("whole", "doc_id", "tag", "at", "n").union(stream.mapInArrow(merged, SPAN))
        self.spans.append(written(spans, "spans"))
        self.commit([*self.runs, name])
        drop(found)
        return self.spans[-1]

    def compact(self) -> None:
        """All live runs become one, with the smallest doc_id of each (a, g), by merge joins of their buckets."""
        least = lambda rows: rows.groupBy("a", "g").agg(F.min(F.struct("doc_id", "tag", "at", "n")).alias("s"))
        rows = least(self.rows(self.runs[0]))
        for name in self.runs[1:]:
            more = least(self.rows(name)).withColumnRenamed("s", "t")
            rows = rows.join(more.hint("merge"), ["a", "g"], "full").select("a", "g", F.least("s", "t").alias("s"))
        old = self.runs
        self.commit([self.run(rows.select("a", "g", "s.*"), dealt=True)])
        self.remove(old)

    def commit(self, runs: list[str]) -> None:
        """The next manifest version; another index at the path that has made it already is an error."""
        manifest.create(self.spark, f"{self.path}/manifest", self.version + 1, {"runs": runs, "buckets": self.buckets})
        self.version, self.runs = self.version + 1, runs

    def remove(self, runs: list[str]) -> None:
        for name in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(self.spark, f"{self.path}/{name}")

    def covered(self) -> DataFrame:
        """All spans (doc_id, tag, at, n) of window starts that the batches added here have covered, after verification."""
        found = self.spans[0]
        for x in self.spans[1:]:
            found = found.union(x)
        check = found.where("not whole").groupBy("doc_id", "tag").agg(F.collect_set(F.struct("at", "n")).alias("spans"))
        check = written(check, "check")
        texts = only(self.documents, check.select(F.col("doc_id").alias("id")))
        texts = texts.join(check, ["doc_id", "tag"]).select("doc_id", "tag", "text", "spans")
        hashed = written(texts.mapInArrow(windows(self.size), WINDOW), "windows")
        low = hashed.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
        late = hashed.join(low, ["w1", "w2"]).where("doc_id > first").select("doc_id", "tag", "at", F.lit(1).alias("n"))
        return found.where("whole").select("doc_id", "tag", "at", "n").union(late)


def cut(size: int, marker: Marker | None = None):
    """Replaces the last column, the spans of each row's `text`, by its words' number, the number removed and the kept text.
    With a marker the last column is the row's place there: rows that it has are left out, the others have no spans."""

    def run(batches):
        for batch in batches:
            if marker is not None:
                batch = batch.filter(pa.array(~marker.has(batch.column(batch.num_columns - 1).to_numpy())))
            texts, lists = batch.column("text"), batch.column(batch.num_columns - 1)
            for lo, hi in T.chunks(texts):
                w = T.Words(texts[lo:hi])
                gone = np.zeros(len(w.start), bool)
                if marker is None:
                    part = lists[lo:hi]
                    count, flat = np.diff(part.offsets.to_numpy()), part.flatten()
                    count = np.where(part.is_null().to_numpy(zero_copy_only=False), 0, count)
                    at = w.first[np.repeat(np.arange(hi - lo), count)] + flat.field("at").to_numpy()
                    step = np.zeros(len(w.start) + 1, np.int64)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + flat.field("n").to_numpy() + size - 1, -1)
                    gone = np.cumsum(step[:-1]) > 0
                lost = np.concatenate([[0], np.cumsum(gone)])
                new = [pa.array(w.count.astype(np.int64)), pa.array(lost[w.first[1:]] - lost[w.first[:-1]]), w.kept_text(gone)]
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in batch.columns[:-1]), *new], names=[*batch.schema.names[:-1], *NEW])
        T.give_back()

    return run


NEW = ("__n_words", "__n_removed", "__kept")


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, text and a 32-bit tag that tells apart rows with one doc_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.hash(text).alias("tag"))


def covered_spans(docs: DataFrame, size: int = 50, shares: tuple[float, ...] = (0.25, 0.5)) -> DataFrame:
    """Covered spans (__d: doc_id, __t: tag, __spans) of a table from `tagged`, fed to an index in batches that end at these quantiles of doc_id."""
    small_arrow_batches(docs.sparkSession)
    index = FingerprintIndex(docs, size)
    at = docs.agg(F.percentile_approx("doc_id", [float(x) for x in shares], 1000).alias("at")).first()["at"]
    cuts = sorted(set(at or []))
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = docs
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        index.add(part)
    out = index.covered().groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "n")).alias("__spans"))
    out = written(out.select(F.col("doc_id").alias("__d"), F.col("tag").alias("__t"), "__spans"), "covered")
    index.remove(index.runs)
    for x in index.spans:
        drop(x)
    return out


def cut_rows(docs: DataFrame, size: int = 50) -> DataFrame:
    """Every row and column of `docs`, with __n_words, __n_removed and __kept."""
    spans = covered_spans(tagged(docs), size)
    rows = docs.withColumn("text", F.col("text").cast("string"))
    # texts that no span can touch are not shuffled; each half reads the rows for itself, with one Python worker a task
    marker, key = Marker(spans.select(F.col("__d").alias("id"))), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))
    rest = rows.withColumn("__at", marker.place(key))
    hit = rows.where(marker(key)).withColumn("__tag", F.hash(F.coalesce("text", F.lit(""))))
    hit = hit.join(spans, (F.col("doc_id") == F.col("__d")) & (F.col("__tag") == F.col("__t")), "left").drop("__d", "__t", "__tag")
    hit = hit.withColumn("__spans", F.coalesce("__spans", F.array().cast("array<struct<at:int,n:int>>")))
    kinds = S.StructType([*rows.schema.fields, S.StructField(NEW[0], S.LongType()), S.StructField(NEW[1], S.LongType()), S.StructField(NEW[2], S.StringType())])
    rest = rest.select(*rows.columns, "__at").mapInArrow(cut(size, marker), kinds)
    return rest.unionByName(hit.select(*rows.columns, "__spans").mapInArrow(cut(size), kinds))


def substring_dedup(docs: DataFrame, size: int = 50) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept): each text without the words of windows that start in a smaller doc_id."""
    out = cut_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), size)
    return out.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.col("__kept").alias("kept"))


def substring_dedup_rows(docs: DataFrame, size: int = 50) -> DataFrame:
    """The columns of `docs`: texts that lost words are their kept words (n_chars follows), emptied ones go, others are untouched."""
    out = cut_rows(docs, size).where("__n_removed = 0 or __kept <> ''")
    lost = F.col("__n_removed") > 0
    text = F.when(lost, F.col("__kept")).otherwise(F.col("text"))
    columns = {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(lost, F.length("__kept").cast("bigint")).otherwise(F.col("n_chars"))
    return out.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])
