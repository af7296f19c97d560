"""Helpers shared by the operators of this subpackage: tables, shared storage, numbering, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..paths import new_path
from .text import give_back

#: Words are maximal runs of bytes other than these white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: `df` as a Parquet table in the shared folder, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.loam_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes the table of a DataFrame that `written` returned, once nothing needs it."""
    drop_path(df.sparkSession, df.loam_path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_arrow_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, whatever the length of the texts. The session keeps this setting, as the operators' tables are read later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def hash52(*parts: Column | str) -> Column:
    """52 uniform bits from the MD5 of the parts joined by ':' (any SQL engine with md5 gets the same)."""
    text = F.concat_ws(":", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def numbered(df: DataFrame, group: str, cell: Column, order: list[Column], name: str = "slot") -> DataFrame:
    """Adds gapless numbers from 0 within each `group`, ordered by (cell, order).

    No group is sorted in one task: rows are numbered within (group, cell), and the cells' offsets come
    from their counts, a table of one row a cell. `cell` must take a bounded number of values."""
    df = df.withColumn("_cell", cell)
    counts = df.groupBy(group, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("_g"), F.col("_cell").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("bigint").alias("_from"))
    inside = Window.partitionBy(group, "_cell").orderBy(*order)
    rows = df.withColumn("_at", F.row_number().over(inside).cast("bigint") - 1)
    rows = rows.join(offsets, rows[group].eqNullSafe(F.col("_g")) & (rows["_cell"] == F.col("_c")))
    return rows.withColumn(name, F.col("_from") + F.col("_at")).drop("_cell", "_at", "_g", "_c", "_from")


ROOTED = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def contracted(block: int):
    """Replaces the edges of each block by stars: every node but the smallest of its component there points to that one.

    Of a block a node leaves at most one edge as the larger end, however many it had. The last row's node and its root
    stand in the next block too, so where rows come sorted by `a`, all edges of a larger end are contracted together."""

    def run(batches):
        last = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a, b in blocks(batches, block):
            a, b = np.concatenate([last[0], a]), np.concatenate([last[1], b])
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
            while True:  # the smallest root on either side wins; then all jump to their roots' roots
                before = root
                root = root.copy()
                low = np.minimum(root[x], root[y])
                for side in (x, y):
                    np.minimum.at(root, before[side], low)
                    np.minimum.at(root, side, low)
                root = root[root]
                if np.array_equal(root, before):
                    break
            child = np.flatnonzero(root != np.arange(len(nodes)))
            if len(last[0]):  # told already, unless its root has changed
                known = np.searchsorted(nodes, last[0][0])
                child = child[(child != known) | (nodes[root[child]] != last[1][0])]
            end = x[-1:]
            last = (nodes[end], nodes[root[end]]) if root[end[0]] != end[0] else (nodes[:0], nodes[:0])
            yield pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[root[child]])], schema=ROOTED)
        give_back()

    return run


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The two columns of consecutive batches, about `size` rows at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(h.num_rows for h in held) >= size:
            yield tuple(np.concatenate([h.column(i).to_numpy() for h in held]) for i in (0, 1))
            held = []
    if sum(h.num_rows for h in held):
        yield tuple(np.concatenate([h.column(i).to_numpy() for h in held]) for i in (0, 1))


def components(edges: DataFrame, max_rounds: int = 60, block: int = 1 << 20) -> DataFrame:
    """Connected components of undirected `edges` (a, b): rows (id, root), root the smallest id reachable.

    Each round lets every node's parent step up to the parent's smallest parent, then contracts the edges, first where
    they are and again where those of a larger end meet, by union-find over blocks of `block` edges: so at most one edge
    a block of any node is moved. A root of very many nodes is the smaller end of its edges, whose join is one that
    Spark splits where it is skewed. Each round is written to the shared folder. Where one block takes all edges, its
    contraction is the answer. Nodes without an edge are left out."""
    spark = edges.sparkSession
    stars = lambda e: e.mapInArrow(contracted(block), "a bigint, b bigint")
    dealt = lambda e: stars(stars(e).repartition(partitions(spark), "a").sortWithinPartitions("a"))
    edges = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    if edges.count() < block:
        new = written(stars(edges.coalesce(1)), "edges")
        drop(edges)
        return rooted(new)
    edges, first = written(dealt(edges), "edges"), edges
    drop(first)
    last = None
    for _ in range(max_rounds):
        up = edges.groupBy(F.col("a").alias("child")).agg(F.min("b").alias("up"))
        at = edges.join(up, F.col("b") == F.col("child"), "left").select("a", F.coalesce("up", "b").alias("b"))
        # what a node's parent was, it stays linked with: the parent has an edge of its own to `up`
        new = written(dealt(at.union(up.select("child", "up"))), "edges")
        drop(edges)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not converge")
    return rooted(edges)


def rooted(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("id"), F.col("b").alias("root")).union(stars.select("b", "b").distinct())


class Marker:
    """A test that holds for every key in `ids` (a column `id`) and for few others, to be run where rows are read.

    It is a bitmap of a fixed `bits` bits (1 MB), set at the ids' hashes. Over very many ids it fills up: then it
    holds for more rows and saves less, and what follows it stays right."""

    def __init__(self, ids: DataFrame, bits: int = 1 << 23):
        self.bits = bits
        full = np.zeros(bits, bool)
        full[ids.select(self.place("id").alias("at")).distinct().toArrow().column("at").to_numpy()] = True
        self.packed = np.packbits(full).tobytes()

    def place(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.bits)).cast("int")

    def has(self, at: np.ndarray) -> np.ndarray:
        return (np.frombuffer(self.packed, np.uint8)[at >> 3] >> (7 - (at & 7))) & 1 == 1

    def __call__(self, key: Column | str) -> Column:
        has = self.has

        @F.arrow_udf("boolean")
        def marked(at: pa.Array) -> pa.Array:
            return pa.array(has(at.fill_null(0).to_numpy()), mask=at.is_null().to_numpy(zero_copy_only=False))

        return marked(self.place(key))


def only(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of `df` whose key is in `ids`; the marker drops most others before the shuffle of the semi-join."""
    return df.where(Marker(ids)(key)).join(ids.select("id").distinct(), F.col(key) == F.col("id"), "left_semi")


def without(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of `df` whose key is not in `ids`; rows that the marker clears are not shuffled."""
    marked = F.coalesce(Marker(ids)(key), F.lit(False))
    gone = ids.select(F.col("id").alias("__gone")).distinct()
    return df.where(~marked).unionByName(df.where(marked).join(gone, F.col(key) == F.col("__gone"), "left_anti"))
