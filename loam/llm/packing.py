"""Packing by optimal length buckets.

Lengths are counted into one global histogram, one bin a length: n different lengths need n * n / 2 tokens at least, so
they are few however large the table is. `coarse`, off unless asked for, joins lengths that agree in their highest bits, for
tables whose lengths are spread too wide to be exact. A dynamic programme over the bins' largest lengths chooses the bucket
boundaries that minimise the padding of all rows; inside a bucket, rows are numbered without gaps and every
floor(budget / boundary) of them form a batch, so a batch of padded rows stays within the token budget.

Defined results: null or blank text: length 0, packed as a row of length 0 in the first bucket (padded to its
boundary). A row longer than the budget is a batch of its own. Ties between equal costs take the lower boundary. Rows with a
null key come first, equal keys are ordered by length; repeated rows have places of their own, in any order. Extra columns
stay in `pack` (its own names are replaced) and are left out by `pack_documents`; an empty table gives no rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, hash52, numbered

CELLS, NARROW = 4096, 64


def bin_of(length: Column, coarse: int | None) -> Column:
    """The length; with `coarse`, all bits below its highest `coarse` ones set to one."""
    if coarse is None:
        return length
    low = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(length)) - coarse, F.lit(0))).cast("bigint")
    return (F.floor(length / low) * low + low - 1).cast("bigint")


def boundaries(top: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Boundaries (largest lengths of the buckets, ascending) of least padding for bins with these largest lengths, counts and sums of lengths.

    cost[j], the least padding of the first j bins in so many buckets, comes by divide and conquer over the monotone last
    cut; ranges of NARROW bins or less are computed at once."""
    n = len(top)
    if not n:
        return []
    top = top.astype(np.int64)
    c, s = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (count, total))
    never = np.int64(1 << 62)
    cost = np.full(n + 1, never)
    cost[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        now, cut = np.full(n + 1, never), np.zeros(n + 1, np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            narrow = hi - lo < NARROW
            j = np.arange(lo, hi + 1) if narrow else np.array([(lo + hi) // 2])
            i = np.arange(a, min(b, j[-1] - 1) + 1)
            # bins i..j-1 in one bucket; a step of the matrix holds as many columns as its rows leave room for
            best, at = np.full(len(j), never), np.full(len(j), a)
            for k in range(0, len(i), step := max(1, (1 << 20) // len(j))):
                part = i[k : k + step]
                v = cost[part][None, :] + top[j - 1][:, None] * (c[j][:, None] - c[part][None, :]) - (s[j][:, None] - s[part][None, :])
                v = np.where((part[None, :] < j[:, None]) & (cost[part] < never)[None, :], v, never)
                least = np.argmin(v, 1)
                v = v[np.arange(len(j)), least]
                at = np.where(v < best, part[least], at)
                best = np.minimum(best, v)
            now[j], cut[j] = best, at
            if not narrow:
                todo += [(lo, int(j[0]) - 1, a, int(at[0])), (int(j[0]) + 1, hi, int(at[0]), b)]
        cuts.append(cut)
        cost = now
        if cost[n] == 0:
            break
    out, j = [], n
    for cut in reversed(cuts):
        if j <= 0:
            break
        out.append(int(top[j - 1]))
        j = int(cut[j])
    return out[::-1]


def pack(rows: DataFrame, length: str, key: str, buckets: int = 16, budget: int = 65536, coarse: int | None = None) -> DataFrame:
    """Adds bucket, boundary (its padded length), batch (number within the bucket), slot (place within the batch)."""
    rows = rows.withColumn("_bin", bin_of(F.col(length), coarse))
    hist = rows.groupBy("_bin").agg(F.max(length).alias("top"), F.count("*").alias("n"), F.sum(length).alias("total")).orderBy("_bin").toArrow()
    ends = boundaries(*(hist.column(x).to_numpy() for x in ("top", "n", "total")), buckets)
    if not ends:
        ends = [0]
    bucket = F.lit(0)
    for e in ends[:-1]:
        bucket = bucket + (F.col(length) > e).cast("int")
    rows = rows.drop("_bin").withColumn("bucket", bucket.cast("int"))
    rows = rows.withColumn("boundary", F.element_at(F.array(*[F.lit(e).cast("bigint") for e in ends]), F.col("bucket") + 1))
    rows = numbered(rows, "bucket", (hash52(F.col(key).cast("string"), F.lit("cell")) % CELLS).cast("int"), [F.col(key).asc_nulls_first(), F.col(length)], "_row")
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("boundary"), F.lit(1)))).cast("bigint")
    rows = rows.withColumn("batch", F.floor(F.col("_row") / room).cast("bigint")).withColumn("slot", (F.col("_row") % room).cast("int"))
    return rows.drop("_row")


def pack_documents(docs: DataFrame, buckets: int = 16, budget: int = 65536) -> DataFrame:
    """Rows (doc_id, n_tokens, bucket, boundary, batch, slot); a token is a word."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.size(F.array_remove(F.split(text, SPACE), "")).cast("bigint").alias("n_tokens"))
    return pack(rows, "n_tokens", "doc_id", buckets, budget)
