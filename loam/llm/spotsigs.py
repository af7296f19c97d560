"""Document fingerprints by SpotSigs.

Anchors are common words of the languages at hand; the CHAIN content words that follow an anchor, common words
skipped, form with it a signature. The set of a text's signatures (32-bit hashes) is its fingerprint, written as sorted
hexadecimal numbers. A text without any complete chain takes its 3-word sequences, or all its words as one, instead.
Likeness is the Jaccard similarity of two sets. `near_pairs` compares sets partition by partition of their lengths:
sets of similarity s differ in length by a factor s at most, so a set meets its own and the next partition only, and
there only sets that share one of its rarest signatures, with the overlap still reachable checked before the join.

Defined results: null text counts as empty; a text without words has the empty fingerprint; two empty fingerprints
have likeness 1, an empty and another one 0. A null doc_id sorts below all others; equal doc_ids are ordered by their
texts. A table of one row follows itself. Extra columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text as T
from .common import partitions, small_arrow_batches
from .license_scan import Tokens

CHAIN = 2

# Common words of four languages.
ANCHORS = {
    "en": "a an and are as at be by for from has he her his i in is it its not of on or she that the their they this to was we were with you",
    "de": "als am auch auf aus bei das dass dem den der des die ein eine einer er es für im in ist mit nicht sich sie sind und von war zu",
    "fr": "au aux avec ce dans de des du elle en est et il la le les leur mais ne on ou par pas pour que qui se son sur un une",
    "es": "al como con de del el en es esta la las lo los más no o para pero por que se ser su sus un una y",
}
_U = np.uint64


def anchor_hashes() -> np.ndarray:
    words = sorted({w for group in ANCHORS.values() for w in group.split()})
    return np.sort(Tokens(pa.array([" ".join(words)], pa.string())).hashes())


_ANCHORS = anchor_hashes()


def spot_sets(column: pa.Array) -> list[np.ndarray]:
    """Each row's signatures: distinct 32-bit hashes in order."""
    w = Tokens(column)
    x = w.hashes()
    place = np.searchsorted(_ANCHORS, x)
    common = _ANCHORS[np.minimum(place, len(_ANCHORS) - 1)] == x
    content, anchor = np.flatnonzero(~common), np.flatnonzero(common)
    after = np.searchsorted(content, anchor)
    whole = after + CHAIN <= len(content)
    anchor, after = anchor[whole], after[whole]
    whole = w.doc[content[after + CHAIN - 1]] == w.doc[anchor] if len(anchor) else np.zeros(0, bool)
    anchor, after = anchor[whole], after[whole]
    h = x[anchor] * _U(0x9E3779B97F4A7C15)
    for j in range(CHAIN):
        h = T.mix(h + x[content[after + j]])
    doc = w.doc[anchor]
    bare = np.ones(w.rows, bool)
    bare[doc] = False
    bare &= w.count > 0
    if bare.any():
        g, at = T.grams(w, x, 3)
        mine = bare[w.doc[at]]
        tiny = np.flatnonzero(bare & (w.count < 3))
        last = x[w.first[tiny]] * _U(3) + x[np.minimum(w.first[tiny] + 1, len(x) - 1)] * (w.count[tiny] == 2).astype(_U)
        h, doc = np.concatenate([h, g[mine], T.mix(last)]), np.concatenate([doc, w.doc[at[mine]], tiny.astype(doc.dtype)])
    key = np.unique((doc.astype(_U) << _U(32)) | (h >> _U(32)))
    sets = (key & _U(0xFFFFFFFF)).astype(">u4")
    return np.split(sets, np.searchsorted(key, np.arange(1, w.rows).astype(_U) << _U(32))) if w.rows else []


def written_out(s: np.ndarray) -> str:
    return s.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 without a look at them if their lengths keep it below `least`."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < least * large or not small:
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (large + small - common)


COMPARED = "doc_id bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_COMPARED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def compared(batches):
    """From rows sorted by (bucket, guests first, doc_id): each row against its edited text and the row before it."""
    bucket, text, spots = None, None, None
    for batch in batches:
        ids, guests, buckets = batch.column("doc_id"), batch.column("guest").to_pylist(), batch.column("bucket").to_pylist()
        for lo, hi in T.chunks(batch.column("text"), size=T.CHUNK_BYTES // 2):
            texts = batch.column("text")[lo:hi].to_pylist()
            sets = spot_sets(batch.column("text")[lo:hi])
            rows, edited, before = [], [], []
            for i in range(hi - lo):
                if buckets[lo + i] != bucket:
                    bucket, text, spots = buckets[lo + i], None, None
                if not guests[lo + i]:
                    t = texts[i]
                    n = len(t)
                    rows.append(i)
                    before.append(spots)
                    edited.append(t[: n - n // 2] + text[: n // 2])
                text, spots = texts[i], sets[i]
            if not rows:
                continue
            changed = pa.array(edited, pa.string())
            other: list[np.ndarray] = []
            for a, z in T.chunks(changed):
                other += spot_sets(changed[a:z])
            yield pa.RecordBatch.from_arrays(
                [
                    ids[lo:hi].take(pa.array(rows)),
                    pa.array([len(texts[i]) for i in rows], pa.int64()),
                    changed,
                    pa.array([written_out(sets[i]) for i in rows], pa.string()),
                    pa.array([written_out(s) for s in other], pa.string()),
                    pa.array([likeness(sets[i], s) for i, s in zip(rows, other)], pa.float64()),
                    pa.array([likeness(sets[i], s) for i, s in zip(rows, before)], pa.float64()),
                ],
                schema=_COMPARED,
            )
    T.give_back()


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Rows dealt by ranges of doc_id, and of each range's last doc_id, and of the last of all, a second copy as the guest of the next range.

    The bounds of the ranges may be any numbers near the quantiles; the ranges' last doc_ids, one a range, are counted exactly."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = partitions(spark)
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("at")).first()["at"] if n > 1 else None
    bounds = np.array(sorted(set(found or [])), np.int64)

    @F.arrow_udf("int")
    def range_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, ids.to_numpy(), "left").astype(np.int32))

    last = sorted((r.bucket, r.last) for r in docs.select("_id", range_of("_id").alias("bucket")).groupBy("bucket").agg(F.max("_id").alias("last")).collect())
    ends = np.array([x for _, x in last], np.int64)
    after = np.array([*(b for b, _ in last[1:]), *(b for b, _ in last[:1])], np.int32)  # the first range follows the last one

    @F.arrow_udf("int")
    def guest_of(ids: pa.Array) -> pa.Array:
        """The range that a row is the guest of; -1 if of none."""
        x = ids.to_numpy()
        at = np.minimum(np.searchsorted(ends, x), max(len(ends) - 1, 0))
        return pa.array((np.where(ends[at] == x, after[at], -1) if len(ends) else np.full(len(x), -1)).astype(np.int32))

    docs = docs.withColumn("bucket", range_of("_id")).withColumn("other", guest_of("_id"))
    own, guest = F.struct("bucket", F.lit(False).alias("guest")), F.struct(F.col("other").alias("bucket"), F.lit(True).alias("guest"))
    rows = docs.select("doc_id", "_id", "text", F.explode(F.when(F.col("other") < 0, F.array(own)).otherwise(F.array(own, guest))).alias("p")).select("doc_id", "_id", "text", "p.bucket", "p.guest")
    return rows.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", F.col("guest").desc(), "_id", F.xxhash64("text"), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next)."""
    small_arrow_batches(docs.sparkSession)
    return with_neighbours(docs).select("doc_id", "text", "bucket", "guest").mapInArrow(compared, COMPARED)


def near_pairs(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs (a, b, similarity) of representatives of different signature sets, a < b, of similarity `least` or more.

    Texts with equal fingerprints are one class, named by its smallest doc_id. Empty fingerprints are left out."""
    small_arrow_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for lo, hi in T.chunks(batch.column("text")):
                sets = spot_sets(batch.column("text")[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "spots"])

    sets = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("doc_id is not null").mapInArrow(run, "doc_id bigint, spots array<bigint>")
    sets = sets.where(F.size("spots") > 0).groupBy("spots").agg(F.min("doc_id").alias("id")).withColumn("n", F.size("spots"))
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(least) if least < 1 else 1.0) + F.lit(1e-9)).cast("int")
    sets = sets.withColumn("part", part)
    spots = sets.select("id", "n", "part", F.explode("spots").alias("spot"))
    df = spots.groupBy("spot").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "spot"))
    prefix = spots.join(df, "spot").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1)
    left = prefix.select("spot", F.col("id").alias("a"), F.col("n").alias("na"), F.col("rank").alias("ra"), F.explode(F.array("part", F.col("part") + 1, F.col("part") - 1)).alias("part"))
    right = prefix.select("spot", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("rank").alias("rb"), "part")
    reach = F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) + F.least("ra", "rb")
    cand = left.join(right, ["spot", "part"]).where("a < b").where((F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9) & (reach >= least / (1 + least) * (F.col("na") + F.col("nb")) - 1e-9)).select("a", "b").distinct()
    side = lambda x: sets.select(F.col("id").alias(x), F.col("spots").alias(f"s{x}"))
    both = cand.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.select("a", "b", (F.col("common") / (F.size("sa") + F.size("sb") - F.col("common"))).alias("similarity")).where(F.col("similarity") >= least - 1e-12)
