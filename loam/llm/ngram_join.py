"""N-gram Jaccard join by parity sketches.

Each text is the set of its distinct word shingles. Hashed shingles toggle bits of a sketch, so the Hamming
distance of two sketches never exceeds the sets' symmetric difference D, and similarity s bounds D by
(1-s)/(1+s) * (|A|+|B|). Sets are dealt into size bands; a pair belongs to the band of its larger set, and a set
also stands in the next band when a partner there may be large enough. In a band whose bound is d, the shingles
fall into t > d blocks by hash, and a block's key is the XOR of its shingles: by the pigeonhole principle a linked
pair agrees on at least t-d blocks. Empty blocks say nothing, so a set with fewer than d+1 non-empty blocks is
dealt again with more blocks, until it has enough; of a pair, one such set suffices.

Groups of equal keys are read as one sorted stream. Up to `small` members are paired with each other; in a larger
group each is paired with the first. Where one batch of texts holds more than that of a key, all but its first `small` + 1 are
paired with the batch's first there and then, and are not gathered by the key. Pairs pass size and sketch bounds before the exact test, and only those that
can still connect two components are tested. What a large group may still hide is found by counting: a set
whose keys in large groups of several components leave it d+1 others has met all its partners elsewhere. This holds
for sets dealt once; one dealt again may share with a partner nothing but a single key of an earlier dealing, so any
such key makes it one of the rest. The
rest, gathered into clusters that share keys (or by key, where a cluster has over `cluster` sets), are compared by sketch
in blocks of about `block` sets or BYTES of sketches, each two blocks in a task of their own, and only pairs that pass are told: no link is lost, no
group is expanded into pairs.

Defined results: null or blank text: 0 shingles, its own component. A null doc_id: its own row, component null.
Repeated doc_ids: one node, linked if any of its texts is. Extra columns are ignored; empty tables give no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text as T
from .common import components, drop, only, partitions, small_arrow_batches, written

#: Dealings after which a set must have its blocks: then each shingle has one of its own. Sketches of a block. Classes that a task knows it has sent.
SEEDS, BYTES, SENT = 24, 4 << 20, 200_000
_EDGES = [1, 2, 3, 4, 5]
while _EDGES[-1] < 1 << 40:
    _EDGES.append(max(_EDGES[-1] + 1, _EDGES[-1] * 3 // 2))
EDGES = np.array(_EDGES, np.int64)


def band_of(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(EDGES, n, "right") - 1


def bound(band: np.ndarray, percent: int) -> np.ndarray:
    """Largest symmetric difference of linked sets in the band."""
    return (100 - percent) * 2 * (EDGES[band + 1] - 1) // (100 + percent)


def deal(seed: int, d: np.ndarray) -> np.ndarray:
    """Blocks of the seed-th dealing."""
    return (d + 1) * 6 // 5 + 2 if seed == 0 else (d + 1) * (1 << seed) + seed


def sketch_bits(band: np.ndarray) -> np.ndarray:
    """A power of two, twice the band's largest set at least."""
    return 1 << np.maximum(6, np.ceil(np.log2(2.0 * EDGES[band + 1])).astype(np.int64))


class Sets:
    """Shingle sets of a chunk's rows and the (row, band) jobs in which they stand."""

    def __init__(self, column: pa.Array, k: int, percent: int):
        w = T.Words(column, lower=True)
        self.h, doc = T.shingle_sets(w, k)
        self.n = np.bincount(doc, minlength=w.rows).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.whole = [np.zeros(w.rows, np.uint64), np.zeros(w.rows, np.uint64)]
        full = np.flatnonzero(self.n)
        if len(full):
            self.whole[0][full] = np.bitwise_xor.reduceat(self.h, self.first[full])
            self.whole[1][full] = np.add.reduceat(T.mix(self.h ^ np.uint64(0x5851F42D4C957F2D)), self.first[full])
        own = band_of(np.maximum(self.n, 1))
        up = full[EDGES[own[full] + 1] * percent <= 100 * self.n[full]]
        self.row = np.concatenate([full, up])
        self.band = np.concatenate([own[full], own[up] + 1])
        self.d = bound(self.band, percent)

    def tokens(self, jobs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of the jobs, and for each the place of its job in `jobs`."""
        n = self.n[self.row[jobs]]
        job = np.repeat(np.arange(len(jobs)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[self.row[jobs]], n)
        return self.h[at], job

    def places(self, jobs: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The block of each shingle, where each job's blocks begin, the jobs' salts, and the shingles."""
        h, job = self.tokens(jobs)
        t = deal(seed, self.d[jobs])
        start = np.cumsum(t) - t
        salt = T.mix(self.band[jobs].astype(np.uint64) * np.uint64(131) + np.uint64(seed + 1))
        block = ((T.mix(h ^ salt[job]) >> np.uint64(32)) * t[job].astype(np.uint64)) >> np.uint64(32)
        return start[job] + block.astype(np.int64), start, salt, h

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the non-empty blocks of all jobs, and their rows."""
        left, out, rows = np.arange(len(self.row)), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for seed in range(SEEDS):
            if not len(left):
                break
            at, start, salt, h = self.places(left, seed)
            x = np.zeros(int(start[-1] + deal(seed, self.d[left[-1:]])[0]), np.uint64)
            np.bitwise_xor.at(x, at, h)
            full = np.flatnonzero(np.bincount(at, minlength=len(x)))
            of = np.searchsorted(start, full, "right") - 1
            out.append(T.mix(x[full] ^ T.mix(salt[of] + (full - start[of]).astype(np.uint64))))
            rows.append(self.row[left[of]])
            left = left[np.bincount(of, minlength=len(left)) <= self.d[left]]
        if len(left):
            raise ValueError("sets this different may have no block in common: raise percent")
        return np.concatenate(out), np.concatenate(rows)

    def slack(self) -> np.ndarray:
        """Keys of the first dealing beyond the d+1 needed; negative for jobs that are dealt again."""
        every = np.arange(len(self.row))
        if not len(every):
            return every
        at, start, _, _ = self.places(every, 0)
        full = np.add.reduceat(np.bincount(at, minlength=int(start[-1] + deal(0, self.d[-1:])[0])) > 0, start, dtype=np.int64)
        return full - self.d - 1

    def sketches(self) -> tuple[np.ndarray, np.ndarray]:
        """Parity sketches of all jobs: 64-bit words, and the place where each job's begin."""
        m = sketch_bits(self.band)
        start = np.concatenate([[0], np.cumsum(m)])
        h, job = self.tokens(np.arange(len(self.row)))
        at = start[job] + (T.mix(h + np.uint64(0x2545F4914F6CDD1D)) & (m[job] - 1).astype(np.uint64)).astype(np.int64)
        bits = (np.bincount(at, minlength=int(start[-1])) & 1).astype(np.uint8)
        return np.packbits(bits, bitorder="little").view(np.int64), start // 64


PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("slack", pa.int64()), ("band", pa.int64()), ("own", pa.list_(pa.int64())), ("up", pa.list_(pa.int64()))])


def profiled(k: int, percent: int):
    def run(batches):
        for batch in batches:
            for a, z in T.chunks(batch.column("text")):
                s = Sets(batch.column("text")[a:z], k, percent)
                slack = np.full(z - a, 1 << 40)
                np.minimum.at(slack, s.row, s.slack())
                bits, start = s.sketches()
                full = int(np.count_nonzero(s.n))
                own, up = np.zeros(z - a, np.int64), np.zeros(z - a, np.int64)
                own[s.row[:full]] = np.diff(start)[:full]
                up[s.row[full:]] = np.diff(start)[full:]
                lists = lambda size, words: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(words))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:z], pa.array(s.n), pa.array(s.whole[0].view(np.int64)), pa.array(s.whole[1].view(np.int64)), pa.array(slack), pa.array(band_of(np.maximum(s.n, 1))), lists(own, bits[: start[full]]), lists(up, bits[start[full] :])], schema=PROFILE)
        T.give_back()

    return run


KEYED = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64())])


def keyed(k: int, percent: int, small: int):
    """Keys of every set; of equal sets in one task, one stands for all (the others are in its class). Rows with a `first` are
    settled: the batch holds more than `small` + 1 of the key, and these are paired with the first."""

    def run(batches):
        sent: set[bytes] = set()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            keys, docs = [], []
            for a, z in T.chunks(batch.column("text")):
                s = Sets(batch.column("text")[a:z], k, percent)
                whole = np.ascontiguousarray(np.stack([*s.whole, s.n.astype(np.uint64)], 1)).view("S24").ravel() if z > a else []
                one = np.zeros(z - a, bool)
                for i, x in enumerate(whole):
                    if x not in sent:
                        one[i] = True
                        sent.add(x)
                if len(sent) > SENT:
                    sent.clear()
                keep = one[s.row]
                s.row, s.band, s.d = s.row[keep], s.band[keep], s.d[keep]
                key, row = s.keys()
                keys.append(key.view(np.int64))
                docs.append(ids[a:z][row])
            if not keys:
                continue
            key, doc = np.concatenate(keys), np.concatenate(docs)
            order = np.lexsort((doc, key))
            key, doc = distinct(key[order], doc[order])
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            begin = np.repeat(start, np.diff(np.concatenate([start, [len(key)]])))
            more = np.arange(len(key)) - begin > small
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(doc[begin], mask=~more)], schema=KEYED)
        T.give_back()

    return run


GROUPED = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def grouped(small: int):
    """From rows sorted by (key, doc_id): all pairs of a small group with a null key; of a large one, (key, first, member) for each member.
    Settled rows pass as they are.

    Of the group that is open at the end of a batch only its first `small` members are held, or its first and last."""

    def run(batches):
        at_key, held, large = None, np.zeros(0, np.int64), False
        for batch in batches:
            key, doc, first = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy(), batch.column("first")
            if first.null_count < len(first):
                is_open = first.is_null().to_numpy(zero_copy_only=False)
                yield from rows_of(key[~is_open], first.drop_null().to_numpy(), doc[~is_open])
                key, doc = key[is_open], doc[is_open]
            if not len(key):
                continue
            if at_key is not None and key[0] == at_key and large:
                n = int(np.searchsorted(key, at_key, "right"))
                more = distinct(key[:n], doc[:n])[1]
                more = more[int(more[0] == held[1]) :]
                yield from rows_of(np.full(len(more), at_key), np.full(len(more), held[0]), more)
                held = np.array([held[0], doc[n - 1]])
                key, doc = key[n:], doc[n:]
                if not len(key):
                    continue
            elif at_key is not None and key[0] == at_key:
                key, doc = np.concatenate([np.full(len(held), at_key), key]), np.concatenate([held, doc])
            elif not large:
                yield from pairs_of(held)
            key, doc = distinct(key, doc)
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([start, [len(key)]]))
            of = np.repeat(np.arange(len(size)), size)
            big, closed = size > small, np.arange(len(size)) < len(size) - 1
            i = np.flatnonzero(big[of])
            yield from rows_of(key[i], doc[start[of[i]]], doc[i])
            for j in range(1, small):
                i = np.flatnonzero((~big & closed)[of] & (np.arange(len(key)) - start[of] >= j))
                yield from rows_of(None, doc[i - j], doc[i])
            at_key, large, held = key[-1], bool(big[-1]), doc[start[-1] :]
            if large:
                held = held[[0, -1]]
        if not large:
            yield from pairs_of(held)
        T.give_back()

    return run


def distinct(key, doc):
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[new], doc[new]


def pairs_of(held):
    i, j = np.triu_indices(len(held), 1)
    return rows_of(None, held[i], held[j])


def rows_of(key, a, b):
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()) if key is None else pa.array(key), pa.array(a), pa.array(b)], schema=GROUPED)


TESTED = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def tested(k: int, percent: int):
    """Exact test of pairs of texts."""

    def run(batches):
        for batch in batches:
            for a, z in T.chunks(batch.column("ta"), batch.column("tb")):
                x, y = Sets(batch.column("ta")[a:z], k, percent), Sets(batch.column("tb")[a:z], k, percent)
                ok = np.zeros(z - a, bool)
                for i in range(z - a):
                    p, q = x.h[x.first[i] : x.first[i + 1]], y.h[y.first[i] : y.first[i + 1]]
                    both = np.concatenate([p, q])
                    both.sort()
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    ok[i] = common > 0 and 100 * common >= percent * (len(both) - common)
                keep = pa.array(np.flatnonzero(ok))
                yield pa.RecordBatch.from_arrays([batch.column("a")[a:z].take(keep), batch.column("b")[a:z].take(keep)], schema=TESTED)
        T.give_back()

    return run


def near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different sets that size and sketch allow to be linked."""
    side = lambda x: sets.select(*[F.col(c).alias(f"{x}_{c}") for c in ("doc_id", "n", "c1", "c2", "band", "own", "up")])
    j = pairs.join(side("a"), F.col("a") == F.col("a_doc_id")).join(side("b"), F.col("b") == F.col("b_doc_id"))
    j = j.where("a_c1 <> b_c1 or a_c2 <> b_c2 or a_n <> b_n").where(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)")
    # the pair's band is the larger set's; the smaller one stands in it with `own` or with `up`
    sa = F.when(F.col("a_band") >= F.col("b_band"), F.col("a_own")).otherwise(F.col("a_up"))
    sb = F.when(F.col("b_band") >= F.col("a_band"), F.col("b_own")).otherwise(F.col("b_up"))
    apart = F.aggregate(F.zip_with(sa, sb, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return j.where((100 + percent) * apart <= (100 - percent) * (F.col("a_n") + F.col("b_n"))).select("a", "b").distinct()


def linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    side = lambda x: texts.select(F.col("doc_id").alias(f"id_{x}"), F.col("text").alias(f"t{x}"))
    j = pairs.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b")).select("a", "b", "ta", "tb")
    return j.mapInArrow(tested(k, percent), "a bigint, b bigint")


def in_blocks(percent: int):
    """Pairs of two blocks of sets that share a key, as far as component, size and sketch leave them."""

    def side(cell):
        rows = cell.values
        out = {c: rows.field(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "root", "n", "band")}
        for c in ("own", "up"):
            lists = rows.field(c)
            out[c] = (lists.offsets.to_numpy(), lists.values.to_numpy())
        return out

    def words(s, rows, band):
        """The sketches of these rows in the band, one row each."""
        out = []
        for c, mine in (("own", s["band"][rows] == band), ("up", s["band"][rows] != band)):
            start, values = s[c][0][rows[mine]], s[c][1]
            size = int(s[c][0][rows[mine][0] + 1] - start[0]) if len(start) else 0
            out.append(values[start[:, None] + np.arange(size)] if size else np.zeros((0, 0), np.int64))
        return out

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                x, y = side(batch.column("left")[r]), side(batch.column("right")[r])
                for band in np.unique(np.concatenate([x["band"], y["band"]])):
                    i, j = ([np.flatnonzero(s["band"] == band), np.flatnonzero((s["band"] == band - 1) & (np.diff(s["up"][0]) > 0))] for s in (x, y))
                    for p, q in ((i[0], j[0]), (i[0], j[1]), (i[1], j[0])):
                        if not len(p) or not len(q):
                            continue
                        left, right = ([w for w in words(s, rows, band) if len(w)][0] for s, rows in ((x, p), (y, q)))
                        step = max(1, (1 << 21) // (len(q) * left.shape[1]))
                        for at in range(0, len(p), step):
                            part = p[at : at + step]
                            na, nb = x["n"][part][:, None], y["n"][q][None, :]
                            # unsigned: of a negative number bitwise_count counts the absolute value's bits
                            apart = np.bitwise_count((left[at : at + step, None, :] ^ right[None, :, :]).view(np.uint64)).sum(2, dtype=np.int64)
                            ok = (x["root"][part][:, None] != y["root"][q][None, :]) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((100 + percent) * apart <= (100 - percent) * (na + nb))
                            u, v = np.nonzero(ok)
                            if len(u):
                                a, b = x["doc_id"][part][u], y["doc_id"][q][v]
                                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=TESTED)
        T.give_back()

    return run


def blocks_of(rows: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs of different components within each key, from pairs of blocks of about `block` rows or BYTES."""
    room = F.greatest(F.count("*") / max(1, block * 3 // 4), F.sum(F.size("own") + F.size("up")) * 8 / BYTES)
    size = rows.groupBy("key").agg(F.ceil(room).cast("int").alias("parts"))
    cut = rows.join(size, "key").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int"))
    held = cut.groupBy("key", "parts", "part").agg(F.collect_list(F.struct("doc_id", "root", "n", "band", "own", "up")).alias("rows"))
    left = held.select("key", F.col("rows").alias("left"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("other"))
    right = held.select(F.col("key").alias("k2"), F.col("part").alias("p2"), F.col("rows").alias("right"))
    both = left.join(right, (F.col("key") == F.col("k2")) & (F.col("other") == F.col("p2")))
    return both.select("left", "right").mapInArrow(in_blocks(percent), "a bigint, b bigint").distinct()


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, small: int = 6, block: int = 1024, cluster: int = 32768) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) of documents linked at 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = written(docs.mapInArrow(profiled(k, percent), "doc_id bigint, n bigint, c1 bigint, c2 bigint, slack bigint, band bigint, own array<bigint>, up array<bigint>"), "profile")
    usable = docs.where("doc_id is not null")
    keys = usable.mapInArrow(keyed(k, percent, small), "key bigint, doc_id bigint, first bigint")
    place = F.when(F.col("first").isNull(), F.col("key")).otherwise(F.xxhash64("doc_id"))
    cand = written(keys.repartition(partitions(spark), place).sortWithinPartitions("key", "doc_id").mapInArrow(grouped(small), "key bigint, a bigint, b bigint"), "groups")

    sets = profile.where("doc_id is not null and n > 0")
    low = sets.groupBy("n", "c1", "c2").agg(F.min("doc_id").alias("low"))
    # one member of each class has sent the keys of a task; any may have, so every member keeps its own edge
    classes = sets.join(low, ["n", "c1", "c2"]).select(F.col("doc_id").alias("a"), F.col("low").alias("b")).where("a <> b")
    pairs = written(near(cand.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets, percent), "pairs")
    nodes = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = written(only(usable, nodes), "texts")

    # first each set's smallest partner, then what could still connect two components
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    edges = written(classes.union(linked(first, texts, k, percent)), "edges")
    edges = written(edges.union(linked(across(pairs, components(edges)), texts, k, percent)), "edges")
    roots = written(components(edges), "roots")
    drop(texts)
    drop(pairs)

    rest = hidden(cand, sets, roots, cluster)
    drop(cand)
    if rest is not None:
        pairs = written(blocks_of(rest, percent, block), "pairs")
        drop(rest)
        nodes = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        more = written(linked(pairs, only(usable, nodes), k, percent), "edges")
        if not more.isEmpty():
            roots = written(components(edges.union(more)), "roots")
    out = profile.select("doc_id", F.col("n").alias("n_shingles"))
    return out.join(roots, out["doc_id"] == roots["id"], "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components; a node without a root is its own."""
    of = lambda x: roots.select(F.col("id").alias(f"id_{x}"), F.col("root").alias(f"root_{x}"))
    j = pairs.join(of("a"), F.col("a") == F.col("id_a"), "left").join(of("b"), F.col("b") == F.col("id_b"), "left")
    return j.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def hidden(cand: DataFrame, sets: DataFrame, roots: DataFrame, most: int) -> DataFrame | None:
    """Rows (key, doc_id, root, ...) under which pairs may still be linked unseen.

    Of its keys in large groups of several components a set dealt once needs as many as its others fall short of d+1, and
    by a common order of the keys, smaller groups first, these may be its first; one dealt again (slack below 0) needs
    all of them: linked sets share one."""
    rows = cand.where("key is not null").select("key", F.col("b").alias("doc_id"))
    rows = rows.join(roots, F.col("doc_id") == F.col("id"), "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    mixed = lambda r: r.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size")).where("x <> y").select("key", "size")
    rows = written(rows.join(mixed(rows), "key"), "mixed")
    slack = sets.groupBy("doc_id").agg(F.min("slack").alias("slack"))  # a repeated doc_id is one node
    short = rows.groupBy("doc_id").agg(F.count("*").alias("bad")).join(slack, "doc_id").where("bad > slack").select("doc_id", (F.col("bad") - F.col("slack")).alias("need"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("size", "key"))
    rows = rows.join(short, "doc_id").withColumn("rank", rank).where("rank <= need").select("key", "doc_id", "root")
    rows = written(rows.join(mixed(rows).select("key"), "key"), "short")
    if rows.isEmpty():
        return None
    low = rows.groupBy("key").agg(F.min("doc_id").alias("low"))
    cluster = components(rows.join(low, "key").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))).select(F.col("id").alias("doc_id"), F.col("root").alias("cluster"))
    rows = rows.join(cluster, "doc_id")
    one = rows.select("cluster", "doc_id", "root").distinct()
    many = one.groupBy("cluster").agg(F.count("*").alias("size")).where(F.col("size") > most).select("cluster")
    by_cluster = one.join(many, "cluster", "left_anti").select(F.struct(F.lit(True).alias("whole"), F.col("cluster").alias("id")).alias("key"), "doc_id", "root")
    by_key = rows.join(many, "cluster").select(F.struct(F.lit(False).alias("whole"), F.col("key").alias("id")).alias("key"), "doc_id", "root")
    return written(by_cluster.union(by_key).join(sets.select("doc_id", "n", "band", "own", "up"), "doc_id"), "hidden")
