"""Bloom filters as column expressions: sizes, FNV-1a hashes, bit places, membership, rates, encoding.

Bit places follow the documented scheme exactly: FNV-1a of the key's bytes, continued with the four little-endian bytes
of seed + i for the i-th probe, modulo the number of bits. A filter is a relation of set places."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the hash, and of the encoded form: bytes of its header, which holds m, k, n and the seed in little-endian order.
SEED, OFFSET, PRIME, MASK = 0x9747B28C, 2166136261, 16777619, 4294967295
HEADER = 16


def sizes(n: int, per_key: int) -> tuple[int, int]:
    """(m, k) of a filter for n keys, as `bits` and `probes` give them."""
    n, per_key = max(n, 1), per_key if per_key > 0 else 10
    m = max(n * per_key, 8)
    return m, min(max(math.ceil(m / n * math.log(2.0)), 1), 30)


def places(key: str, k: int, m: int) -> list[int]:
    """The bit places of one key, as `locations` gives them."""
    out = []
    for i in range(k):
        h = OFFSET
        for byte in key.encode() + ((SEED + i) & MASK).to_bytes(4, "little"):
            h = (h ^ byte) * PRIME & MASK
        out.append(h % m)
    return out


def bits(n: Column, per_key: Column) -> Column:
    """m: at least 8 bits, 10 a key where nothing sensible is asked for."""
    n, per_key = F.when(n <= 0, 1).otherwise(n), F.when(per_key <= 0, 10).otherwise(per_key)
    return F.greatest(n * per_key, F.lit(8)).cast("bigint")


def probes(n: Column, per_key: Column) -> Column:
    """k = ceil(m / n * ln 2), from 1 to 30."""
    m, n = bits(n, per_key), F.when(n <= 0, 1).otherwise(n)
    return F.least(F.greatest(F.ceil(m / n * F.log(F.lit(2.0))), F.lit(1)), F.lit(30)).cast("int")


def step(h: Column, byte: Column) -> Column:
    return (h.bitwiseXOR(byte) * F.lit(PRIME)).bitwiseAND(F.lit(MASK))


def fnv(key: str) -> Column:
    """FNV-1a, 32 bits, of a string's UTF-8 bytes."""
    size = F.octet_length(key)
    places = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: i <= F.octet_length(key))
    byte = lambda i: F.conv(F.hex(F.substring(F.encode(F.col(key), "UTF-8"), i, F.lit(1))), 16, 10).cast("bigint")
    return F.aggregate(places, F.lit(OFFSET).cast("bigint"), lambda h, i: step(h, byte(i)))


def locations(h: Column, k: int, m: int) -> Column:
    """The k bit places of a key from its hash `h`: only the seed's bytes are hashed again."""
    out = []
    for i in range(k):
        x = h
        for j in range(4):
            x = step(x, F.lit((SEED + i) >> 8 * j & 255).cast("bigint"))
        out.append(x % F.lit(m))
    return F.array(*out)


def filter_bits(keys: DataFrame, k: int, m: int) -> DataFrame:
    """The set places (pos) of a filter over `key`."""
    return keys.select(fnv("key").alias("h")).select(F.explode(locations(F.col("h"), k, m)).alias("pos")).distinct()


def may_contain(keys: DataFrame, places: DataFrame, k: int, m: int) -> DataFrame:
    """(key, may_contain): whether all of a key's places are set."""
    asked = keys.select("key").distinct().withColumn("h", fnv("key")).select("key", F.explode(locations(F.col("h"), k, m)).alias("pos"))
    hit = asked.join(places.withColumn("set", F.lit(True)), "pos", "left")
    return hit.groupBy("key").agg(F.bool_and(F.coalesce("set", F.lit(False))).alias("may_contain"))


def runs_to_read(runs: DataFrame, key: str, k: int, m: int) -> DataFrame:
    """run_id of the runs whose own filter, over their keys, may contain the key; the others need not be read."""
    places = runs.select("run_id", fnv("key").alias("h")).select("run_id", F.explode(locations(F.col("h"), k, m)).alias("pos")).distinct()
    asked = runs.sparkSession.range(1).select(F.lit(key).alias("key")).select(F.array_distinct(locations(fnv("key"), k, m)).alias("p"))
    asked = asked.select(F.size("p").alias("need"), F.explode("p").alias("pos"))  # at most k rows
    return places.join(F.broadcast(asked), "pos").groupBy("run_id", "need").agg(F.count("*").alias("n")).where("n = need").select("run_id")


def false_positive_rate(k: Column, m: Column, x: Column) -> Column:
    """(1 - e^(-k x / m))^k; 0 without elements."""
    return F.when(x <= 0, F.lit(0.0)).otherwise(F.pow(F.lit(1.0) - F.exp(-k * x / m), k))


def encoded(places: DataFrame) -> DataFrame:
    """(byte, bits): the filter's non-zero bytes, place p being bit p mod 8 of byte p div 8."""
    return places.groupBy(F.floor(F.col("pos") / 8).cast("bigint").alias("byte")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("pos") % 8).cast("int"))).cast("int").alias("bits"))


def decoded(data: DataFrame) -> DataFrame:
    """Set places of (byte, bits) rows."""
    rows = data.select("byte", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.getbit("bits", i) == 1)).alias("i", "set"))
    return rows.where("set").select((F.col("byte") * 8 + F.col("i")).alias("pos"))


def reset(places: DataFrame) -> DataFrame:
    """The filter without any place set; its sizes stay."""
    return places.where("false")


def byte_at(data: Column, i: Column) -> Column:
    """The i-th byte of a binary, from 1."""
    return F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("bigint")


def number_at(data: Column, at: int) -> Column:
    """The unsigned 32-bit number at a place of the header."""
    out = F.lit(0).cast("bigint")
    for j in range(4):
        out = out + F.call_function("shiftleft", byte_at(data, F.lit(at + j + 1)), F.lit(8 * j))
    return out


def encoded_bytes(places: DataFrame, k: int, m: int, n: int) -> DataFrame:
    """One row (data): the filter as bytes, header and ceil(m / 8) bytes of bits. A filter is one value, so its size is bounded by
    what a binary can hold."""
    header = "".join(x.to_bytes(4, "little").hex() for x in (m, k, n, SEED))
    held = encoded(places).agg(F.map_from_entries(F.collect_list(F.struct("byte", "bits"))).alias("bytes"))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit((m + 7) // 8 - 1).cast("bigint"))
    body = F.array_join(F.transform(every, lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at("bytes", i), F.lit(0))), 2, "0")), "")
    return held.select(F.unhex(F.concat(F.lit(header), body)).alias("data"))


def decoded_bytes(rows: DataFrame) -> DataFrame:
    """Adds to rows with a binary `data`: valid, and where it is, m, k, n, seed and the set places in order."""
    data = F.col("data")
    m = F.when(F.octet_length(data) >= HEADER, number_at(data, 0))
    rows = rows.withColumn("m", m).withColumn("valid", F.coalesce(is_valid(data, F.col("m")), F.lit(False)))
    for at, name in ((4, "k"), (8, "n"), (12, "seed")):
        rows = rows.withColumn(name, F.when(F.col("valid"), number_at(data, at)))
    rows = rows.withColumn("m", F.when(F.col("valid"), F.col("m")))
    every = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("m") - 1, F.lit(0)))
    is_set = lambda p: (F.col("m") > 0) & (F.getbit(byte_at(data, (F.floor(p / 8) + HEADER + 1).cast("int")), (p % 8).cast("int")) == 1)
    return rows.withColumn("places", F.when(F.col("valid"), F.filter(every, is_set)))


def must_decode(rows: DataFrame) -> DataFrame:
    """The same, but data that is not valid gives the empty filter for `estimated_n` keys at 10 bits each."""
    rows, n = decoded_bytes(rows), F.col("estimated_n")
    for name, value in (("m", bits(n, F.lit(10))), ("k", probes(n, F.lit(10))), ("n", F.greatest(n, F.lit(1))), ("seed", F.lit(SEED)), ("places", F.array().cast("array<bigint>"))):
        rows = rows.withColumn(name, F.when(F.col("valid"), F.col(name)).otherwise(value.cast("array<bigint>" if name == "places" else "bigint")))
    return rows


def is_valid(data: Column, m: Column) -> Column:
    """Whether encoded bytes hold the 16-byte header and all bits of an m-bit filter."""
    return (F.octet_length(data) >= HEADER) & (F.octet_length(data) - HEADER >= F.ceil(m / 8))
