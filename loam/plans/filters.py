"""Queries over Bloom filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bloom as B

QUERIES: dict = {}
ORACLES: dict = {}
#: Parameters of the filters below: customers' names, 10 bits a key for 1,000 keys.
N, PER_KEY, K, M = 1000, 10, 7, 10000

PARAMS = "(VALUES (1000, 10), (0, 10), (1000, 0), (1000, 20), (1, 1), (10000, 8), (3, 40)) t(n, bits)"
HASHED = "hashed AS (SELECT key, list_reduce(list_transform(range(1, strlen(key) + 1), lambda i: CAST(('0x' || substr(hex(encode(key)), CAST(2 * i - 1 AS INT), 2)) AS BIGINT)), lambda h, x: (xor(h, x) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT)) AS h FROM keys)"


def located(k: int, m: int, hashed: str = "hashed") -> str:
    h = "h"
    for j in range(4):
        h = f"(xor({h}, ((2538058380 + i) >> {8 * j}) & 255) * 16777619) % 4294967296"
    return f"SELECT key, i, ({h}) % {m} AS pos FROM {hashed}, range(0, {k}) t(i)"


#: Asked are all customers' names, which the filters hold, and as many names that nobody has.
KEYS = "keys AS (SELECT DISTINCT c_name AS key FROM customer UNION ALL SELECT DISTINCT 'no ' || c_name FROM customer)"
ADDED = "keys AS (SELECT DISTINCT c_name AS key FROM customer)"


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


def names(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet")


def added(spark, sf_dir):
    return names(spark, sf_dir).select(F.col("c_name").alias("key")).distinct()


def asked(spark, sf_dir):
    keys = added(spark, sf_dir)
    return keys.union(keys.select(F.concat(F.lit("no "), "key")))


@query(f"SELECT n, bits, CAST(least(greatest(ceil(greatest((CASE WHEN n <= 0 THEN 1 ELSE n END) * (CASE WHEN bits <= 0 THEN 10 ELSE bits END), 8) / (CASE WHEN n <= 0 THEN 1 ELSE n END) * ln(2.0)), 1), 30) AS INT) AS k, CAST(greatest((CASE WHEN n <= 0 THEN 1 ELSE n END) * (CASE WHEN bits <= 0 THEN 10 ELSE bits END), 8) AS BIGINT) AS m FROM {PARAMS}")
def bloom_params(spark, sf_dir):
    p = spark.createDataFrame([(1000, 10), (0, 10), (1000, 0), (1000, 20), (1, 1), (10000, 8), (3, 40)], "n int, bits int")
    return p.select("n", "bits", B.probes(F.col("n"), F.col("bits")).alias("k"), B.bits(F.col("n"), F.col("bits")).alias("m"))


@query(f"WITH {KEYS}, {HASHED} SELECT key, h FROM hashed")
def bloom_fnv_hash(spark, sf_dir):
    return asked(spark, sf_dir).select("key", B.fnv("key").alias("h"))


@query(f"WITH {KEYS}, {HASHED} SELECT key, CAST(i AS INT) AS i, pos FROM ({located(K, M)})")
def bloom_locations(spark, sf_dir):
    keys = asked(spark, sf_dir).select("key", B.fnv("key").alias("h"))
    return keys.select("key", F.posexplode(B.locations(F.col("h"), K, M)).alias("i", "pos"))


BITS = f"bits AS (SELECT DISTINCT pos FROM ({located(K, M)}))"


@query(f"WITH {ADDED}, {HASHED}, {BITS} SELECT pos FROM bits")
def bloom_bits(spark, sf_dir):
    return B.filter_bits(added(spark, sf_dir), K, M)


ASKED = f"asked AS (SELECT key, h FROM (WITH {KEYS}, {HASHED} SELECT key, h FROM hashed))"
ANSWER = f"answer AS (SELECT l.key, bool_and(b.pos IS NOT NULL) AS may_contain FROM ({located(K, M, 'asked')}) l LEFT JOIN bits b ON l.pos = b.pos GROUP BY l.key)"


@query(f"WITH {ADDED}, {HASHED}, {BITS}, {ASKED}, {ANSWER} SELECT key, may_contain FROM answer")
def bloom_may_contain(spark, sf_dir):
    return B.may_contain(asked(spark, sf_dir), B.filter_bits(added(spark, sf_dir), K, M), K, M)


@query("SELECT x, round(CASE WHEN x <= 0 THEN 0.0 ELSE pow(1 - exp(-7.0 * x / 10000), 7) END, 12) AS rate FROM (VALUES (1000), (500), (2000), (0)) t(x)")
def bloom_fpr_estimate(spark, sf_dir):
    x = spark.createDataFrame([(1000,), (500,), (2000,), (0,)], "x int")
    return x.select("x", F.round(B.false_positive_rate(F.lit(7.0), F.lit(10000.0), F.col("x")), 12).alias("rate"))


@query(f"WITH {ADDED}, {HASHED}, {BITS}, {ASKED}, {ANSWER} SELECT CAST(count(*) AS BIGINT) AS n_absent, CAST(sum(CAST(may_contain AS INT)) AS BIGINT) AS n_false FROM answer WHERE key NOT IN (SELECT key FROM keys)")
def bloom_fpr_measured(spark, sf_dir):
    absent = asked(spark, sf_dir).join(added(spark, sf_dir), "key", "left_anti")
    found = B.may_contain(absent, B.filter_bits(added(spark, sf_dir), K, M), K, M)
    return found.agg(F.count("*").alias("n_absent"), F.sum(F.col("may_contain").cast("bigint")).alias("n_false"))


@query(f"WITH {ADDED}, {HASHED}, {BITS} SELECT pos // 8 AS byte, CAST(bit_or(1 << CAST(pos % 8 AS INT)) AS INT) AS bits FROM bits GROUP BY pos // 8")
def bloom_encode(spark, sf_dir):
    return B.encoded(B.filter_bits(added(spark, sf_dir), K, M))


@query(f"WITH {ADDED}, {HASHED}, {BITS} SELECT pos FROM bits")
def bloom_decode(spark, sf_dir):
    """Decoding what was encoded gives the same places."""
    return B.decoded(B.encoded(B.filter_bits(added(spark, sf_dir), K, M))).select(F.col("pos").cast("bigint").alias("pos"))


@query("SELECT n_bytes, m, n_bytes >= 16 AND n_bytes - 16 >= ceil(m / 8) AS valid FROM (VALUES (3, 8), (20, 1000), (16, 0), (141, 1000), (140, 1000)) t(n_bytes, m)")
def bloom_decode_validity(spark, sf_dir):
    rows = spark.createDataFrame([(3, 8), (20, 1000), (16, 0), (141, 1000), (140, 1000)], "n_bytes int, m int")
    return rows.select("n_bytes", "m", B.is_valid(F.unhex(F.expr("repeat('00', n_bytes)")), F.col("m")).alias("valid"))


HEX = "CAST(printf('%02X', x & 255) || printf('%02X', (x >> 8) & 255) || printf('%02X', (x >> 16) & 255) || printf('%02X', (x >> 24) & 255) AS VARCHAR)"
HEADER = " || ".join(HEX.replace("x", f"CAST({v} AS BIGINT)").replace(f"%02CAST({v} AS BIGINT)", "%02X") for v in (M, K, N, 2538058380))
ENCODED = f"packed AS (SELECT pos // 8 AS byte, CAST(bit_or(1 << CAST(pos % 8 AS INT)) AS INT) AS bits FROM bits GROUP BY pos // 8), body AS (SELECT string_agg(printf('%02X', coalesce(bits, 0)), '' ORDER BY i) AS b FROM range(0, {(M + 7) // 8}) t(i) LEFT JOIN packed ON byte = i)"


@query(f"WITH {ADDED}, {HASHED}, {BITS}, {ENCODED} SELECT {HEADER} || b AS data_hex FROM body")
def bloom_encode_bytes(spark, sf_dir):
    """The filter as one binary: header of 16 bytes, then its bits."""
    return B.encoded_bytes(B.filter_bits(added(spark, sf_dir), K, M), K, M, N).select(F.hex("data").alias("data_hex"))


@query(f"WITH {ADDED}, {HASHED}, {BITS} SELECT pos, CAST({M} AS BIGINT) AS m, CAST({K} AS BIGINT) AS k, CAST({N} AS BIGINT) AS n FROM bits")
def bloom_decode_bytes(spark, sf_dir):
    """Sizes and places read back from the binary."""
    rows = B.decoded_bytes(B.encoded_bytes(B.filter_bits(added(spark, sf_dir), K, M), K, M, N))
    return rows.select(F.explode("places").alias("pos"), "m", "k", "n")


CASES = [("010203", 100), ("E8030000070000006400000000000000" + "FF" * 4, 100), ("080000000700000064000000" + "8CB24797" + "05", 1), ("", 0)]


@query("SELECT * FROM (VALUES ('010203', false, CAST(1000 AS BIGINT), CAST(7 AS BIGINT), CAST(100 AS BIGINT), CAST(0 AS BIGINT)), ('" + CASES[1][0] + "', false, 1000, 7, 100, 0), ('" + CASES[2][0] + "', true, 8, 7, 100, 5), ('', false, 10, 7, 1, 0)) t(data_hex, valid, m, k, n, bits)")
def bloom_must_decode(spark, sf_dir):
    """Too short, too few bits for the size it names, valid, and empty: what is not valid gives an empty filter for so many keys."""
    rows = spark.createDataFrame(CASES, "data_hex string, estimated_n int").withColumn("data", F.unhex("data_hex"))
    bits = F.aggregate("places", F.lit(0).cast("bigint"), lambda s, p: s + F.call_function("shiftleft", F.lit(1).cast("bigint"), p.cast("int")))
    return B.must_decode(rows).select("data_hex", "valid", "m", "k", "n", bits.alias("bits"))
