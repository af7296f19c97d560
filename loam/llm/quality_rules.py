"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is measured once for each text. The ledger row holds the measurements and one bit for each rule that
fails; a policy is a named, versioned mask (and base rules are bits as well), so another policy, or leaving out one
rule, needs no second look at the texts: `apply_policy` tests bits, `ablation` counts by bitwise aggregation, both on a ledger that
`store_ledger` has written once.

Words are runs of `[^\\x20\\x09-\\x0D]`. Repeats inside a text are found by sorting hashes of its 3-word windows; the
arrays of one row are bounded by its text, and no rows are shuffled.

Defined results: null or blank text: no words, all measurements 0, base_failed. Null doc_id: kept as it is. Repeated rows
have equal measurements, each its own row. Values at a limit (ties) pass. Extra columns are ignored by the ledger, whatever their names,
and handed on by `keep`; an empty table gives no rows, and an ablation of zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Rules in the order of their bits: name, what it measures, the limit, and whether the text fails above it.
RULES: list[tuple[str, str, float, bool]] = [
    ("few_words", "n_words", 50, False),
    ("repeated_words", "repeat_share", 0.5, True),
    ("symbol_density", "symbol_share", 0.06, True),
    ("duplicate_lines", "dup_line_share", 0.5, True),
    ("long_words", "mean_word", 20, True),
    ("short_words", "mean_word", 2, False),
    ("capitals", "capital_share", 0.5, True),
    ("exclamations", "shout_share", 0.3, True),
]
BASE = 0b11
PLACE = 20
#: Policies by name and version: the rules whose failure rejects a text. Later versions never change earlier ones.
POLICIES: dict[str, int] = {
    "base@1": 0b00000011,
    "strict@1": 0b01111111,
    "strict@2": 0b11111111,
}


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def measured(docs: DataFrame, carry: bool = False, place: int = PLACE) -> DataFrame:
    """doc_id and the measurements of each whole text; with `carry` also `_row`, a struct of all the row's columns. Texts of fewer
    than 2 ** `place` windows are sorted as plain numbers, longer ones as pairs: the results are the same."""
    held = [F.struct(*[F.col(c) for c in docs.columns]).alias("_row")] if carry else []
    df = docs.select(*held, "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    df = df.withColumn("_w", F.array_remove(F.split("_t", SPACE), ""))
    df = df.withColumn("_joined", F.array_join("_w", "")).withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    n = F.size("_w")
    df = df.withColumn("n_words", n.cast("bigint"))
    grams = F.transform("_h", lambda h, i: F.xxhash64(h, F.get("_h", i + 1), F.get("_h", i + 2)))
    df = df.withColumn("_g", F.slice(grams, 1, F.greatest(n - 2, F.lit(0))))
    df = df.withColumn("_distinct", F.size(F.array_distinct("_g")) == F.size("_g"))
    # of texts with a repeated window: hashes whose low place bits give way to the place, sorted as plain numbers
    packed = F.transform("_g", lambda h, i: h.bitwiseAND(F.lit(-(1 << place))).bitwiseOR(i.cast("bigint")))
    df = df.withColumn("_s", F.when(~F.col("_distinct") & (F.size("_g") < 1 << place), F.sort_array(packed)))
    alike = lambda x, j, k: F.coalesce(F.shiftrightunsigned(F.get("_s", j + k).bitwiseXOR(x), place) == 0, F.lit(False))
    df = df.withColumn("_twice", F.filter("_s", lambda x, j: alike(x, j, -1) | alike(x, j, 1)))
    # hashes that agree in the high bits only, and texts with more places, are sorted with their whole hashes
    low_bits = lambda x: x.bitwiseAND(F.lit((1 << place) - 1)).cast("int")
    prev = lambda j: F.get("_twice", j - 1)
    clash = F.exists(F.transform("_twice", lambda x, j: (F.shiftrightunsigned(prev(j).bitwiseXOR(x), place) == 0) & (F.get("_g", low_bits(x)) != F.get("_g", low_bits(prev(j))))), lambda b: F.coalesce(b, F.lit(False)))
    df = df.withColumn("_whole", ~F.col("_distinct") & (F.col("_s").isNull() | clash))
    df = df.withColumn("_pairs", F.when(F.col("_whole"), F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    equal = lambda x, j, k: F.coalesce(F.get("_pairs", j + k)["h"] == x["h"], F.lit(False))
    slow = F.transform(F.filter("_pairs", lambda x, j: equal(x, j, -1) | equal(x, j, 1)), lambda x: x["i"])
    df = df.withColumn("_at", F.sort_array(F.when(F.col("_whole"), slow).otherwise(F.transform("_twice", low_bits))))
    cover = F.aggregate(F.transform("_at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_at", j + 1) - p, F.lit(3)))), F.lit(0), lambda s, x: s + x)
    df = df.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0)).cast("bigint"))
    df = df.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.ltrim(x, F.lit(" \t\r\x0b\x0c")) != ""))
    count = lambda pattern: (F.size(F.split("_t", pattern)) - 1).cast("bigint")
    df = df.select(
        *(["_row"] if carry else []),
        "doc_id",
        "n_words",
        F.length("_joined").cast("bigint").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_lines").cast("bigint").alias("n_lines"),
        count("!").alias("n_exclamations"),
        count("[A-Z]{2,}").alias("n_capital_runs"),
    )
    return df


def ledger(docs: DataFrame, carry: bool = False, place: int = PLACE) -> DataFrame:
    """Measurements and the mask `failed`: bit i is set if rule i of RULES fails."""
    df = measured(docs, carry, place)
    values = {
        "n_words": F.col("n_words").cast("double"),
        "repeat_share": _share(F.col("n_repeat_words"), F.col("n_words")),
        "symbol_share": _share(F.col("n_symbols"), F.col("word_chars")),
        "dup_line_share": _share(F.col("n_dup_lines"), F.col("n_lines")),
        "mean_word": F.when(F.col("n_words") > 0, F.col("word_chars") / F.col("n_words")).otherwise(F.lit(5.0)),
        "capital_share": _share(F.col("n_capital_runs"), F.col("n_words")),
        "shout_share": _share(F.col("n_exclamations"), F.col("n_words")),
    }
    bits = F.lit(0).cast("bigint")
    for i, (_, what, limit, above) in enumerate(RULES):
        fails = values[what] > limit if above else values[what] < limit
        if what == "repeat_share":  # in whole numbers, to be exact
            fails = 100 * F.col("n_repeat_words") > 50 * F.col("n_words")
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return df.withColumn("failed", bits)


def apply_policy(rows: DataFrame, policy: str = "strict@2") -> DataFrame:
    """base_failed and kept by a policy of POLICIES, from the bits alone."""
    mask = POLICIES[policy] | BASE
    return rows.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask)) == 0)


def store_ledger(docs: DataFrame, path: str) -> DataFrame:
    """Writes the ledger of all texts as Parquet, and gives it as it stands there."""
    rows = ledger(docs)
    rows.write.parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def ablation(rows: DataFrame, policy: str = "strict@2") -> DataFrame:
    """For each rule of a policy: texts that fail it, that fail it alone, and that the policy without it would keep.

    Texts are counted by their failed bits under the policy, one row for each set of bits that occurs (at most 2 to the
    number of rules); the rules' counts are sums over these."""
    mask = POLICIES[policy]
    sets = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("hit")).agg(F.count("*").alias("n"))
    total = lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))
    sums = []
    for i, (name, *_) in enumerate(RULES):
        if mask >> i & 1:
            bit, hit = 1 << i, F.col("hit")
            sums.append(F.struct(F.lit(name).alias("rule"), total(hit.bitwiseAND(F.lit(bit)) != 0).alias("n_failed"), total(hit == bit).alias("n_failed_alone"), total(hit.bitwiseAND(F.lit(~bit)) == 0).alias("n_kept_without")))
    return sets.agg(F.array(*sums).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def keep(docs: DataFrame, policy: str = "strict@2") -> DataFrame:
    """The rows of `docs` that a policy keeps, with their columns.

    The verdict carries a row number that is always true of it: a condition so marked is not moved below the columns it
    is made of, where the optimiser would write their expressions out again inside each other's loops."""
    rows = apply_policy(ledger(docs, carry=True), policy)
    rows = rows.withColumn("kept", F.col("kept") & (F.monotonically_increasing_id() >= 0))
    return rows.where("kept").select("_row.*")
