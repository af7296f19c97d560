"""op9 where the smallest document of a segment holds it at several places or in several rows."""

import random

from test_small import brute_dedup, table, words


def dedup(spark, rows):
    from loam.llm.substring_dedup import substring_dedup

    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup(table(spark, rows)).collect()), key=repr)


def test_repeated_paragraph(spark):
    """A passage of an earlier document stands again and again, in equal surroundings, in a later one, or in its other row."""
    rows = []
    for i in range(40):
        p, q, r = words(51 + i % 30, 7000 + i), words(40, 7100 + i), words(40, 7200 + i)
        again = q + p + r
        rows.append((10 * i, " ".join(words(30, 7300 + i) + p + words(30, 7400 + i))))
        rows.append((10 * i + 1, " ".join(again + words(45, 7500 + i) + again + words(35, 7600 + i) + again)))
        rows += [(10 * i + 1, " ".join(words(33, 7700 + i) + again + words(20, 7800 + i))), (10 * i + 2, " ".join(again))]
    assert dedup(spark, rows) == brute_dedup(rows)


def test_document_9931(spark):
    """A line repeated many times whose words partly stand in an earlier document of the test data."""
    found = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id in (9002, 9931)").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in found.collect()]
    got = dedup(spark, rows)
    assert got == brute_dedup(rows) and sum(n for _, _, n, _ in got) > 0


def test_merged_in_pieces():
    """Groups that span batches give the spans that they give in one batch, and these are the whole ones."""
    import pyarrow as pa

    from loam.llm.substring_dedup import merged

    r = random.Random(11)
    rows = []
    for a in range(60):
        for g in range(r.choice([1, 1, 2, 3])):
            for doc in sorted(r.choices(range(6), k=r.choice([1, 2, 4, 9]))):
                rows.append((a, g, doc, r.randint(0, 1), len(rows), 1, doc < 2))
    rows.sort(key=lambda x: x[:3])
    names = ["a", "g", "doc_id", "tag", "at", "n", "old"]

    def told(size):
        batches = (pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in rows[i : i + size]]) for i in range(0, len(rows), size))
        return {(x["whole"], x["at"]) for b in merged(batches) for x in b.to_pylist()}

    want = set()
    for a in range(60):
        mine = [x for x in rows if x[0] == a]
        low = {g: min(x[2] for x in mine if x[1] == g) for g in {x[1] for x in mine}}
        want |= {(True, x[4]) for x in mine if not x[6] and x[2] > low[x[1]]}
        if len(low) > 1 and len({x[2] for x in mine}) > 1 and not all(x[6] for x in mine):
            want |= {(False, x[4]) for x in mine if not x[6] and x[2] == low[x[1]]}
    for size in (1, 2, 3, 7, 50, 10**6):
        got = told(size)
        assert {x for x in got if x[0]} == {x for x in want if x[0]} and want <= got
