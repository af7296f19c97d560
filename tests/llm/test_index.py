"""The fingerprint index over many increments: reopened between them, conflicts of writers, no exchange over old runs."""

import pytest
from pyspark.sql import functions as F
from test_small import brute_dedup, table, words


def texts():
    """Ten batches of ten texts that share passages across batches and within them."""
    rows = []
    for i in range(100):
        passage, other = words(60 + i % 13, 900 + i % 17), words(52, 800 + i % 5)
        rows.append((i, " ".join(words(20 + i % 7, i) + passage + words(30, 5000 + i) + (other if i % 3 else []) + words(9, 6000 + i))))
    return rows


def test_ten_increments_and_reopening(spark, tmp_path):
    from loam.llm.substring_dedup import FingerprintIndex, tagged
    from loam.manifest import Conflict

    rows = texts()
    docs = tagged(table(spark, rows))
    path, gone = f"file://{tmp_path}/index", {}
    for low in range(0, 100, 10):
        index = FingerprintIndex(docs, fanout=3, path=path)  # each batch by an index opened anew
        assert len(index.runs) == min(3, low // 10) if low <= 30 else 1 <= len(index.runs) <= 3
        index.add(docs.where((F.col("doc_id") >= low) & (F.col("doc_id") < low + 10)))
        for r in index.covered().collect():
            gone.setdefault(r.doc_id, set()).update(range(r.at, r.at + r.n + 49))
    assert {i: len(g) for i, g in gone.items()} == {i: n for i, _, n, _ in brute_dedup(rows) if n}
    one, other = FingerprintIndex(docs, path=path), FingerprintIndex(docs, path=path)
    one.add(docs.where("doc_id < 0"))
    with pytest.raises(Conflict):
        other.add(docs.where("doc_id < 0"))


def test_old_runs_are_not_moved(spark, tmp_path):
    from loam.llm.substring_dedup import FingerprintIndex, tagged

    docs = tagged(table(spark, texts()))
    index = FingerprintIndex(docs, fanout=9, path=f"file://{tmp_path}/index")
    index.add(docs.where("doc_id < 50"))
    index.add(docs.where("doc_id >= 50"))
    old, new = index.runs
    plan = index.matched(old, index.rows(new).select("a"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    index.compact()
    assert len(index.runs) == 1 and index.rows(index.runs[0]).groupBy("a", "g").count().where("count > 1").isEmpty()
