"""Every stage of the pipeline against plain Python over its own input, with nulls, repeated rows, clashing columns and no rows."""

import random
import zlib

import pytest
from test_plants import Counter
from test_small import SCHEMA, WORD, brute_dedup, table, words

import corpus_pipeline as P


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    base = f"{tmp_path_factory.mktemp('pipeline')}/sf"
    text = words(120, 1, 5000)
    near, passage = [*text[:60], "changed", *text[61:]], words(70, 2, 5000)
    rows = [(i, " ".join(words(100 + i % 40, 1000 + i, 5000))) for i in range(100, 160)]  # clean ones
    rows += [(10, " ".join(text)), (11, " ".join(text)), (12, " ".join(near)), (10, " ".join(text)), (10, " ".join(text))]
    rows += [(20, " ".join(words(60, 3, 5000) + passage)), (21, " ".join(words(90, 4, 5000) + passage + words(60, 5, 5000)))]
    rows += [(30, None), (31, ""), (32, " \t\n"), (33, "one two"), (41, "the same line\n" * 90), (42, "###*** $$$ " * 60), (None, " ".join(words(99, 6, 5000)))]
    junk = random.Random(3)
    rows += [(200 + i, " ".join(junk.choice(["#$%", "&&", "<>", "x1"]) for _ in range(80))) for i in range(60)]
    table(spark, rows).write.parquet(f"{base}/documents.parquet")
    labels = [(i, 1, 0) for i in range(100, 160)] + [(200 + i, 0, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages(spark, base):
    from loam.llm.common import table as load
    from loam.llm.quality_classifier import classify

    docs = spark.read.parquet(f"{base}/documents.parquet")
    stages = [f for _, f in P.STAGES]
    # 1: the classifier's verdict on each row; clean rows it has no label of stay, junk it has none of goes
    one = stages[0](spark, docs, base)
    scored = classify(docs.select("doc_id", "text"), load(spark, base, "labels")).collect()
    assert one.columns == docs.columns and rows_of(one) == sorted(((r.doc_id, r.text) for r in scored if r.predicted), key=repr)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    kept = {r.doc_id for r in one.collect()}
    assert {i for i in range(100, 160) if held(i)} <= kept and not {200 + i for i in range(60) if held(200 + i)} & kept
    # the other stages on all rows, so that each meets every case
    two = stages[1](spark, docs, base)
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == {None, 10, 11, 12, 20, 21, *range(100, 160)}
    assert two.where("doc_id = 10").count() == 3 and two.first().key == "k" and two.first().tag == 7
    three = stages[2](spark, two, base)
    assert three.columns == docs.columns and sorted(r.doc_id for r in three.where("doc_id is not null").collect()) == [10, 20, 21, *range(100, 160)]
    four = stages[3](spark, three, base)
    want = {i: t for i, _, _, t in brute_dedup([(r.doc_id, r.text) for r in three.collect()])}
    got = {r.doc_id: r for r in four.collect()}
    assert four.columns == docs.columns and len(got) == three.count() and got[21].text == want[21] != "" and len(WORD.findall(got[21].text)) == 150
    assert all(r.text.split() == want[i].split() and r.n_chars == len(r.text) for i, r in got.items())
    five = stages[4](spark, four, base).collect()
    assert Counter(r.doc_id for r in five) == Counter(list(got)) and all(r.n_tokens == len(got[r.doc_id].text.split()) <= r.boundary for r in five)
    lengths = sorted({r.n_tokens for r in five})
    assert sum(r.boundary - r.n_tokens for r in five) <= sum(max(x for x in lengths) - r.n_tokens for r in five)


def test_run_is_its_stages(spark, base):
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, base)
    assert sorted(map(tuple, docs.collect()), key=repr) == sorted(map(tuple, P.run(spark, base).collect()), key=repr)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0, name
    assert P.run(spark, str(tmp_path)).count() == 0
