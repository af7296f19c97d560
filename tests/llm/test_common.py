"""Shared helpers: components, numbering, markers, the text kernel."""

import random
import re

import pyarrow as pa

from loam.llm import common as C
from loam.llm import text as T


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, x) for x in range(201, 260)] + [(r.randint(300, 380), r.randint(300, 380)) for _ in range(60)] + [(7, 7), (None, 3)]
    root = {x: x for e in edges if None not in e for x in e}
    for _ in root:
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    alone = {x for x in root if not any(x in e and e[0] != e[1] and None not in e for e in edges)}
    for block in (1 << 20, 2, 7, 50):  # in one block, and in many, round after round
        got = [(x.id, x.root) for x in C.components(spark.createDataFrame(edges, "a long, b long"), block=block).collect()]
        assert len(got) == len(root) - len(alone) and dict(got) == {k: v for k, v in root.items() if k not in alone}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_only_and_without(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id").union(spark.createDataFrame([(None,)], "doc_id long"))
    ids = spark.range(0, 500, 7).union(spark.range(0, 500, 7))
    assert sorted(r.doc_id for r in C.only(df, ids).collect()) == list(range(0, 500, 7))
    rest = [r.doc_id for r in C.without(df, ids).collect()]
    assert rest.count(None) == 1 and sorted(x for x in rest if x is not None) == [x for x in range(500) if x % 7]


def test_kernel():
    r = random.Random(6)
    texts = ["".join(r.choice("ab é\t\n\x0b 🙂\x85A") for _ in range(r.randint(0, 40))) for _ in range(300)] + [None, "", " "]
    column = pa.array(texts, pa.string())
    for lo, hi in T.chunks(column, size=200):
        w = T.Words(column[lo:hi])
        x = w.hashes()
        known = {}
        for i in range(hi - lo):
            words = re.findall(r"[^\x20\x09-\x0D]+", texts[lo + i] or "")
            assert [w.data[a:b].tobytes().decode() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])] == words
            for word, h in zip(words, x[w.first[i] : w.first[i + 1]]):
                assert known.setdefault(word, h) == h
        assert len(set(known.values())) == len(known)
        gone = x % 3 == 0
        kept = w.kept_text(gone).to_pylist()
        for i in range(hi - lo):
            words = re.findall(r"[^\x20\x09-\x0D]+", texts[lo + i] or "")
            assert kept[i] == " ".join(a for a, g in zip(words, gone[w.first[i] : w.first[i + 1]]) if not g)
