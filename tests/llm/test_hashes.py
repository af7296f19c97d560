"""Patterned texts on which polynomial hashes collide, whatever their base: ops 9 and 10 must tell them apart."""

import numpy as np
import pyarrow as pa
from test_repeats import dedup
from test_small import brute_dedup, table, words

from loam.llm import text as T


def thue_morse(n, a="a", b="b"):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


SAME, OTHER = "".join(thue_morse(2048)), "".join(thue_morse(2048, "b", "a"))


def test_patterned_words_differ():
    for which in (0, 1):
        for x, y in ((SAME, OTHER), (SAME[:32], OTHER[:32]), ("a" * 9, "a" * 10), ("a\x00", "a"), ("a" * 64, "a" * 65)):
            h = T.Words(pa.array([x, y, x])).hashes(which)
            assert h[0] != h[1] and h[0] == h[2]


def test_patterned_sequences_differ():
    for size in (2, 5, 25, 50, 1024):
        for which in (0, 1):
            x = T.Words(pa.array([" ".join(thue_morse(2048)), " ".join(thue_morse(2048, "b", "a"))])).hashes(which)
            h = T.sequences(x, size, which)
            assert len(h) == 4096 - size + 1 and h[0] != h[2048]
            assert np.array_equal(T.sequences(x[:size], size, which), h[:1])


def test_one_word_documents(spark):
    from loam.llm.ngram_join import jaccard_components

    rows = [(1, SAME), (2, OTHER), (3, SAME)]
    assert {r.doc_id: r.component_id for r in jaccard_components(table(spark, rows)).collect()} == {1: 1, 2: 2, 3: 1}


def test_one_word_of_a_window(spark):
    base = words(60, 1)
    rows = [(1, " ".join(base[:49] + [SAME])), (2, " ".join(base[:49] + [OTHER])), (3, " ".join(thue_morse(1500))), (4, " ".join(thue_morse(1500, "b", "a")))]
    assert dedup(spark, rows) == brute_dedup(rows)
