"""op3 against signatures taken by plain Python, on large and negative ids and repeated rows."""

import random
import re

from test_small import table, words

from loam.llm.spotsigs import ANCHORS, fingerprints

COMMON = {w for group in ANCHORS.values() for w in group.split()}


def signatures(text):
    """Each common word with the next two others; without any, 3-word sequences or all words."""
    w = [x.decode() for x in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())]
    w = ["".join(c.lower() if c.isascii() else c for c in x) for x in w]
    out = set()
    for i, x in enumerate(w):
        if x in COMMON:
            chain = [y for y in w[i + 1 :] if y not in COMMON][:2]
            if len(chain) == 2:
                out.add((x, *chain))
    if not out and len(w) >= 3:
        out = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    return out or ({tuple(w)} if w else set())


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def check(spark, rows):
    got = sorted(fingerprints(table(spark, rows)).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    texts = {i: t or "" for i, t in rows}
    order = sorted((i for i in texts if i is not None), reverse=True) + [None] * (None in texts)
    assert [r.doc_id for r in got] == sorted(x for x, _ in rows if x is not None) + [x for x, _ in rows if x is None]
    for r in got:
        mine = [i for i, _ in rows].count(r.doc_id)
        t, after = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        if mine == 1:
            edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            assert r.edited == edited and r.n_chars == len(t)
            assert abs(r.near_next - jaccard(signatures(t), signatures(after))) < 1e-12
            assert abs(r.near_edited - jaccard(signatures(t), signatures(edited))) < 1e-12
        assert len(r.fingerprint) == 8 * len(signatures(t)) and len(r.edited_fingerprint) == 8 * len(signatures(r.edited))


def some_texts(n, seed):
    r = random.Random(seed)
    common = sorted(COMMON)
    out = []
    for i in range(n):
        w = [r.choice(common) if r.random() < 0.4 else x for x in words(r.choice([0, 1, 2, 5, 40, 90]), seed + i, 60)]
        out.append(" ".join(w) + r.choice(["", ". Été, 中文!", " A-b C"]))
        if i % 5 == 0 and out[-2:-1]:
            out[-1] = out[-2] + " " + out[-1]
    return out


def test_signatures(spark):
    check(spark, [*enumerate(some_texts(120, 1)), (None, "the null row of it all"), (500, None), (501, "")])


def test_large_and_negative_ids(spark):
    texts = some_texts(400, 2)
    check(spark, [((1 << 60) + 7 * i, t) for i, t in enumerate(texts)])
    check(spark, [(-(1 << 62) + i, t) for i, t in enumerate(texts[:50])] + [((1 << 62) + i, t) for i, t in enumerate(texts[50:90])])


def test_repeated_rows(spark):
    texts = some_texts(30, 3)
    rows = [(i // 3, texts[i // 3]) for i in range(90)]
    got = fingerprints(table(spark, rows)).collect()
    assert len(got) == 90
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, same in by.items():
        assert len({r.fingerprint for r in same}) == 1 and sum(r.near_next == 1.0 for r in same) >= 2  # each but one follows its equal
    check(spark, [(1, "one row")])
