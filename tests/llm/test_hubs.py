"""op10 on hubs: short texts linked with many others that aren't linked with each other, so large groups hide the links."""

import random
from collections import defaultdict

from test_small import table


def brute_components(rows):
    """Smallest doc_id of each component, by all pairs that share a shingle."""
    sets = []
    for i, t in rows:
        w = t.split()
        sets.append((i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)}))
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for at, (_, s) in enumerate(sets):
        for g in s:
            holders[g].append(at)
    for p, q in {(p, q) for h in holders.values() for p in h for q in h if p < q}:
        (a, s), (b, t) = sets[p], sets[q]
        if 100 * len(s & t) >= 80 * len(s | t):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in root}


def hubs(seed, count, twice=False):
    r = random.Random(seed)
    fresh = lambda n: [f"v{r.randint(0, 10**9)}" for _ in range(n)]
    rows, ids = [], list(range(count * 40))
    r.shuffle(ids)
    for h in range(count):
        n = 4 + h % 12
        hub = fresh(n + 4)
        mine = [hub]
        for _ in range(r.randint(8, 20)):
            front = r.randint(0, n // 4)
            mine.append(fresh(front) + hub + fresh(n // 4 - front))
        for w in mine:
            i = ids.pop()
            rows.append((i, " ".join(w)))
            if twice:  # a second text under the doc_id, with links of its own to none
                rows.append((i, " ".join(fresh(n + 4))))
    return rows


def test_hubs(spark):
    from loam.llm.ngram_join import jaccard_components

    rows = hubs(5, 360)
    got = {r.doc_id: r.component_id for r in jaccard_components(table(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_hubs_of_repeated_doc_ids(spark):
    from loam.llm.ngram_join import jaccard_components

    rows = hubs(6, 72, twice=True)
    got = {r.doc_id: r.component_id for r in jaccard_components(table(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_every_path_at_small_sizes(spark):
    """Large groups, clusters over the limit, many blocks and settled rows, as very large tables have them."""
    from loam.llm.ngram_join import jaccard_components

    rows = hubs(7, 36)
    for limits in ({"small": 2, "cluster": 3, "block": 3}, {"small": 3, "cluster": 10**6, "block": 2}):
        got = {r.doc_id: r.component_id for r in jaccard_components(table(spark, rows), **limits).collect()}
        assert got == brute_components(rows), limits


def test_sets_without_enough_blocks_are_an_error(spark):
    import pytest
    from loam.llm.ngram_join import jaccard_components

    with pytest.raises(Exception, match="raise percent"):
        jaccard_components(table(spark, [(1, "a b c d e f"), (2, "a b c d e g")]), percent=10).collect()
