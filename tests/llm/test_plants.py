"""op6 on planted, edited licence texts whose spans and matched words are known by construction; op2 against brute force; op8 with weights."""

import random
import re
from collections import Counter

import numpy as np
from test_small import table, words

from loam.llm.license_scan import TEMPLATES, scan


def test_planted_licences(spark):
    r = random.Random(12)
    rows, want, other = [], [], 0
    for i, name in enumerate(sorted(TEMPLATES) * 6):
        template = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", TEMPLATES[name])
        edited, lost = list(template), 0
        for at in r.sample(range(1, len(template) - 1), len(template) // 12 if len(template) > 20 else 0):  # a line with another word may be another line
            other += 1
            edited[at] = f"other{other}"  # no edit at either end, so the span is the whole plant
            lost += 1
        before, after = words(r.randint(0, 30), i), words(r.randint(0, 30), 500 + i)
        rows.append((i, " ".join(before + edited + after)))
        start = len(" ".join(before)) + bool(before)
        want.append((i, name, len(template) - lost, len(template), len(before), len(before) + len(edited), start, start + len(" ".join(edited))))
    rows += [(1000 + i, " ".join(words(80, 9000 + i))) for i in range(20)] + [rows[0]]
    got = sorted((x.doc_id, x.license, x.n_matched, x.n_template, x.start_word, x.end_word, x.start_char, x.end_char) for x in scan(table(spark, rows)).collect())
    assert got == sorted([*want, want[0]])  # a repeated row has its match again, and no other text has any


def packed(spark, lengths, buckets, budget, coarse=None):
    from loam.llm.packing import pack

    rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id long, n long")
    return pack(rows, "n", "id", buckets, budget, coarse).collect()


def test_exact_boundaries(spark):
    """Long lengths close to each other: no padding where there are buckets enough, and none of the optimum is lost."""
    lengths = [x for x in (4097, 4102, 8200, 8207, 16400, 16415) for _ in range(50)]
    assert sum(r.boundary - r.n for r in packed(spark, lengths, 6, 65536)) == 0
    assert sum(r.boundary - r.n for r in packed(spark, lengths, 6, 65536, coarse=8)) > 0
    r = random.Random(4)
    lengths = [int(r.lognormvariate(6, 1.2)) for _ in range(400)]
    top, count = (np.array(x) for x in zip(*sorted(Counter(lengths).items())))
    best = np.full((6, len(top) + 1), np.inf)  # best[k][j]: least padding of the first j lengths in k buckets
    best[0][0] = 0
    for k in range(1, 6):
        for j in range(1, len(top) + 1):
            best[k][j] = min(best[k - 1][i] + sum(count[i:j] * (top[j - 1] - top[i:j])) for i in range(j))
    got = packed(spark, lengths, 5, 4000)
    assert sum(x.boundary - x.n for x in got) == best[1:, -1].min()
    for b in {x.bucket for x in got}:
        mine = [x for x in got if x.bucket == b]
        room = max(1, 4000 // max(mine[0].boundary, 1))
        batches = Counter(x.batch for x in mine)
        assert [batches[i] for i in range(len(batches))] == [room] * (len(mine) // room) + [len(mine) % room] * (len(mine) % room > 0)
        assert sorted((x.batch, x.slot) for x in mine) == [(i // room, i % room) for i in range(len(mine))]


def test_weighted_shards(spark):
    from loam.llm.sharding import shard

    docs = spark.range(6000).selectExpr("id as doc_id", "concat('text ', id % 100) as text")
    got = shard(docs, 3, [1.0, 2.0, 5.0]).collect()
    counts = Counter(r.shard for r in got)
    assert all(abs(counts[i] / 6000 - w / 8) < 0.03 for i, w in enumerate((1, 2, 5)))
    assert all(r.grown_shard in (r.shard, 3) for r in got) and abs(sum(r.grown_shard == 3 for r in got) / 6000 - 0.25) < 0.03
    assert all(sorted(r.slot for r in got if r.shard == i) == list(range(counts[i])) for i in counts)
