"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, spans string, tag int"


def table(spark, rows):
    """Documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 0.5, "k", "x", 7) for i, t in rows], SCHEMA)


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randint(0, vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Exact and near copies, shared passages, nulls, blanks, one long text, words in other scripts, repeated rows."""
    base = words(120, 1)
    near = base.copy()
    near[60] = "changed"
    far = base.copy()
    far[::9] = ["x"] * len(far[::9])
    passage = words(70, 2)
    out = [
        (10, " ".join(base)), (11, " ".join(base)), (12, " ".join(near)), (13, " ".join(far)),
        (20, " ".join(words(40, 3) + passage)), (21, " ".join(passage + words(30, 4))), (22, "A b\tC\n d" + " ".join(passage[:55])),
        (30, None), (31, ""), (32, " \t\n"), (33, "one two"), (34, "One TWO"), (35, "été größe ñandú 中文 🙂 and the " * 12),
        (40, " ".join(words(9000, 5))), (41, "the same line\nthe same line\nthe same line\n" * 30), (42, "###*** $$$ " * 60),
        (50, "tick " * 300), (51, "tick " * 90 + "tock " * 70), (52, "a b c " * 100), (53, "x a b c " + "a b c " * 60 + "y"),
        (None, " ".join(base)), (10, " ".join(base)),
    ]
    return out


def test_jaccard(spark, rows):
    from loam.llm.ngram_join import jaccard_components

    got = jaccard_components(table(spark, rows)).collect()
    assert len(got) == len(rows)
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets if i is not None}
    for _ in root:
        for a in root:
            for b in root:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == (None if r.doc_id is None else root[r.doc_id])


def test_jaccard_hidden_sets(spark):
    """Texts that all share most of a common passage: large groups of several components, settled in blocks."""
    from loam.llm.ngram_join import jaccard_components

    passage = words(60, 8)
    rows = [(i, " ".join(passage + words(8 + i % 12, 100 + i // 2))) for i in range(60)]
    got = {r.doc_id: r.component_id for r in jaccard_components(table(spark, rows)).collect()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {i: find(i) for i in sets}


def test_grouped_stream_in_pieces():
    """Groups that span batches give the same pairs and members as in one batch."""
    import numpy as np
    import pyarrow as pa

    from loam.llm import ngram_join as N

    r = random.Random(3)
    data = sorted((k, d) for k in range(12) for d in {r.randint(0, 99) for _ in range(r.choice([1, 2, 5, 6, 7, 8, 40]))} for _ in range(r.choice([1, 1, 2])))
    key, doc = (np.array(c, np.int64) for c in zip(*data))

    def told(size):
        batches = (pa.RecordBatch.from_arrays([pa.array(key[i : i + size]), pa.array(doc[i : i + size]), pa.nulls(len(key[i : i + size]), pa.int64())], names=["key", "doc_id", "first"]) for i in range(0, len(key), size))
        return sorted(((x["key"], x["a"], x["b"]) for b in N.grouped(6)(batches) for x in b.to_pylist()), key=repr)

    whole = told(10**6)
    assert whole and all(told(size) == whole for size in (1, 3, 7, 50))


def brute_dedup(rows, size=50):
    first = {}
    seqs = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in seqs:
        if i is not None:
            for s in range(len(w) - size + 1):
                k = tuple(w[s : s + size])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in seqs:
        gone = set()
        for s in range(len(w) - size + 1):
            if i is not None and first[tuple(w[s : s + size])] < i:
                gone.update(range(s, s + size))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


def test_substring_dedup(spark, rows):
    from loam.llm.substring_dedup import substring_dedup

    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup(table(spark, rows)).collect()), key=repr)
    assert got == brute_dedup(rows)


def test_index_over_many_batches(spark, rows):
    """Batch after batch with compaction in between covers the same words as all at once."""
    from loam.llm.substring_dedup import FingerprintIndex, tagged

    kept = [(i, t) for i, t in rows if i is not None]
    docs = tagged(table(spark, kept))
    index = FingerprintIndex(docs, fanout=2)
    for low, high in ((0, 10), (10, 12), (12, 21), (21, 99)):
        index.add(docs.where((F.col("doc_id") > low) & (F.col("doc_id") <= high)))
    assert len(index.runs) <= 2
    gone = {}
    for r in index.covered().collect():
        gone.setdefault(r.doc_id, set()).update(range(r.at, r.at + r.n + 49))
    assert {i: len(g) for i, g in gone.items()} == {i: n for i, _, n, _ in brute_dedup(kept) if n}


def test_quality_rules(spark, rows):
    from loam.llm.quality_rules import POLICIES, RULES, ablation, apply_policy, keep, ledger

    docs = table(spark, rows)
    got = apply_policy(ledger(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        w = WORD.findall(t or "")
        c = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        cover = {j + k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover))
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and (r.kept is False or not r.base_failed)
    assert by[10].kept and not by[42].kept and not by[41].kept
    assert sorted(keep(docs).columns) == sorted(docs.columns)
    assert keep(docs).count() == sum(r.kept for r in got)
    for place in (2, 6):  # texts too long for plain numbers, and hashes that agree in their high bits
        assert sorted(map(tuple, ledger(docs, place=place).collect()), key=repr) == sorted(map(tuple, ledger(docs).collect()), key=repr)
    found = {r.rule: r for r in ablation(ledger(docs)).collect()}
    assert found["few_words"].n_failed == sum(r.failed & 1 for r in got) and len(found) == bin(POLICIES["strict@2"]).count("1") == len(RULES)


def test_sharding(spark, rows):
    from loam.llm.sharding import rendezvous, shard

    got = shard(table(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t in rows}
    for r in got:
        b = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(b) + 1, zlib.crc32(b)) and r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    ids = spark.range(4000).select(rendezvous(F.col("id"), [1.0, 3.0]).alias("s")).groupBy("s").count().collect()
    assert abs({r.s: r["count"] for r in ids}[1] / 4000 - 0.75) < 0.03


def test_packing(spark, rows):
    import numpy as np

    from loam.llm.packing import boundaries, pack_documents

    r = random.Random(2)
    for _ in range(30):
        n, k = r.randint(1, 9), r.randint(1, 4)
        top = np.cumsum([r.randint(1, 5) for _ in range(n)])
        count = np.array([r.randint(1, 6) for _ in range(n)])
        ends = boundaries(top, count, top * count, k)
        cost = lambda e: sum(c * (min(x for x in e if x >= t) - t) for t, c in zip(top, count))
        import itertools

        best = min(cost([*e, top[-1]]) for m in range(k) for e in itertools.combinations(top[:-1], min(m, n - 1)))
        assert len(ends) <= k and cost(ends) == best
    got = pack_documents(table(spark, rows), buckets=3, budget=500).collect()
    assert len(got) == len(rows)
    batches = Counter((x.bucket, x.batch) for x in got)
    for x in got:
        assert x.n_tokens <= x.boundary and batches[(x.bucket, x.batch)] * x.boundary <= max(500, x.boundary)
    assert len({(x.bucket, x.batch, x.slot) for x in got}) == len(rows)


def test_spotsigs(spark, rows):
    from loam.llm.spotsigs import fingerprints, near_pairs

    unique = [x for x in rows if x != rows[0]] + [rows[0]]
    got = {r.doc_id: r for r in fingerprints(table(spark, unique)).collect()}
    texts = {i: t or "" for i, t in unique}
    order = sorted((i for i in texts if i is not None), reverse=True) + [None]
    for at, i in enumerate(order):
        t, after = texts[i], texts[order[(at + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (got[i].n_chars, got[i].edited) == (len(t), edited)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[10].fingerprint == got[11].fingerprint == got[None].fingerprint and got[11].near_next == 1.0
    assert got[31].fingerprint == ""
    sets = {i: {r.fingerprint[j : j + 8] for j in range(0, len(r.fingerprint), 8)} for i, r in got.items() if i is not None and r.fingerprint}
    classes = {}
    for i in sorted(sets):
        classes.setdefault(frozenset(sets[i]), i)
    ids = sorted(classes.values())
    want = {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in near_pairs(table(spark, unique), 0.6).collect()} == want and want


def test_bpe(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    from loam.llm.bpe import decode, encode, joined_ids, round_trip

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    more = [(90, "a<|endoftext|>b  c\n\n d's 12ab x  y"), (91, "a" * 5000), (92, "naïve 🙂🙂 é")]
    docs = table(spark, rows + more)
    got = decode(encode(docs, f"file://{path}"), f"file://{path}").select("doc_id", "text", "ids", "decoded", joined_ids("ids").alias("j"), "score").collect()
    assert len(got) == len(rows) + 3
    for r in got:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False) and r.j == ",".join(map(str, ids))
    once = round_trip(docs, f"file://{path}")
    assert once.columns == [*(c for c in docs.columns if c != "text"), "ids", "decoded"]
    key = lambda r: (str(r.doc_id), r.ids, r.decoded, str(r.score))
    assert sorted(map(key, once.collect())) == sorted(map(key, got))


def test_bpe_tables_stay_small():
    """Few kept pieces and texts read piece by piece give the same ids; bytes that are no text, and unknown ids."""
    import numpy as np
    import pyarrow as pa
    import public_tokenizers

    from loam.llm.bpe import Decoder, Encoder

    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        file = f.read()
    usual, small, decoder = Encoder(file), Encoder(file, kept=3, long_text=10), Decoder(file)
    texts = [" ".join(words(300, i)) + "<|endoftext|> été 🙂" for i in range(5)] + ["", "x"]
    assert [usual.encode(t) for t in texts] == [small.encode(t) for t in texts] and len(small.known) <= 4
    ids = [np.frombuffer(usual.encode(t), np.int32) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    assert decoder.decode(np.concatenate(ids), offsets).to_pylist() == texts
    part = np.frombuffer(usual.encode("🙂"), np.int32)[:1]
    assert decoder.decode(part, np.array([0, 1])).to_pylist() == ["\ufffd"]
    for bad in (-1, 10**6):
        with pytest.raises(ValueError):
            decoder.decode(np.array([bad]), np.array([0, 1]))
    assert decoder.decode(np.zeros(0, np.int32), np.array([0, 0])).type == pa.string()


PAGES = {
    None: "", "": "", "plain &amp; text": "plain & text", "<script>var x = '<p>no</p>';</script>": "",
    "<body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>One\n two<p>three <b>four</b> five six seven</article><footer>f</footer>": "T\nOne two\nthree four five six seven",
    "<header>Site</header><div class='sidebar x'>menu</div><main><h2>A &lt;B&gt;</h2><p>Text here, and more of it.</p><div id=comments><p>bad</p></div><form>q</form><ul><li>x<li>y</ul></main>": "A <B>\nText here, and more of it.\nx\ny",
    "<article><p>unclosed <i>tags <div class=ad>buy</div>end of it": "unclosed tags\nend of it",
}


def test_html(spark):
    from loam.llm.html_text import extract, extract_pages

    for page, text in PAGES.items():
        assert extract(page) == text
    assert extract("<div>" * 3000 + "deep text" + "</div>" * 3000) == "deep text"
    rows = spark.createDataFrame([(i, "u", h, "x") for i, h in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_pages(rows).collect()}
    assert got == {i: (t, len(t)) for i, t in enumerate(PAGES.values())}


def test_licenses(spark, rows):
    from loam.llm.license_scan import TEMPLATES, scan

    grant = TEMPLATES["MIT grant"].split()
    grant[20:22] = ["other", "words"]
    more = [(50, "été é. Released under the MIT License.\nReleased under the MIT License. x"), (51, "a " + " ".join(grant)), (52, "released under terms")]
    docs = table(spark, rows + more)
    got = sorted((r.doc_id, r.license, r.start_char, r.end_char) for r in scan(docs).collect())
    assert [g[:2] for g in got] == [(50, "MIT line"), (50, "MIT line"), (51, "MIT grant")]
    texts = dict(more)
    assert [texts[i][a:b] for i, _, a, b in got[:2]] == ["Released under the MIT License"] * 2


def test_classifier(spark):
    from loam.llm.common import table as load
    from loam.llm.quality_classifier import classify

    sf = "/root/testdata/sf0.01"
    docs, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    got = {r.doc_id: r for r in classify(docs, labels).select("doc_id", "text", "held_out", "score", "predicted").collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.95
    # labels of held-out rows don't matter
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in classify(docs, flipped).select("doc_id", "score").collect()}
    assert all(again[i] == got[i].score for i in got)


def test_empty_tables(spark, rows):
    from loam.llm import bpe, html_text, license_scan, ngram_join, packing, quality_classifier, quality_rules, sharding, spotsigs, substring_dedup

    none = table(spark, rows).where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert ngram_join.jaccard_components(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    assert quality_rules.apply_policy(quality_rules.ledger(none)).count() == 0
    assert sharding.shard(none).count() == 0 and packing.pack_documents(none).count() == 0
    assert spotsigs.fingerprints(none).count() == 0 and license_scan.scan(none).count() == 0
    assert quality_classifier.classify(none, labels).count() == 0
    got = quality_classifier.classify(table(spark, rows), labels).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.5}
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    import public_tokenizers

    assert bpe.encode(none, f"file://{public_tokenizers.path('byte_bpe_50k.json')}").count() == 0
    assert bpe.round_trip(none, f"file://{public_tokenizers.path('byte_bpe_50k.json')}").count() == 0


def test_pipeline(spark, rows, tmp_path):
    """Each stage keeps the columns; clean texts stay; one of each near group; a shared passage stays once."""
    import corpus_pipeline as P

    kept = [(i, t) for i, t in rows if i is not None]
    clean = [(100 + i, " ".join(words(130, 1000 + i, 5000))) for i in range(8)]
    docs = table(spark, kept + clean)
    base = f"{tmp_path}/sf"
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, 0) for i in range(8)] + [(42, 0, 0), (10, 1, 0), (40, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    cur = spark.read.parquet(f"{base}/documents.parquet")
    for name, stage in P.STAGES[1:4]:
        out = stage(spark, cur, base)
        assert out.columns == cur.columns, name
        cur = out
    ids = sorted(x.doc_id for x in cur.collect())
    assert {100 + i for i in range(8)} <= set(ids) and 11 not in ids and 12 not in ids and 42 not in ids
    final = P.run(spark, base)
    assert "batch" in final.columns and final.count() > 0
