"""SQL forms of the operators that SQL can express, for an independent engine."""

_WORDS = r"""
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d)"""

QUALITY_RULES = rf"""
WITH {_WORDS},
g AS (SELECT doc_id, i, w[i:i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c >= 2),
cover AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, range(0, 3) t(j) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    coalesce(dup, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    len(regexp_extract_all(t, '[!]')) AS n_exclamations, len(regexp_extract_all(t, '[A-Z]{{2,}}')) AS n_capital_runs
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN cover c ON c.doc_id = w.doc_id),
f AS (
  SELECT *,
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN n_symbols > 0 AND n_symbols::DOUBLE / word_chars > 0.06 THEN 4 ELSE 0 END
    + CASE WHEN n_lines > 0 AND n_dup_lines::DOUBLE / n_lines > 0.5 THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND word_chars::DOUBLE / n_words > 20 THEN 16 ELSE 0 END
    + CASE WHEN n_words > 0 AND word_chars::DOUBLE / n_words < 2 THEN 32 ELSE 0 END
    + CASE WHEN n_words > 0 AND n_capital_runs::DOUBLE / n_words > 0.5 THEN 64 ELSE 0 END
    + CASE WHEN n_words > 0 AND n_exclamations::DOUBLE / n_words > 0.3 THEN 128 ELSE 0 END AS failed
  FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, CAST(failed AS BIGINT) AS failed
FROM f
"""

ABLATION = f"""
WITH ledger AS ({QUALITY_RULES}),
rules AS (SELECT * FROM (VALUES (0, 'few_words'), (1, 'repeated_words'), (2, 'symbol_density'), (3, 'duplicate_lines'), (4, 'long_words'), (5, 'short_words'), (6, 'capitals'), (7, 'exclamations')) t(i, rule))
SELECT rule, CAST(count(*) FILTER (failed & (1 << i) <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (failed = 1 << i) AS BIGINT) AS n_failed_alone,
  CAST(count(*) FILTER (failed & (255 - (1 << i)) = 0) AS BIGINT) AS n_kept_without
FROM ledger, rules GROUP BY rule
"""

SUBSTRING_DEDUP = rf"""
WITH {_WORDS},
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM s) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, range(0, 50) t(j)),
p AS (SELECT w.doc_id, i AS p, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) w),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) AS kept, count(*) AS n FROM p ANTI JOIN gone g ON g.doc_id = p.doc_id AND g.p = p.p GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""

NGRAM_JACCARD = r"""
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i+4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)
  UNION SELECT doc_id, md5('short ' || array_to_string(w, ' ')) FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON r = a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m.r AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""

_SCORE = "-(1.0 / -ln((CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':' || s), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0))"
_CELL = "CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':cell:' || text_crc32), 1, 13) AS BIGINT) % 4096"
SHARDING = f"""
WITH bits AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), CAST(i AS BIGINT)) AS c FROM range(0, 256) r(i))),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
  xor(list_reduce(list_transform(range(0, strlen(coalesce(text, ''))), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INT), 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32
  FROM (SELECT *, hex(encode(coalesce(text, ''))) AS x FROM documents), bits),
score AS (SELECT doc_id, arg_min(s, {_SCORE}) FILTER (s < 8) AS shard, arg_min(s, {_SCORE}) AS grown FROM (SELECT DISTINCT doc_id FROM documents), range(0, 9) r(s) GROUP BY doc_id)
SELECT d.doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard, CAST(grown AS INT) AS grown_shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY {_CELL.replace("doc_id", "d.doc_id")}, d.doc_id) - 1 AS BIGINT) AS slot
FROM d JOIN score ON score.doc_id = d.doc_id
"""

ORACLES = {
    "op7_quality_rules": QUALITY_RULES,
    "op8_rendezvous_sharding": SHARDING,
    "op9_substring_dedup": SUBSTRING_DEDUP,
    "op10_ngram_jaccard_join": NGRAM_JACCARD,
    "quality_rules_ablation": ABLATION,
}
