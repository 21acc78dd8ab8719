"""Oracle SQL (DuckDB) of the training-data queries that SQL can express."""

from __future__ import annotations

from loomwright.llm.mixing import MOST, SHARE, WEIGHTS
from loomwright.llm.perspective import CLOSE, END, OPEN, SEGMENT
from loomwright.llm.quality_rules import DELTA, GRID, RISK, RULES

SPACES = r"[\x20\x09-\x0D]"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Counts of words, lines and repeated three-word windows; windows are compared as lists of words.
COUNTS = rf"""
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
g AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
c AS MATERIALIZED (SELECT doc_id, lang, t, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(regexp_extract_all(t, '[A-Z]')) AS BIGINT) AS n_capitals,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d) LEFT JOIN rep USING (r)),
b AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"1000 * {a} // greatest({n}, 1) AS m_{r}" for r, (a, n) in RULES.items())} FROM c)"""

RULE_TESTS = " UNION ALL ".join(f"SELECT lang, '{r}' AS rule, m_{r} AS m FROM h" for r in RULES)

RATE = RISK / len(RULES)
OP1 = f"""WITH {COUNTS},
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
h AS (SELECT DISTINCT b.* EXCLUDE (doc_id) FROM b SEMI JOIN good USING (doc_id) WHERE NOT base_failed),
k AS (SELECT lang, rule, cutoff, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (m > cutoff) AS BIGINT) AS k FROM ({RULE_TESTS}), (SELECT unnest({list(GRID)}) AS cutoff) GROUP BY ALL),
p AS (SELECT *, CASE WHEN k < n * {RATE} THEN list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RATE}) + (n - i) * ln(1 - {RATE})))) ELSE 1 END AS tail FROM k),
f AS (SELECT *, max(CASE WHEN tail > {DELTA} / ((SELECT count(DISTINCT coalesce(lang, chr(1))) FROM h) * {len(RULES)}) THEN 1 ELSE 0 END) OVER (PARTITION BY lang, rule ORDER BY cutoff DESC) AS failed FROM p),
cut AS (SELECT lang AS stratum, {", ".join(f"min(cutoff) FILTER (rule = '{r}' AND failed = 0) AS c_{r}" for r in RULES)} FROM f GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(f"coalesce(m_{r} <= c_{r}, true)" for r in RULES)} AS kept FROM b LEFT JOIN cut ON lang IS NOT DISTINCT FROM stratum"""

OP7 = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x) AS score FROM v q, v WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 20"""

OP10 = rf"""WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '{OPEN}', '<\|') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS place FROM conversations),
s AS (SELECT *, CAST(place // {SEGMENT} AS BIGINT) AS segment, replace(replace(speaker, '{OPEN}', '<\|'), '{CLOSE}', '|\>') AS name FROM t),
who AS (SELECT DISTINCT conv_id, speaker AS me FROM s WHERE speaker <> 'system'),
p AS (SELECT s.conv_id, s.segment, me, place, speaker = me AS own, CASE WHEN speaker = me THEN '{OPEN}assistant{CLOSE}' WHEN speaker = 'system' THEN '{OPEN}system{CLOSE}' ELSE '{OPEN}user:' || name || '{CLOSE}' END AS head, text || '{END}' AS body FROM who JOIN s ON s.conv_id IS NOT DISTINCT FROM who.conv_id),
o AS (SELECT *, sum(len(head) + len(body)) OVER (PARTITION BY conv_id, segment, me ORDER BY place) AS until FROM p)
SELECT conv_id, segment, me AS speaker, count(*) AS n_turns, string_agg(head || body, '' ORDER BY place) AS rendered, coalesce(string_agg(CAST(until - len(body) AS BIGINT) || '-' || CAST(until AS BIGINT), ',' ORDER BY place) FILTER (own), '') AS masks, coalesce(CAST(sum(len(body)) FILTER (own) AS BIGINT), 0) AS n_trained FROM o GROUP BY conv_id, segment, me"""

#: Of op6, SQL expresses sizes and targets; the draws are tested against their bounds in tests/llm.
TARGETS = f"""WITH s AS (SELECT source, CAST(sum(len({WORDS})) AS BIGINT) AS source_size FROM documents GROUP BY source),
w AS (SELECT *, CAST({list(map(float, WEIGHTS))}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight FROM s),
l AS (SELECT *, ({SHARE} * (SELECT sum(source_size) FROM s) - coalesce(sum({MOST} * source_size) OVER b, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0)) AS level FROM w WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT source, source_size, least({MOST} * source_size, weight * (SELECT min_by(level, source_size / weight) FROM l WHERE level <= {MOST} * source_size / weight)) AS target FROM l"""

ORACLE: dict[str, str] = {"op1_quality_rules": OP1, "op7_nearest": OP7, "op10_perspectives": OP10}
