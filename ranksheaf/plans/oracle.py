"""SQL that says the same as the shared relations, for DuckDB."""

from __future__ import annotations

STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda t: t <> '')"
SPACED = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{M}}\p{{N}}]+|\s+')"
HEX = "CAST('0x' || substr(md5({}), {}, {}) AS BIGINT)"

ARRAYS = rf"""
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches({STRIP.format('x')}, '[^_\-=. \t\n]')) AS ps FROM documents),
arrays AS (SELECT doc_id, ps, list_transform(ps, lambda p: {WORDS.format('p')}) AS ts, CAST(len(ps) AS BIGINT) AS n FROM lines WHERE len(ps) > 0),
paras AS (
  SELECT doc_id, n, pos, 'P' || pos AS para_id, ps[pos] AS text, ts[pos] AS tokens
  FROM (SELECT doc_id, n, ps, ts, unnest(generate_series(1, n)) AS pos FROM arrays))
"""

EVIDENCE = rf"""
{ARRAYS},
heard AS (SELECT *, list_filter(ts, lambda t: len(t) > 0) AS spoken FROM arrays),
chosen AS (SELECT *, spoken[doc_id % len(spoken) + 1] AS c FROM heard WHERE len(spoken) > 0),
spans AS (SELECT *, CASE WHEN len(c) > 1 THEN c[2:9] ELSE c END AS span FROM chosen),
asked AS (
  SELECT doc_id, n, ps, ts, list_filter(span, lambda t, i: i % 2 = 1) AS q, array_to_string(span, ' ') AS phrase,
         list_sum(list_transform(ts, lambda t: len(t))) / CAST(n AS DOUBLE) AS avgdl
  FROM spans),
hashed AS (SELECT *, list_transform(q, lambda t: {HEX.format('t', 1, 4)} % 64) AS qb FROM asked),
normed AS (SELECT *, list_sum(list_transform(qb, lambda x: len(list_filter(qb, lambda y: y = x)))) AS nq2 FROM hashed),
ptoks AS (SELECT doc_id, n, avgdl, q, qb, nq2, phrase, pos, ts[pos] AS toks FROM (SELECT *, unnest(generate_series(1, n)) AS pos FROM normed)),
marked AS (SELECT *, CASE WHEN contains(' ' || array_to_string(toks, ' ') || ' ', ' ' || phrase || ' ') THEN 1 ELSE 0 END AS is_gold, len(toks) AS len FROM ptoks),
occ AS (SELECT doc_id, n, avgdl, q, qb, pos, len, unnest(toks) AS tok FROM marked),
tf0 AS (SELECT doc_id, n, avgdl, q, qb, pos, len, tok, count(*) AS tf, {HEX.format('tok', 1, 4)} % 64 AS b FROM occ GROUP BY ALL),
tf1 AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, tok) AS df, row_number() OVER (PARTITION BY doc_id, tok ORDER BY pos) = 1 AS first,
         sum(tf) OVER (PARTITION BY doc_id, pos, b) AS cb FROM tf0),
tf2 AS (SELECT *, ln(n - df + 0.5) - ln(df + 0.5) AS idf0 FROM tf1),
tf3 AS (SELECT *, avg(CASE WHEN first THEN idf0 END) OVER (PARTITION BY doc_id) AS mean FROM tf2),
sums AS (
  SELECT doc_id, pos,
         sum(len(list_filter(q, lambda x: x = tok)) * CASE WHEN idf0 < 0 THEN 0.25 * mean ELSE idf0 END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) AS bm25,
         sum(tf * len(list_filter(qb, lambda x: x = b))) AS dot, sum(tf * cb) AS np2
  FROM tf3 GROUP BY doc_id, pos),
scored AS (
  SELECT m.doc_id, m.pos, m.n, m.len, m.is_gold, sum(m.is_gold) OVER (PARTITION BY m.doc_id) AS n_gold,
         round(coalesce(bm25, 0), 9) AS bm25, round(coalesce(dot / (sqrt(np2) * sqrt(nq2)), 0), 9) AS dense
  FROM marked m LEFT JOIN sums s ON m.doc_id = s.doc_id AND m.pos = s.pos),
evidence AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY bm25 DESC, pos) AS rb, row_number() OVER (PARTITION BY doc_id ORDER BY dense DESC, pos) AS rd FROM scored),
fused AS (SELECT *, round(1.0 / (60 + rb) + 1.0 / (60 + rd), 9) AS rrf FROM evidence),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rrf DESC, pos) AS rr FROM fused),
methods AS (
  SELECT 'dense' AS method, rd AS rank, doc_id, pos, n, is_gold, n_gold, dense FROM ranked
  UNION ALL SELECT 'bm25', rb, doc_id, pos, n, is_gold, n_gold, dense FROM ranked
  UNION ALL SELECT 'rrf', rr, doc_id, pos, n, is_gold, n_gold, dense FROM ranked),
hits AS (
  SELECT method, doc_id, n_gold, count(*) FILTER (is_gold = 1 AND rank <= 1) AS in1, count(*) FILTER (is_gold = 1 AND rank <= 5) AS in5,
         count(*) FILTER (is_gold = 1 AND rank <= 20) AS in20, count(*) FILTER (is_gold = 1 AND rank <= n_gold) AS ino, min(CASE WHEN is_gold = 1 THEN rank END) AS first
  FROM methods GROUP BY method, doc_id, n_gold),
metrics AS (
  SELECT method, doc_id, CAST(in1 > 0 AS DOUBLE) AS hit1, CAST(in5 > 0 AS DOUBLE) AS hit5, CAST(in20 > 0 AS DOUBLE) AS hit20,
         in5 / CAST(n_gold AS DOUBLE) AS recall5, coalesce(1.0 / first, 0) AS mrr, in1 / CAST(n_gold + 1 - in1 AS DOUBLE) AS iou1, ino / CAST(2 * n_gold - ino AS DOUBLE) AS iouok
  FROM hits),
detail AS (
  SELECT m.method AS system, m.doc_id, x.recall5 AS rouge_l, m.dense AS ss, x.iou1 AS iou
  FROM methods m JOIN metrics x ON m.method = x.method AND m.doc_id = x.doc_id WHERE m.rank = 1)
"""

VECTORS = """
vectors AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, CAST(floor(vec_id / 25) AS BIGINT) AS doc_id FROM embeddings)
"""


def over(relations: str, query: str) -> str:
    return f"WITH {relations.strip()}\n{query}"
