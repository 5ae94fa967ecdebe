"""SQL that the registered queries of this subpackage are checked against."""

from __future__ import annotations

OP4 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(id, c) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id
), parts AS (SELECT id, min(c) AS c FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c, vec_id) AS component_id,
  vec_id IS NOT DISTINCT FROM coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN parts ON parts.id = vec_id
"""

OP6 = """
WITH turns AS (
  SELECT conv_id, replace(coalesce(role, ''), '<|', '< |') AS s,
    replace(coalesce(text, ''), '<|', '< |') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      replace(coalesce(role, ''), '<|', '< |'), replace(coalesce(text, ''), '<|', '< |')) - 1 AS rank
  FROM conversations
), people AS (
  SELECT DISTINCT conv_id, s AS perspective FROM turns WHERE s <> 'system'
), said AS (
  SELECT t.conv_id, perspective, rank, rank // 64 AS part, s = perspective AS own,
    CASE WHEN s = 'system' THEN '<|system|>' WHEN s = perspective THEN '<|assistant|>'
      ELSE '<|user:' || s || '|>' END || chr(10) AS head, x || '<|end|>' AS body
  FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective
    ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM said
), parts AS (
  SELECT conv_id, perspective, part, count(*) AS n_turns,
    count(*) FILTER (own) AS n_own, min(pos) AS start,
    string_agg(head || body || chr(10), '' ORDER BY rank) AS rendered,
    list(pos + length(head) ORDER BY rank) FILTER (own) AS a,
    list(pos + length(head) + length(body) ORDER BY rank) FILTER (own) AS b
  FROM placed GROUP BY 1, 2, 3
)
SELECT conv_id, perspective, part::INTEGER AS part, n_turns::INTEGER AS n_turns,
  n_own::INTEGER AS n_own, start::BIGINT AS start, rendered,
  coalesce(array_to_string(list_transform(a, lambda v: (v - start)::VARCHAR), ','), '') AS mask_starts,
  coalesce(array_to_string(list_transform(b, lambda v: (v - start)::VARCHAR), ','), '') AS mask_ends
FROM parts
"""

OP8 = r"""
WITH docs AS (
  SELECT doc_id, lang, source, CASE WHEN source IN ('src0','src1','src2','src3','src4')
      THEN 'crawl' ELSE 'curated' END AS domain,
    coalesce(lang, '') AS l, coalesce(source, '') AS s,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS tokens
  FROM documents
), leaves AS (
  SELECT domain, l, s, sum(tokens)::HUGEINT AS tokens, (sum(tokens) * 2)::HUGEINT AS cap,
    CASE domain WHEN 'crawl' THEN 3 ELSE 7 END AS wd,
    CASE l WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS wl
  FROM docs GROUP BY ALL
), d0 AS (
  SELECT domain, sum(cap)::HUGEINT AS cap, max(wd)::HUGEINT AS w,
    (SELECT (sum(tokens) * 4 // 5)::HUGEINT FROM leaves) AS budget
  FROM leaves GROUP BY 1
), d1 AS (
  SELECT *, budget - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w::DOUBLE, domain
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS rem,
    (sum(w) OVER (ORDER BY cap::DOUBLE / w::DOUBLE, domain
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS wr
  FROM d0
), d2 AS (
  SELECT a.domain, CASE WHEN a.cap * a.wr <= a.rem * a.w THEN a.cap
    ELSE least(a.cap, (a.w * b.rem) // b.wr) END AS budget
  FROM d1 a LEFT JOIN (SELECT rem, wr FROM d1 WHERE NOT cap * wr <= rem * w
    ORDER BY cap::DOUBLE / w::DOUBLE, domain LIMIT 1) b ON true
), l0 AS (
  SELECT domain, l, sum(cap)::HUGEINT AS cap, max(wl)::HUGEINT AS w, any_value(budget) AS budget
  FROM leaves JOIN d2 USING (domain) GROUP BY 1, 2
), l1 AS (
  SELECT *, budget - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap::DOUBLE / w::DOUBLE, l
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS rem,
    (sum(w) OVER (PARTITION BY domain ORDER BY cap::DOUBLE / w::DOUBLE, l
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS wr
  FROM l0
), l2 AS (
  SELECT a.domain, a.l, CASE WHEN a.cap * a.wr <= a.rem * a.w THEN a.cap
    ELSE least(a.cap, (a.w * b.rem) // b.wr) END AS budget
  FROM l1 a LEFT JOIN (SELECT DISTINCT ON (domain) domain, rem, wr FROM l1
    WHERE NOT cap * wr <= rem * w ORDER BY domain, cap::DOUBLE / w::DOUBLE, l) b USING (domain)
), s0 AS (
  SELECT domain, l, s, tokens, cap, 1::HUGEINT AS w, budget
  FROM leaves JOIN l2 USING (domain, l)
), s1 AS (
  SELECT *, budget - coalesce(sum(cap) OVER (PARTITION BY domain, l ORDER BY cap::DOUBLE, s
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS rem,
    (sum(w) OVER (PARTITION BY domain, l ORDER BY cap::DOUBLE, s
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS wr
  FROM s0
), s2 AS (
  SELECT a.domain, a.l, a.s, a.tokens, CASE WHEN a.cap * a.wr <= a.rem * a.w THEN a.cap
    ELSE least(a.cap, (a.w * b.rem) // b.wr) END AS budget
  FROM s1 a LEFT JOIN (SELECT DISTINCT ON (domain, l) domain, l, rem, wr FROM s1
    WHERE NOT cap * wr <= rem * w ORDER BY domain, l, cap::DOUBLE, s) b USING (domain, l)
), plan AS (
  SELECT domain, l, s, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole,
    CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM s2
), placed AS (
  SELECT d.*, p.whole, p.rest, sum(d.tokens) OVER (PARTITION BY d.domain, d.l, d.s
    ORDER BY md5('17|' || (p.whole + 1)::VARCHAR || '|' || coalesce(d.doc_id::VARCHAR, ''))) AS done
  FROM docs d JOIN plan p USING (domain, l, s)
), taken AS (
  SELECT *, (whole + CASE WHEN rest > 0 AND done <= rest THEN 1 ELSE 0 END)::BIGINT AS times
  FROM placed
)
SELECT doc_id, domain, lang, source, epoch::INTEGER AS epoch, tokens
FROM (SELECT *, unnest(range(1, times + 1)) AS epoch FROM taken)
"""

OP9 = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept,
  sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""

OP10 = r"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), parts AS (
  SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0
    THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages
), urls AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), best AS (
  SELECT u.host, u.path, arg_max(r_host || r_path, length(r_host) * 100000 + length(r_path)) AS rule,
    arg_max(r_verdict, length(r_host) * 100000 + length(r_path)) AS r_verdict
  FROM (SELECT DISTINCT host, path FROM urls) u JOIN rules
    ON (u.host = r_host OR ends_with(u.host, '.' || r_host)) AND starts_with(u.path, r_path)
  GROUP BY 1, 2
)
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM urls LEFT JOIN best USING (host, path)
"""

OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), met AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM met WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id,
  positive_score, score AS negative_score
FROM positives JOIN met USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""

OP13 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), drawn AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4
  FROM d
), cut AS (
  SELECT doc_id, t, n, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a,
    CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
      THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1, n - b) AS s FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

ORACLES = {
    "op4_vector_dedup": OP4,
    "op6_chat_formatting": OP6,
    "op8_mix_sources": OP8,
    "op9_exact_dedup": OP9,
    "op10_url_filters": OP10,
    "op11_hard_negatives": OP11,
    "op13_fill_in_middle": OP13,
}
