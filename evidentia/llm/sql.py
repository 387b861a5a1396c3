"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP9 = r"""
WITH best AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT documents.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((CAST('0x' || substr(md5(coalesce(documents.doc_id::VARCHAR, '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
           / CASE WHEN q IS NULL THEN 1.0 WHEN q >= 1 THEN 2.0 ELSE 0.5 END::DOUBLE AS k
  FROM documents LEFT JOIN best ON documents.doc_id = best.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 2 * source_size AS most, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / sum(w) OVER (ORDER BY most::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
f AS (SELECT min(most::DOUBLE / w) AS edge FROM l WHERE level * w < most),
v AS (SELECT min(level) AS level FROM l, f WHERE most::DOUBLE / w = edge AND l.level * w < most),
t AS (SELECT source, source_size, CASE WHEN l.level * w >= most AND (most::DOUBLE / w <= edge OR edge IS NULL) THEN most::DOUBLE ELSE least(v.level * w, most::DOUBLE) END AS target FROM l, f, v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
p AS (
  SELECT doc_id, size, source_size, target, epochs,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN size > 0 AND upto - size / 2::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c.low, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

OP3 = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM t),
l AS (SELECT conv_id, max(i) AS last FROM n WHERE role = 'assistant' GROUP BY conv_id),
a AS (SELECT n.conv_id, n.i AS last, n.text FROM n JOIN l ON n.conv_id = l.conv_id AND n.i = l.last),
o AS (SELECT conv_id, last, coalesce(lead(text) OVER (ORDER BY conv_id), first_value(text) OVER (ORDER BY conv_id)) AS reply FROM a),
q AS (SELECT conv_id, i, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS r, count(*) OVER (PARTITION BY conv_id) AS m FROM n WHERE role = 'assistant'),
p AS (SELECT o.conv_id AS pair_id, o.last, q.i AS fork, o.reply FROM o JOIN q ON o.conv_id = q.conv_id AND r = ((o.conv_id % m) + m) % m + 1),
k AS (SELECT pair_id, last, fork, reply, (fork - CASE WHEN n.text = reply THEN 0 ELSE 1 END)::BIGINT AS n_common FROM p JOIN n ON n.conv_id = pair_id AND n.i = fork),
s AS (SELECT pair_id, n_common, i, 'c' AS side, role, text FROM k JOIN n ON n.conv_id = pair_id AND n.i <= last
      UNION ALL SELECT pair_id, n_common, i, 'r', role, text FROM k JOIN n ON n.conv_id = pair_id AND n.i < fork
      UNION ALL SELECT pair_id, n_common, fork, 'r', 'assistant', reply FROM k),
x AS (SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line FROM s),
y AS (SELECT *, sum(CASE WHEN i > n_common THEN length(line) ELSE 0 END) OVER (PARTITION BY pair_id, side ORDER BY i)::BIGINT AS upto FROM x),
z AS (SELECT *, (upto - length(line) + length(role) + 5)::VARCHAR || ':' || (upto - 1)::VARCHAR AS span FROM y)
SELECT pair_id, any_value(n_common) AS n_common,
       coalesce(string_agg(line, '' ORDER BY i) FILTER (side = 'c' AND i <= n_common), '') AS prompt,
       coalesce(string_agg(line, '' ORDER BY i) FILTER (side = 'c' AND i > n_common), '') AS chosen,
       coalesce(string_agg(line, '' ORDER BY i) FILTER (side = 'r' AND i > n_common), '') AS rejected,
       coalesce(string_agg(span, ',' ORDER BY i) FILTER (side = 'c' AND i > n_common AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(span, ',' ORDER BY i) FILTER (side = 'r' AND i > n_common AND role = 'assistant'), '') AS rejected_mask
FROM z GROUP BY pair_id
"""

OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
o AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, m FROM g, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE i + m - 1 <= len(w)),
c AS (SELECT lang, phrase, m, count(*)::HUGEINT AS f FROM o GROUP BY ALL),
t AS (SELECT lang, sum(f)::HUGEINT AS n FROM c WHERE m = 1 GROUP BY lang),
q AS (SELECT * FROM c WHERE f >= 100),
k AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS s, unnest(range(1, m)) AS k FROM q WHERE m > 1),
x AS (
  SELECT k.lang, k.phrase, k.m, k.a, k.k, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * a * n) // (l.f * r.f) AS score
  FROM k JOIN t ON t.lang = k.lang
  JOIN q l ON l.lang = k.lang AND l.phrase = array_to_string(s[1 : k], ' ')
  JOIN q r ON r.lang = k.lang AND r.phrase = array_to_string(s[k + 1 : k.m], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
v AS (
  SELECT lang, array_to_string(s[i : i + p - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT DISTINCT lang, s, m, a FROM k), (SELECT unnest([1, 2, 3, 4]) AS i), (SELECT unnest([2, 3, 4]) AS p)
  WHERE p < m AND i + p - 1 <= m GROUP BY ALL),
z AS (SELECT b.* FROM b LEFT JOIN v ON v.lang = b.lang AND v.phrase = b.phrase WHERE most IS NULL OR 100 * most < 100 * a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z) WHERE rank <= 2000
"""

ORACLES = {"op3_preference_format": OP3, "op1_embedding_dedup": OP1, "op9_mixing": OP9, "op13_collocations": OP13}
