"""DuckDB SQL for the queries that SQL can express."""

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g FROM d
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents
), i AS (SELECT item_id, {WORDS.format("coalesce(text, '')")} AS w FROM benchmark
), v AS MATERIALIZED (
  SELECT DISTINCT item_id, g, len(g) AS n FROM (SELECT item_id, w[p:p + 9] AS g FROM
    (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0))
), h AS MATERIALIZED (
  SELECT doc_id, p, v.n, v.item_id FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
    FROM d, (SELECT DISTINCT n FROM v) l WHERE len(w) >= n) x JOIN v ON v.n = x.n AND v.g = x.w[p:p + x.n - 1]
), c AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP1 = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS MATERIALIZED (
  SELECT doc_id, i, w[i] AS v, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS b, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS t,
    CASE WHEN i > 1 THEN w[i - 1] END AS u, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] END AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), n AS (SELECT count(*) AS n FROM t
), m AS (SELECT doc_id, count(*) AS m FROM t GROUP BY doc_id
), o AS MATERIALIZED (
  SELECT doc_id, v AS g, count(*) AS own FROM t GROUP BY ALL
  UNION ALL SELECT doc_id, b, count(*) FROM t WHERE b IS NOT NULL GROUP BY ALL
  UNION ALL SELECT doc_id, t, count(*) FROM t WHERE t IS NOT NULL GROUP BY ALL
), e AS MATERIALIZED (SELECT doc_id, g, (sum(own) OVER (PARTITION BY g) - own)::BIGINT AS x FROM o
), s AS (
  SELECT t.doc_id, t.i, n.n - m.m AS size, e1.x AS one, e2.x AS two, e3.x AS three, p1.x AS before1, p2.x AS before2
  FROM t CROSS JOIN n JOIN m USING (doc_id) JOIN e e1 ON e1.doc_id = t.doc_id AND e1.g = t.v
  LEFT JOIN e e2 ON e2.doc_id = t.doc_id AND e2.g = t.b LEFT JOIN e e3 ON e3.doc_id = t.doc_id AND e3.g = t.t
  LEFT JOIN e p1 ON p1.doc_id = t.doc_id AND p1.g = t.u LEFT JOIN e p2 ON p2.doc_id = t.doc_id AND p2.g = t.c
), q AS (
  SELECT *, CASE WHEN one > 0 THEN one / greatest(size, 1)::DOUBLE ELSE 0.4::DOUBLE / (size + 1) END AS q1 FROM s
), r AS (
  SELECT *, CASE WHEN i = 1 THEN q1 WHEN two > 0 THEN two / greatest(before1, 1)::DOUBLE ELSE 0.4::DOUBLE * q1 END AS q2 FROM q
), a AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (three > 0) AS n_full,
    count(*) FILTER (one = 0 AND coalesce(two, 0) = 0 AND coalesce(three, 0) = 0) AS n_unseen,
    sum(ln(CASE WHEN i <= 2 THEN q2 WHEN three > 0 THEN three / greatest(before2, 1)::DOUBLE ELSE 0.4::DOUBLE * q2 END)) AS log_prob FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_full, 0)::BIGINT AS n_full, coalesce(n_unseen, 0)::BIGINT AS n_unseen,
  round(coalesce(log_prob, 0), 3) AS log_prob, round(log_prob / n_words, 4) AS score
FROM d LEFT JOIN a USING (doc_id)
"""

OP7 = rf"""
WITH p AS (
  SELECT page_id, url, {LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), r(h, p, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), f AS (
  SELECT page_id, url, host, path, regexp_replace(host, '^www\.', '') || regexp_replace(path, '(\.html|/)$', '') AS exact,
    (SELECT max(struct_pack(n := len(r.h || r.p), h := len(r.h), rule := r.h || r.p, verdict := r.verdict)) FROM r
     WHERE (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)) AS best FROM p
), l AS (SELECT DISTINCT exact FROM f WHERE ('0x' || substr(sha256(url), 1, 8))::BIGINT % 20 = 0)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN l.exact IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  l.exact IS NOT NULL AS listed
FROM f LEFT JOIN l USING (exact)
"""

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT d, min(page_id) AS original FROM p WHERE strlen(h) >= 100 GROUP BY d)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""

OP3 = r"""
WITH RECURSIVE a AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
), t AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) + 4 AS tokens,
    13 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11 AS chars FROM a
), s AS MATERIALIZED (
  SELECT conv_id, i, n, tokens, chars, sum(tokens) OVER w AS hi, sum(tokens) OVER w - tokens AS lo, sum(chars) OVER w AS chi, sum(chars) OVER w - chars AS clo
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), y AS MATERIALIZED (
  SELECT conv_id, max(CASE WHEN i = 0 AND role = 'system' THEN 1 ELSE 0 END) AS sys, max(CASE WHEN i = 0 THEN tokens END) AS stok, max(CASE WHEN i = 0 THEN chars END) AS schars FROM t GROUP BY conv_id
), b AS MATERIALIZED (
  SELECT conv_id, first, min(CASE WHEN back < first AND kept + fhi - blo > 512 THEN NULL ELSE back END) AS back FROM (
    SELECT f.conv_id, f.i AS first, k.i AS back, f.hi AS fhi, k.lo AS blo, CASE WHEN y.sys = 1 AND f.i > 0 THEN y.stok ELSE 0 END AS kept
    FROM s f JOIN y USING (conv_id) JOIN s k ON k.conv_id = f.conv_id AND k.i <= f.i AND (k.i = f.i OR (k.i >= y.sys AND f.lo - k.lo <= 128))
  ) GROUP BY ALL
), l AS MATERIALIZED (
  SELECT b.conv_id, b.first, b.back, max(e.i) + 1 AS last,
    max(e.chi) - any_value(k.clo) + any_value(CASE WHEN y.sys = 1 AND b.first > 0 THEN y.schars ELSE 0 END) AS chars
  FROM b JOIN y USING (conv_id) JOIN s k ON k.conv_id = b.conv_id AND k.i = b.back
  JOIN s e ON e.conv_id = b.conv_id AND e.i >= b.first AND (e.i = b.first OR (CASE WHEN y.sys = 1 AND b.first > 0 THEN y.stok ELSE 0 END) + e.hi - k.lo <= 512)
  GROUP BY b.conv_id, b.first, b.back
), r AS (
  SELECT conv_id, first, last, chars FROM l WHERE first = 0
  UNION ALL SELECT l.conv_id, l.first, l.last, l.chars FROM r JOIN l ON l.conv_id = r.conv_id AND l.first = r.last
), f AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars, count(*) AS n_windows FROM r GROUP BY conv_id
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS turns,
    string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY i) AS loss FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, n_windows
FROM g JOIN f USING (conv_id)
"""

TERMS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {TERMS.format("coalesce(text, '')")} AS w FROM documents
), i AS MATERIALIZED (
  SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest({TERMS.format("coalesce(text, '')")}) AS t FROM benchmark) GROUP BY ALL
), f AS MATERIALIZED (
  SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL
), c AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS terms FROM d
), v AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, c GROUP BY t
), s AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM i JOIN f USING (t) JOIN v USING (t), c GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""


def _rounds(n: int) -> str:
    """Each round's assignment and centroids as tables of their own, since an aggregate may not recur."""
    near = "SELECT v.vec_id, v.q, min_by(c.k, (list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.k)) AS k FROM v, c{0} c GROUP BY v.vec_id, v.q"
    each = f"""a{{0}} AS MATERIALIZED ({near}
), c{{1}} AS MATERIALIZED (
  SELECT c.k, coalesce(m.q, c.q) AS q FROM c{{0}} c LEFT JOIN (
    SELECT k, list(s ORDER BY j) AS q FROM (
      SELECT k, j, floor_div(sum(x), count(*)) AS s FROM (SELECT k, unnest(range(1, 65)) AS j, unnest(q) AS x FROM a{{0}}) GROUP BY k, j) GROUP BY k) m USING (k)
), """
    return "".join(each.format(i, i + 1) for i in range(n)) + f"z AS MATERIALIZED ({near.format(n)})"


OP13 = rf"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, q FROM (SELECT q, sha256('3:' || vec_id) AS h FROM v ORDER BY h LIMIT 8)
), {_rounds(10).replace("floor_div(sum(x), count(*))", "((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*))::BIGINT")},
o AS (SELECT z.vec_id, z.k, c.q AS center, list_sum(list_transform(list_zip(z.q, c.q), lambda y: (y[1] - y[2]) * (y[1] - y[2])))::BIGINT AS far FROM z JOIN c10 c USING (k))
SELECT vec_id, k::INTEGER AS cluster, far AS distance, (sum(far) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(far) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(center, ',')) AS centroid_sha256 FROM o
"""

OP11 = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM d
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
