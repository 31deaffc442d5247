"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op3_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.i, k.line, (r.key IS NOT NULL AND k.doc_id <> r.keeper) AS gone FROM k LEFT JOIN r ON k.key = r.key),
g AS (SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM g
"""

ORACLES["op9_mixing"] = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS ord FROM d GROUP BY source),
w AS (SELECT *, CASE ord % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
a AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight FROM w),
b AS (SELECT *, coalesce(sum(source_size) OVER o, 0) AS sized, coalesce(sum(weight) OVER o, 0) AS weighed FROM a
      WINDOW o AS (ORDER BY ratio, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (1.5::DOUBLE * total - 2.0::DOUBLE * sized) / (all_weight - weighed) AS level FROM b),
f AS (SELECT level AS final FROM c WHERE level < ratio ORDER BY ratio, ord LIMIT 1),
t AS (SELECT source, source_size,
        CASE WHEN (SELECT count(*) FROM f) = 0 THEN 2.0::DOUBLE * source_size
             ELSE least(2.0::DOUBLE * source_size, (SELECT final FROM f) * weight) END::DOUBLE AS target,
        ('0x' || substr(md5('mix:' || coalesce(source, '') || CASE WHEN source IS NULL THEN '0' ELSE '1' END), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off FROM c),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.off,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS each,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor((k + 1) * each + off) - floor(k * each + off)) * size)::BIGINT AS taken FROM r
"""

ORACLES["op5_topk"] = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM c q JOIN c ON q.i = c.i AND q.vec_id <> c.vec_id
      WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id, c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLES["op7_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, upper(sha1(h)) AS x FROM p),
f AS (SELECT x, min(page_id) AS first FROM s GROUP BY x),
d AS (SELECT x, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(x, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS b32 FROM f)
SELECT s.page_id, s.payload_bytes, d.b32 AS payload_digest,
       CASE WHEN s.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN s.page_id = f.first THEN NULL ELSE f.first END AS refers_to
FROM s JOIN f ON s.x = f.x JOIN d ON s.x = d.x
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op8_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS t FROM bw),
lens AS (SELECT DISTINCT n FROM win),
dl AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n),
dg AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS t FROM dl),
hit AS (SELECT doc_id, item_id, s, dg.n AS n FROM dg JOIN win ON dg.n = win.n AND dg.t = win.t),
pos AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hit),
nh AS (SELECT doc_id, count(*)::BIGINT AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS items
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w)) AS contaminated
FROM d LEFT JOIN nh ON d.doc_id = nh.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

ORACLES["op4_jaccard"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM e),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * p.c >= 90 * (x.n + y.n - p.c)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON r.node = u.a),
m AS (SELECT node, min(root) AS component FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component, d.doc_id)::BIGINT AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.node
"""

ORACLES["op6_substring"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 49 + 1)) AS s FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) AS h FROM i),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
p AS (SELECT DISTINCT g.doc_id, unnest(range(g.s, g.s + 50)) AS i FROM g JOIN f ON g.h = f.h WHERE f.first < g.doc_id),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT u.doc_id, count(p.i)::BIGINT AS n_removed, string_agg(u.x, ' ' ORDER BY u.i) FILTER (WHERE p.i IS NULL) AS kept
      FROM u LEFT JOIN p ON u.doc_id = p.doc_id AND u.i = p.i GROUP BY u.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
