"""DuckDB SQL with the same rows as the registered queries, straight from each definition."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
SPACED = r"[^\x20\x09-\x0D]+"


def near_dedup(source: str = "documents", threshold: int = 85, k: int = 5) -> str:
    return rf"""
WITH RECURSIVE src AS (SELECT doc_id, regexp_extract_all({FOLDED}, '{SPACED}') AS ws FROM {source}),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {k} THEN list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i + {k - 1}], ' '))
                                        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM src),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= {threshold} * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS x, a AS y FROM both_ways UNION SELECT r.x, e.b FROM reach r JOIN both_ways e ON e.a = r.y),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT s.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, s.doc_id) AS component_id, s.doc_id = coalesce(c, s.doc_id) AS kept
FROM src s LEFT JOIN sizes USING (doc_id) LEFT JOIN comp ON comp.x = s.doc_id"""


#: Base 32 of a SHA-1: every five hex digits are four symbols.
BASE32 = "list_reduce(list_transform(range(0, 40, 5), lambda i: list_reduce(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, i + 1, 5))::BIGINT >> b) & 31) + 1)::BIGINT, 1)), lambda a, c: a || c)), lambda a, c: a || c)"

WARC = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS x, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, n::BIGINT AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
q AS (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, coalesce(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * v.x[i])), 0)::BIGINT AS score
      FROM q JOIN v ON q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

CHAT = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, list({'role': role, 'text': text} ORDER BY pos) AS turns,
             string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY pos) AS rendered FROM t GROUP BY conv_id),
g AS (SELECT turns::VARCHAR AS key, any_value(turns) AS turns, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(n) AS n_turns FROM c GROUP BY turns::VARCHAR),
p AS (SELECT DISTINCT unnest(list_transform(range(1, len(turns)), lambda i: turns[1:i]::VARCHAR)) AS key FROM c)
SELECT g.conv_id, g.n_turns, g.n_copies, c.rendered FROM g JOIN c USING (conv_id) WHERE g.key NOT IN (SELECT key FROM p)"""


def decontaminate(source: str = "documents", k: int = 10) -> str:
    words = rf"regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (SELECT doc_id, {words} AS ws FROM {source}),
i AS (SELECT item_id::VARCHAR AS item_id, {words} AS ws FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda j: array_to_string(ws[j:j + n - 1], ' '))) AS g
      FROM (SELECT *, least({k}, len(ws)) AS n FROM i) WHERE n > 0),
sizes AS (SELECT DISTINCT n FROM w),
dw AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS pos, unnest(list_transform(range(1, len(ws) - n + 2), lambda j: array_to_string(ws[j:j + n - 1], ' '))) AS g
       FROM d, sizes WHERE len(ws) >= n),
hits AS (SELECT doc_id, pos, dw.n, item_id FROM dw JOIN w ON dw.g = w.g AND dw.n = w.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM (SELECT DISTINCT doc_id, pos, n FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""


def substring_dedup(source: str = "documents", k: int = 13) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS ws FROM {source}),
w AS (SELECT r, doc_id, unnest(range(1, len(ws) - {k - 2})) AS pos, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda j: md5(array_to_string(ws[j:j + {k - 1}], ' ')))) AS g FROM d WHERE len(ws) >= {k}),
f AS (SELECT g, min(doc_id) AS lo FROM w GROUP BY g),
gone AS (SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(pos, pos + {k})) AS p FROM w JOIN f USING (g) WHERE lo < doc_id) GROUP BY r),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS kept FROM (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM d) u
         WHERE NOT EXISTS (SELECT 1 FROM (SELECT r, unnest(ps) AS p FROM gone) q WHERE q.r = u.r AND q.p = u.p) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)"""


def _draw(seed: str, group: int) -> str:
    """The ``group``-th 8 hex digits of sha256(``seed:doc_id``) as an unsigned integer."""
    return f"('0x' || substr(sha256('{seed}:' || doc_id::VARCHAR), {8 * group - 7}, 8))::BIGINT"


def resampling(source: str = "documents", target: str = "benchmark", seed: str = "7", buckets: int = 10_000) -> str:
    words = rf"regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    grams = "list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))"
    return rf"""
WITH RECURSIVE low AS (SELECT b::BIGINT AS b, b::BIGINT AS r, 0 AS step FROM range(256) t(b)
                       UNION ALL SELECT b, xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END), step + 1 FROM low WHERE step < 8),
tab AS MATERIALIZED (SELECT list(r ORDER BY b) AS t FROM low WHERE step = 8),
d AS (SELECT row_number() OVER () AS k, doc_id, {words} AS ws FROM {source}),
e AS (SELECT {words} AS ws FROM {target}),
f AS (SELECT k, unnest({grams}) AS g FROM d),
g AS (SELECT unnest({grams}) AS g FROM e),
names AS (SELECT DISTINCT g FROM (SELECT g FROM f UNION ALL SELECT g FROM g)),
bytes AS (SELECT g, list_transform(range(0, octet_length(encode(g))::BIGINT), lambda i: ('0x' || substr(hex(encode(g)), (2 * i + 1)::BIGINT, 2))::BIGINT) AS bs FROM names),
hashed AS (SELECT g, xor(list_reduce(list_prepend(4294967295, bs), lambda c, x: xor(t[xor(c & 255, x) + 1], c >> 8)), 4294967295) % {buckets} AS b FROM bytes, tab),
s AS (SELECT b, count(*) AS n FROM f JOIN hashed USING (g) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM g JOIN hashed USING (g) GROUP BY b),
sums AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s_all, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS t_all),
gain AS (SELECT b, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (s_all + {buckets}) / ((s.n::DOUBLE + 1) * (t_all + {buckets}))))::BIGINT AS gain FROM s LEFT JOIN t USING (b), sums),
w AS (SELECT k, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN hashed USING (g) JOIN gain USING (b) GROUP BY k),
r AS (SELECT k, doc_id, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, {_draw(seed, 1)} AS h FROM d LEFT JOIN w USING (k)),
z AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296::DOUBLE))))::BIGINT AS score, n_words >= 20 AND doc_id IS NOT NULL AS open FROM r),
o AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank, 25 * count(*) OVER () // 100 AS drawn FROM z WHERE open)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM z LEFT JOIN o USING (k)"""


FILL_IN_MIDDLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, {_draw("1", 1)} AS h1, {_draw("1", 2)} AS h2, {_draw("1", 3)} AS h3, {_draw("1", 4)} AS h4 FROM documents),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN doc_id IS NULL OR t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""
