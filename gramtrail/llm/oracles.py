"""DuckDB SQL for the queries of this folder that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op5_decontaminate"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT cast(item_id AS varchar) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT r, i, dw.k, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.s = iw.s),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

ORACLES["op4_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x AS double)) AS bigint)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) AS bigint) AS score
  FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS integer) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLES["op1_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 3], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
k AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS cnt FROM sh AS a JOIN sh AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM k JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * cnt >= 85 * (x.n + y.n - cnt)),
r AS (SELECT a AS doc_id, b AS seen FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen)
SELECT d.doc_id, cast(coalesce(n.n, 0) AS bigint) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(seen) AS m FROM r GROUP BY doc_id) AS m USING (doc_id)
"""


def _crc32(id_: str) -> str:
    """Unsigned crc32 of a number as decimal text, bit by bit."""
    s = f"cast({id_} AS varchar)"
    bits = "list_reduce([xor(c & 255, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::bigint) ELSE v >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({s}) + 1), lambda k: ascii(substr({s}, k, 1))::bigint)), lambda c, b: xor(c >> 8, {bits})), 4294967295::bigint)"


ORACLES["op11_conversation_trie"] = rf"""
WITH r AS MATERIALIZED (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS MATERIALIZED (SELECT c, n, {_crc32("c")} % 4 AS h, c - c % 20 AS b FROM (SELECT c, count(*) AS n FROM r GROUP BY c)),
l AS MATERIALIZED (SELECT k.c, k.b, k.h, least(k.h, coalesce(z.n, 0)) AS lead FROM k LEFT JOIN k AS z ON z.c = k.b),
s AS (SELECT l.c, p AS d, role, text FROM l JOIN r ON r.c = l.b AND p <= h UNION ALL SELECT l.c, lead + p - h, role, text FROM l JOIN r ON r.c = l.c AND p > h),
x AS MATERIALIZED (SELECT c, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY c ORDER BY d) AS key FROM s
  UNION ALL SELECT c, 0, 0, '' FROM k),
v AS MATERIALIZED (SELECT d, key, min(c) AS o, count(*) AS n, max(w) AS w FROM x GROUP BY d, key),
a AS MATERIALIZED (SELECT v.d, v.key, v.o, p.key AS parent FROM v JOIN x AS p ON p.c = v.o AND p.d = v.d - 1),
q AS MATERIALIZED (SELECT d - 1 AS d, parent AS key, count(*) AS n_children FROM a GROUP BY 1, 2),
t AS (SELECT u.d, u.key, sum((n_children IS NULL)::int) AS n_leaves, sum((v.n - 1) * v.w) AS saved FROM v LEFT JOIN q USING (d, key) JOIN x AS u ON u.c = v.o AND u.d <= v.d GROUP BY 1, 2),
e AS (SELECT d, key, string_agg(cast(c AS varchar), ',' ORDER BY c) AS ids FROM (SELECT c, max(d) AS d FROM x GROUP BY c) JOIN x USING (c, d) GROUP BY 1, 2)
SELECT v.o AS conv_id, cast(v.d AS bigint) AS depth, y.o AS parent_conv_id, v.n AS n_convs, cast(coalesce(n_children, 0) AS bigint) AS n_children, cast(n_leaves AS bigint) AS n_leaves, cast(saved AS bigint) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM v JOIN t USING (d, key) LEFT JOIN q USING (d, key) LEFT JOIN e USING (d, key) LEFT JOIN a USING (d, key) LEFT JOIN v AS y ON y.d = a.d - 1 AND y.key = a.parent
"""

ORACLES["op12_periodic_runs"] = rf"""
WITH d0 AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, {_crc32("doc_id")} AS h FROM documents),
d1 AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM d0),
d AS MATERIALIZED (SELECT doc_id, r, n, CASE WHEN a < n THEN list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE w END AS w FROM d1),
t AS MATERIALIZED (SELECT r, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
p AS (SELECT a.r, b.i - a.i AS q, a.i FROM t AS a JOIN t AS b ON a.r = b.r AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
s AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS z FROM p),
c AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY r, q, z HAVING count(*) + q >= greatest(6, 4 * q)),
u AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM c GROUP BY r, start, length),
b AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) AS k, count(*) OVER (PARTITION BY r) AS n_runs FROM u),
l AS (SELECT r, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS x FROM u GROUP BY r),
o AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u),
f AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS x FROM t ANTI JOIN o USING (r, i) GROUP BY r)
SELECT doc_id, cast(coalesce(n_runs, 0) AS bigint) AS n_runs, cast(start AS bigint) AS start, cast(length AS bigint) AS length, cast(period AS bigint) AS period, cast(1000 * length // period AS bigint) AS exponent_milli,
  sha256(coalesce(l.x, '')) AS runs_sha256, sha256(coalesce(f.x, '')) AS collapsed_sha256
FROM d LEFT JOIN (SELECT * FROM b WHERE k = 1) AS b USING (r) LEFT JOIN l USING (r) LEFT JOIN f USING (r)
"""
