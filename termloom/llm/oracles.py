"""DuckDB SQL for the operators that SQL can express: the same rows by plain joins over all rows."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EMBEDDINGS = """WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.vec_id = l.a),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT m.vec_id, coalesce(n_links, 0) AS n_links, component_id, m.vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)"""

JACCARD = f"""WITH RECURSIVE w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT r, doc_id, count(*) AS n FROM s GROUP BY r, doc_id),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p JOIN n x ON p.a = x.r JOIN n y ON p.b = y.r WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON r.doc_id = l.a),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (r) LEFT JOIN m ON w.doc_id = m.doc_id"""

REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM w) WHERE c > 1),
edges AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM again),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges) GROUP BY doc_id, run),
parts AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM runs),
gone AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS last FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS k FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def rounds(n: int) -> str:
    """Each round assigns all vectors to the centroids of the last one and moves these."""
    near = lambda i: f"n{i} AS MATERIALIZED (SELECT r, arg_min(c, d * 1000 + c) AS c, min(d) AS d FROM (SELECT v.r, k.c, sum((v.x - k.x) * (v.x - k.x))::BIGINT AS d FROM v JOIN k{i} k USING (i) GROUP BY v.r, k.c) GROUP BY r)"
    move = lambda i: f"k{i + 1} AS MATERIALIZED (SELECT k.c, k.i, coalesce(m.x, k.x) AS x FROM k{i} k LEFT JOIN (SELECT n.c, v.i, ((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM n{i} n JOIN v USING (r) GROUP BY n.c, v.i) m ON k.c = m.c AND k.i = m.i)"
    return ",\n".join(x for i in range(n) for x in (near(i), move(i))) + ",\n" + near(n)


CENTROIDS = f"""WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(x) AS x FROM e),
s AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c FROM e),
k0 AS MATERIALIZED (SELECT c, i, x FROM s JOIN v USING (r) WHERE c < 16),
{rounds(3)},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM k3 GROUP BY c),
f AS (SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia FROM n3 JOIN e USING (r))
SELECT f.*, centroid_sha256 FROM f JOIN h ON f.cluster = h.c"""

LEAF = lambda n: "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n, "text")) + ")"
#: crc32 of a text: a table of 256 remainders, then byte by byte.
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"
MERKLE = f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, {LEAF("n_chars")} AS leaf, CASE WHEN {CRC} % 7 = 0 AND n_chars IS NOT NULL THEN {LEAF("(n_chars + 1)")} ELSE {LEAF("n_chars")} END AS changed FROM documents, crc),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS m, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM d),
n(g, l, p, h, m) AS (SELECT g, 0, p, leaf, m FROM o UNION ALL SELECT g, l + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), any_value((m + 1) // 2) FROM n WHERE m > 1 GROUP BY g, l, p // 2),
nodes AS MATERIALIZED (SELECT * FROM n),
top AS MATERIALIZED (SELECT g, l AS top, h AS subroot, count(*) OVER () AS m FROM nodes WHERE m = 1),
u(l, p, h, m) AS (SELECT 0, g, subroot, m FROM top UNION ALL SELECT l + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), any_value((m + 1) // 2) FROM u WHERE m > 1 GROUP BY l, p // 2),
whole AS MATERIALIZED (SELECT * FROM u),
w(r, g, l, p, s, f, up) AS (SELECT r, g, 0, p, '', changed, false FROM o UNION ALL
  SELECT r, g, l + 1, q // 2, s || coalesce(x, ''), sha256(CASE WHEN q % 2 = 1 THEN x || f ELSE f || coalesce(x, '') END), up FROM (
    SELECT w.r, w.g, w.l, w.p AS q, w.s, w.f, w.up, b.h AS x FROM w JOIN top ON w.g = top.g LEFT JOIN nodes b ON b.g = w.g AND b.l = w.l AND b.p = xor(w.p, 1) WHERE w.l < top.top)),
low AS MATERIALIZED (SELECT w.* FROM w JOIN top ON w.g = top.g AND w.l = top.top),
z(r, l, p, s, f) AS (SELECT r, 0, g, s, f FROM low UNION ALL
  SELECT r, l + 1, q // 2, s || coalesce(x, ''), sha256(CASE WHEN q % 2 = 1 THEN x || f ELSE f || coalesce(x, '') END) FROM (
    SELECT z.r, z.l, z.p AS q, z.s, z.f, b.h AS x FROM z LEFT JOIN whole b ON b.l = z.l AND b.p = xor(z.p, 1) WHERE z.l < (SELECT max(l) FROM whole))),
root AS (SELECT h AS root FROM whole WHERE m = 1)
SELECT doc_id, leaf, subroot, root, sha256(s) AS proof_sha256, f AS folded_root, f = root AS verified FROM z JOIN o USING (r) JOIN top ON o.g = top.g, root WHERE z.l = (SELECT max(l) FROM whole)"""
