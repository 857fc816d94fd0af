"""SQL for DuckDB that gives the rows of those corpus queries which SQL can express, over the whole tables."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER.format('coalesce(text, ' + chr(39) * 2 + ')')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

CONTAMINATION = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS size FROM i WHERE len(w) > 0),
iw AS MATERIALIZED (SELECT DISTINCT item_id, size, array_to_string(w[p : p + size - 1], ' ') AS run FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM s)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') AS run FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)),
h AS MATERIALIZED (SELECT doc_id, p, size, item_id FROM dw JOIN iw USING (size, run)),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""

# Bytes are pairs of hexadecimal digits here, since SQL's strings are of characters.
REPEATS = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
s AS MATERIALIZED (SELECT doc_id, p, md5_number(substr(x, 2 * p + 1, 200)) AS m FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS p FROM d)),
f AS (SELECT m, min((doc_id, p)) AS first FROM s GROUP BY m HAVING count(*) > 1),
g AS (SELECT doc_id, p FROM s JOIN f USING (m) WHERE (doc_id, p) <> first),
k AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM g),
r AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM k) GROUP BY doc_id, run),
l AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS stops, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id),
c AS (SELECT d.doc_id, x, n, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, list_concat([0], coalesce(stops, [])) AS froms, list_append(coalesce(starts, []), n) AS tos FROM d LEFT JOIN l USING (doc_id))
SELECT doc_id, n AS n_bytes, n_removed, n_spans, sha256(unhex(array_to_string([substr(x, CAST(2 * froms[i] + 1 AS BIGINT), CAST(2 * (tos[i] - froms[i]) AS BIGINT)) FOR i IN range(1, len(froms) + 1)], ''))) AS kept_sha256 FROM c"""


# The CRC's table follows from its polynomial.
RESAMPLING = f"""
WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT unnest({_WORDS}) AS word FROM benchmark),
vocabulary AS (SELECT DISTINCT word FROM (SELECT unnest(w) AS word FROM d UNION ALL SELECT word FROM b)),
bytes AS (SELECT word, list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))) AS x FROM (SELECT word, hex(encode(word)) AS x FROM vocabulary)),
crc AS MATERIALIZED (SELECT word, xor(list_reduce(x, lambda c, v: xor(c >> 8, t[xor(c, v) % 256 + 1])), 4294967295) % 10000 AS bucket FROM bytes, tab),
f AS MATERIALIZED (SELECT doc_id, bucket, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) JOIN crc USING (word) GROUP BY ALL),
s AS (SELECT bucket, sum(n) AS s FROM f GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN crc USING (word) GROUP BY bucket),
sums AS (SELECT CAST(coalesce((SELECT sum(s) FROM s), 0) AS DOUBLE) AS s_all, CAST(coalesce((SELECT sum(t) FROM t), 0) AS DOUBLE) AS t_all),
g AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), sums),
m AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS total FROM f JOIN g USING (bucket) GROUP BY doc_id),
w AS (SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce((total - ((total % n) + n) % n) // n, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (doc_id)),
c AS MATERIALIZED (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM c WHERE n_features >= 20),
k AS (SELECT doc_id, rank FROM r WHERE rank <= (SELECT count(*) * 10 // 100 FROM r))
SELECT doc_id, n_features, weight, score, CAST(rank AS BIGINT) AS rank FROM c LEFT JOIN k USING (doc_id)"""

_BROKEN = "replace(replace(replace({0}, '\\', '\\\\'), '### ', '#\\## '), '</turn>', '<\\/turn>')"
CHATS = f"""
WITH said AS (SELECT '\\### Assistant: </turn> ok' AS text),
r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', text FROM said UNION ALL SELECT -7, 1, 'assistant', text FROM said),
f AS (SELECT *, '### ' || replace({_BROKEN.format("role")}, ': ', ':\\ ') || ': ' || {_BROKEN.format("text")} || '</turn>' || chr(10) AS piece FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""


def _clusters(rounds: int) -> str:
    """Inner products of whole numbers below 2**53 are exact in doubles."""
    square = lambda a, b: f"list_inner_product({a}, {b})"
    steps = []
    for k in range(rounds + 1):
        d = f"{square('v.x', 'v.x')} - 2 * {square('v.x', 'c.x')} + {square('c.x', 'c.x')}"
        steps.append(f"a{k} AS MATERIALIZED (SELECT row, vec_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT v.row, v.vec_id, c.cluster, {d} AS d FROM v, c{k} AS c) GROUP BY row, vec_id)")
        if k < rounds:
            steps.append(f"m{k} AS (SELECT cluster, list(s ORDER BY i) AS x FROM (SELECT cluster, i, floor((sum(z) - ((sum(z) % count(*)) + count(*)) % count(*)) / count(*)) AS s FROM (SELECT cluster, unnest(v.x) AS z, unnest(range(64)) AS i FROM a{k} JOIN v USING (row)) GROUP BY cluster, i) GROUP BY cluster)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{k}.x, c{k}.x) AS x FROM c{k} LEFT JOIN m{k} USING (cluster))")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS cluster, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT 40)),
{", ".join(steps)},
i AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY cluster)
SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance, cluster_inertia, CAST((SELECT sum(cluster_inertia) FROM i) AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.x, lambda z: CAST(z AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} JOIN i USING (cluster) JOIN c{rounds} AS c USING (cluster)"""


CLUSTERS = _clusters(5)
