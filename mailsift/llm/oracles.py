"""DuckDB SQL of the operators that SQL can express on whole tables."""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_HAS_WORD = r"regexp_matches(l, '[^\x20\x09-\x0D]')"
_NORM = r"trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'))"

_OP6 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i+7] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM d)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, 8) AS t(k) WHERE n > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l FROM d),
good AS (SELECT doc_id, source, l, {_NORM} AS norm FROM lines WHERE {_HAS_WORD}),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM good GROUP BY doc_id),
sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
boiler AS (SELECT g.source, g.norm FROM (SELECT source, norm, count(DISTINCT doc_id) AS n FROM good GROUP BY source, norm) g
           JOIN sizes s ON s.source IS NOT DISTINCT FROM g.source WHERE g.n > 20 AND g.n > s.n * 0.1),
lost AS (SELECT doc_id, sum(len({_WORDS.replace('text', 'l')})) AS n FROM good g
         WHERE EXISTS (SELECT 1 FROM boiler b WHERE b.source IS NOT DISTINCT FROM g.source AND b.norm = g.norm) GROUP BY doc_id),
all_of AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             (len(w) - coalesce(lost.n, 0))::BIGINT AS n_kept_words
           FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_kept_words >= n_words * 0.3 AS kept, n_kept_words
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM all_of)
"""

_OP9 = """
WITH u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT vec_id, vec_id AS r FROM u)
, walk AS (WITH RECURSIVE w(v, r) AS (SELECT vec_id, vec_id FROM u UNION SELECT l.b, w.r FROM w JOIN links l ON l.a = w.v) SELECT v, min(r) AS c FROM w GROUP BY v),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM u JOIN walk ON v = vec_id LEFT JOIN n ON n.a = vec_id
"""

_OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i+12] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, range(0, 13) AS t(k)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

_CRC = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(hex(encode(text)), '..'),
    lambda h: [(('0x' || h[2])::BIGINT), (('0x' || h[1])::BIGINT)]))), lambda c, n: xor(table16[(xor(c, n) & 15) + 1], c >> 4))"""

_OP1 = f"""
WITH RECURSIVE step(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(16) AS t(i) UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 4),
tables AS (SELECT list(c ORDER BY i) AS table16 FROM step WHERE k = 4),
d AS (SELECT doc_id, source, coalesce(text, '') AS text, table16 FROM documents, tables),
crc AS (SELECT doc_id, source, (strlen(text) + 16)::BIGINT AS size, CASE WHEN text = '' THEN 0 ELSE xor({_CRC}, 4294967295) END::BIGINT AS text_crc32 FROM d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || coalesce(doc_id::VARCHAR, 'null')), text_crc32, size) AS r, count(*) OVER (PARTITION BY source) AS n FROM crc),
placed AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1)::DOUBLE / (2 * n), CASE WHEN source IS NULL THEN 'null' ELSE 's' || source END, r) - 1 AS p0, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, p0 * 40 // total AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, (p0 - (shard * total + 39) // 40)::BIGINT AS slot, NULL::INTEGER AS grown_shard, source FROM cut
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + "))"
_PATH = """list(CASE WHEN s.h IS NULL THEN '=' WHEN s.i & 1 = 1 THEN '>' || s.h ELSE '<' || s.h END ORDER BY v.l)"""

_OP11 = f"""
WITH RECURSIVE step(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(16) AS t(i) UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 4),
tables AS (SELECT list(c ORDER BY i) AS table16 FROM step WHERE k = 4),
crc AS (SELECT text AS id, xor({_CRC}, 4294967295) AS crc FROM (SELECT DISTINCT doc_id::VARCHAR AS text, table16 FROM documents, tables WHERE doc_id IS NOT NULL)),
d AS (SELECT doc_id, coalesce('s' || lang, 'n') AS t, {_LEAF.format('n_chars')} AS leaf,
        CASE WHEN crc % 7 = 0 THEN {_LEAF.format('(n_chars + 1)')} ELSE {_LEAF.format('n_chars')} END AS claimed FROM documents LEFT JOIN crc ON id = doc_id::VARCHAR),
low AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM d),
nodes(t, n, l, i, h) AS (SELECT t, n, 0, i, leaf FROM low UNION ALL
    SELECT t, n, l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE (n + (1 << l) - 1) >> l > 1 GROUP BY t, n, l, i // 2),
roots AS (SELECT t, h AS subroot FROM nodes WHERE (n + (1 << l) - 1) >> l = 1),
top AS (SELECT t, subroot, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM roots),
upper(n, l, i, h) AS (SELECT n, 0, i, subroot FROM top UNION ALL
    SELECT n, l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE (n + (1 << l) - 1) >> l > 1 GROUP BY n, l, i // 2),
all_of AS (SELECT h AS root FROM upper WHERE (n + (1 << l) - 1) >> l = 1),
levels AS (SELECT l FROM range(40) AS r(l)),
low_path AS (SELECT a.t, a.i, {_PATH} AS p FROM low a JOIN levels v ON (a.n + (1 << v.l) - 1) >> v.l > 1
    LEFT JOIN nodes s ON s.t = a.t AND s.l = v.l AND s.i = xor(a.i >> v.l, 1) GROUP BY a.t, a.i),
high_path AS (SELECT a.t, {_PATH} AS p FROM top a JOIN levels v ON (a.n + (1 << v.l) - 1) >> v.l > 1
    LEFT JOIN upper s ON s.l = v.l AND s.i = xor(a.i >> v.l, 1) GROUP BY a.t),
proof AS (SELECT a.*, top.subroot, root, list_concat(coalesce(low_path.p, []), coalesce(high_path.p, [])) AS p
    FROM low a JOIN top USING (t) CROSS JOIN all_of LEFT JOIN low_path ON low_path.t = a.t AND low_path.i = a.i LEFT JOIN high_path ON high_path.t = a.t),
told AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(p, lambda s: s <> '='), lambda s: s[2:]), '')) AS proof_sha256,
    list_reduce(list_prepend(claimed, p), lambda a, s: CASE WHEN s = '=' THEN sha256(a) WHEN s[1] = '<' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END) AS folded_root FROM proof)
SELECT *, folded_root = root AS verified FROM told
"""

_OP13 = f"""
WITH RECURSIVE step(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(16) AS t(i) UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 4),
tables AS (SELECT list(c ORDER BY i) AS table16 FROM step WHERE k = 4),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
old AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS p FROM turns),
convs AS (SELECT text::BIGINT AS conv_id, xor({_CRC}, 4294967295) % 4 AS h, text::BIGINT - text::BIGINT % 20 AS base
          FROM (SELECT DISTINCT conv_id::VARCHAR AS text, table16 FROM turns, tables)),
parts AS (SELECT c.conv_id, o.role, o.text, 0 AS side, o.p FROM convs c JOIN old o ON o.conv_id = c.base AND o.p <= c.h
          UNION ALL SELECT c.conv_id, o.role, o.text, 1, o.p FROM convs c JOIN old o ON o.conv_id = c.conv_id AND o.p > c.h),
seq AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY side, p) AS s FROM parts GROUP BY conv_id),
conv AS (SELECT conv_id, coalesce(s, []) AS s FROM convs LEFT JOIN seq USING (conv_id)),
prefix AS (SELECT conv_id, d, s[:d] AS node, d = len(s) AS ends FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM conv)),
node AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends,
           CASE WHEN d = 0 THEN 0 ELSE len({_WORDS.replace("coalesce(text, '')", "node[d].text")}) END AS words FROM prefix GROUP BY node, d),
child AS (SELECT node[:d - 1] AS parent, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
full_of AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM node n LEFT JOIN child c ON c.parent = n.node),
below AS (SELECT node[:k] AS top, (n_convs - 1) * words AS saved, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf
          FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM full_of)),
sums AS (SELECT top, sum(saved) AS saved, sum(leaf) AS leaves FROM below GROUP BY top)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, sums.leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_of n JOIN sums ON sums.top = n.node LEFT JOIN full_of p ON n.d > 0 AND p.node = n.node[:n.d - 1]
"""

SQL: dict[str, str] = {"op1_sharding": _OP1, "op6_quality_rules": _OP6, "op9_epsilon_grid": _OP9, "op10_substring_dedup": _OP10, "op11_merkle_manifest": _OP11, "op13_prefix_trie": _OP13}
