"""Registered queries of the corpus operators."""

from __future__ import annotations

from cohortlake.llm import bpe, fingerprints, lines, media, minhash, mixing, mixture, packing, periods, sharding, toxicity, trie

QUERIES = {
    "op1_minhash_near_dedup": minhash.op1_minhash_near_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_sharding": sharding.op4_sharding,
    "op5_packed_matrices": packing.op5_packed_matrices,
    "op6_media_sniffing": media.op6_media_sniffing,
    "op7_context_mixing": mixing.op7_context_mixing,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_periodic_runs": periods.op11_periodic_runs,
    "op12_mixture_packing": mixture.op12_mixture_packing,
    "op13_prefix_trie": trie.op13_prefix_trie,
}

#: Shingle sets, links by counts of common shingles, and what is reachable over them.
_OP1 = """WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
cls AS (SELECT min(doc_id) AS c, s, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM sets) WHERE len(s) > 0 GROUP BY s),
item AS (SELECT c, n, unnest(s) AS x FROM cls),
link AS (SELECT a.c AS a, b.c AS b FROM item a JOIN item b ON a.x = b.x AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT c AS a, c AS b FROM cls UNION SELECT reach.a, way.b FROM reach JOIN way ON way.a = reach.b),
comp AS (SELECT a AS c, min(b) AS component_id FROM reach GROUP BY 1),
member AS (SELECT s.doc_id, len(s.s) AS n, cls.c FROM (SELECT doc_id, list_sort(s) AS s FROM sets) s LEFT JOIN cls ON cls.s = s.s)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM member LEFT JOIN comp USING (c)"""

#: Checksums of ids bit by bit, rebuilt conversations as lists of turn digests, and every node with all above it.
_OP13 = """WITH RECURSIVE own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32)) AS place FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT conv_id FROM own)
 UNION ALL SELECT conv_id, s, k + 1, xor(x >> 1, (x & 1) * 3988292384) FROM (SELECT conv_id, s, k, CASE WHEN k % 8 = 0 THEN xor(c, CAST(ascii(s[k // 8 + 1]) AS BIGINT)) ELSE c END AS x FROM crc WHERE k < 8 * length(s))),
h AS (SELECT conv_id, xor(c, CAST(4294967295 AS BIGINT)) % 6 AS h FROM crc WHERE k = 8 * length(s)),
parts AS (SELECT h.conv_id, 0 AS part, place, role, text FROM h JOIN own ON own.conv_id = h.conv_id - h.conv_id % 100 AND place <= h
 UNION ALL SELECT h.conv_id, 1, place, role, text FROM h JOIN own ON own.conv_id = h.conv_id AND place > h),
lists AS (SELECT h.conv_id, coalesce(list(sha256(length(role) || ':' || role || text) ORDER BY part, place) FILTER (role IS NOT NULL), []) AS keys, coalesce(list(length(text) ORDER BY part, place) FILTER (role IS NOT NULL), []) AS points FROM h LEFT JOIN parts USING (conv_id) GROUP BY 1),
pre AS (SELECT conv_id, CAST(d AS BIGINT) AS depth, array_to_string(keys[1:d], '') AS k, d = len(keys) AS ends, points[d] AS points FROM lists, unnest(range(0, len(keys) + 1)) AS t(d)),
node AS (SELECT depth, k, min(conv_id) AS least, count(*) AS n, max(points) AS points, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ends FROM pre GROUP BY 1, 2),
kids AS (SELECT depth - 1 AS depth, left(k, 64 * (depth - 1)) AS k, count(*) AS children FROM node WHERE depth > 0 GROUP BY 1, 2),
full_ AS (SELECT node.*, coalesce(children, 0) AS children FROM node LEFT JOIN kids USING (depth, k)),
up AS (SELECT CAST(a AS BIGINT) AS depth, left(k, 64 * a) AS k, count(*) FILTER (children = 0) AS leaves, CAST(sum((n - 1) * coalesce(points, 0)) AS BIGINT) AS saved FROM full_, unnest(range(0, depth + 1)) AS t(a) GROUP BY 1, 2)
SELECT f.least AS conv_id, f.depth, p.least AS parent_conv_id, f.n AS n_convs, f.children AS n_children, up.leaves AS n_leaves, up.saved AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN up USING (depth, k) LEFT JOIN node p ON p.depth = f.depth - 1 AND p.k = left(f.k, 64 * (f.depth - 1))"""

#: Where SQL is too slow on whole tables, or cannot say it, there is none; tests hold the query against brute force.
ORACLE_SQL: dict[str, str] = {"op1_minhash_near_dedup": _OP1, "op13_prefix_trie": _OP13}
