"""DuckDB SQL for the jobs of this subpackage that SQL can express: each result anew, by another way."""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
s AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS payload_digest,
             max(page_id) OVER (PARTITION BY payload) AS holder FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND holder > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND holder > page_id THEN holder END AS refers_to
FROM s
"""

#: Distinct sets stand for their documents; pairs of sets that share a shingle are counted in full.
OP7 = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN []
           WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
           ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS shingles
  FROM w),
classes AS MATERIALIZED (SELECT min(doc_id) AS rep, shingles, len(shingles) AS n FROM sets WHERE len(shingles) > 0 GROUP BY shingles),
each AS MATERIALIZED (SELECT rep, n, unnest(shingles) AS s FROM classes),
pairs AS MATERIALIZED (
  SELECT x.rep AS u, y.rep AS v FROM each x JOIN each y ON x.s = y.s AND x.rep < y.rep
  WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
links AS MATERIALIZED (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT r.a, l.v FROM reach r JOIN links l ON r.b = l.u),
components AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY a)
SELECT s.doc_id, len(s.shingles) AS n_shingles, coalesce(k.component, s.doc_id) AS component_id, coalesce(k.component, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN classes c ON s.shingles = c.shingles LEFT JOIN components k ON k.rep = c.rep
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n_chars}", "text")) + ")"
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))"""

#: Trees level by level; a leaf's sibling on a level is the node beside its ancestor.
OP12 = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce(lang, '') AS tree, lang IS NULL AS none, {_LEAF.replace('{n_chars}', 'n_chars')} AS leaf,
         {_LEAF.replace('{n_chars}', '(CASE WHEN xor(' + _CRC + ', 4294967295) % 7 = 0 THEN n_chars + 1 ELSE n_chars END)')} AS tampered,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size
  FROM documents),
low AS (
  SELECT none, tree, 0 AS level, pos, leaf AS h, size FROM d
  UNION ALL
  SELECT none, tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (size + 1) // 2
  FROM low WHERE size > 1 GROUP BY none, tree, level, pos // 2, size),
nodes AS MATERIALIZED (SELECT * FROM low),
subroots AS MATERIALIZED (
  SELECT none, tree, h AS subroot, row_number() OVER (ORDER BY none DESC, encode(tree)) - 1 AS pos, count(*) OVER () AS size FROM nodes WHERE size = 1),
high AS (
  SELECT 0 AS level, pos, subroot AS h, size FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (size + 1) // 2 FROM high WHERE size > 1 GROUP BY level, pos // 2, size),
tops AS MATERIALIZED (SELECT * FROM high),
steps AS MATERIALIZED (
  SELECT d.doc_id, n.level, (d.pos >> n.level) % 2 = 1 AS is_right, b.h AS sibling
  FROM d JOIN (SELECT DISTINCT none, tree, level FROM nodes WHERE size > 1) n ON d.none = n.none AND d.tree = n.tree
  LEFT JOIN nodes b ON b.none = d.none AND b.tree = d.tree AND b.level = n.level AND b.pos = xor(d.pos >> n.level, 1)
  UNION ALL
  SELECT d.doc_id, 1000 + t.level, (s.pos >> t.level) % 2 = 1, b.h
  FROM d JOIN subroots s ON d.none = s.none AND d.tree = s.tree CROSS JOIN (SELECT DISTINCT level FROM tops WHERE size > 1) t
  LEFT JOIN tops b ON b.level = t.level AND b.pos = xor(s.pos >> t.level, 1)),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS k FROM steps),
fold AS (
  SELECT doc_id, 0 AS k, tampered AS h FROM d
  UNION ALL
  SELECT f.doc_id, n.k::INTEGER, sha256(CASE WHEN n.is_right THEN coalesce(n.sibling, '') || f.h ELSE f.h || coalesce(n.sibling, '') END)
  FROM fold f JOIN numbered n ON f.doc_id = n.doc_id AND n.k = f.k + 1),
folded AS (SELECT doc_id, arg_max(h, k) AS folded_root FROM fold GROUP BY doc_id),
proofs AS (SELECT doc_id, sha256(coalesce(string_agg(sibling, '' ORDER BY k), '')) AS proof_sha256 FROM numbered GROUP BY doc_id),
root AS (SELECT h AS root FROM tops WHERE size = 1)
SELECT d.doc_id, d.leaf, s.subroot, r.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = r.root AS verified
FROM d JOIN subroots s ON d.none = s.none AND d.tree = s.tree CROSS JOIN root r JOIN folded f ON f.doc_id = d.doc_id LEFT JOIN proofs p ON p.doc_id = d.doc_id
"""

ORACLES = {"op6_warc": OP6, "op7_near_dup": OP7, "op12_merkle_manifest": OP12}
