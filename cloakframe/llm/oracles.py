"""The queries that SQL can express, as DuckDB SQL."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

_GOOD_VECTORS = """
v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
),
good AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
)"""

#: Smallest id reachable over `links(a, b)`, which has both directions.
_REACH = """
reach AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)"""

ORACLES = {
    "op1_line_dedup": r"""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
ln AS (SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line FROM parts),
sets AS (
  SELECT row_number() OVER (ORDER BY doc_id, line_no) AS id, doc_id, line_no,
    list_distinct(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+')) AS s
  FROM ln
),
big AS (SELECT *, len(s) AS n FROM sets WHERE len(s) >= 1),
tok AS (SELECT id, n, unnest(s) AS w FROM big),
df AS (SELECT w, count(*) AS c FROM tok GROUP BY w),
pos AS (SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY c, w) AS p FROM tok JOIN df USING (w)),
pre AS (SELECT id, n, w FROM pos WHERE p <= n - CAST(ceil(n * 4 / 5.0) AS BIGINT) + 1),
cand AS (
  SELECT DISTINCT x.id AS a, y.id AS b FROM pre x JOIN pre y ON x.w = y.w AND x.id < y.id
  WHERE 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)
),
hit AS (
  SELECT cand.b AS id FROM cand JOIN big x ON x.id = cand.a JOIN big y ON y.id = cand.b
  WHERE 5 * len(list_intersect(x.s, y.s)) >= 4 * (x.n + y.n - len(list_intersect(x.s, y.s)))
  GROUP BY cand.b
),
gone AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS nos FROM hit JOIN big USING (id) GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, coalesce(gone.n, 0) AS n_removed, coalesce(gone.nos, '') AS removed
FROM parts LEFT JOIN gone USING (doc_id)
""",
    "op2_rotated_codes": f"""
WITH {_GOOD_VECTORS},
near AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_distance(q.e, x.e) AS score
  FROM good q JOIN good x ON q.vec_id <> x.vec_id AND len(q.e) = len(x.e)
  WHERE q.vec_id % 100 = 0
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM near
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
    "op5_lattice_dedup": f"""
WITH RECURSIVE {_GOOD_VECTORS},
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.9
),
{_REACH},
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, coalesce(least(low.m, e.vec_id), e.vec_id) AS component_id,
       coalesce(low.m >= e.vec_id, true) AS kept
FROM embeddings e LEFT JOIN degree d ON d.a = e.vec_id LEFT JOIN low ON low.a = e.vec_id
""",
    "op7_minhash_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w
),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
often AS (SELECT sh FROM s GROUP BY sh HAVING count(*) > 1),
shared AS (SELECT s.* FROM s JOIN often USING (sh)),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shared x JOIN shared y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)
),
{_REACH},
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, coalesce(least(low.m, d.doc_id), d.doc_id) AS component_id,
       coalesce(low.m >= d.doc_id, true) AS kept
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN low ON low.a = d.doc_id
""",
    "op8_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
),
t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, count(*) OVER (PARTITION BY conv_id) AS m,
    length('<|im_start|><|im_sep|><|im_end|>') + 1
      + length(regexp_replace(role, '\\|<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]', '\0+', 'g'))
      + length(regexp_replace(text, '\\|<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]', '\0+', 'g')) AS size
  FROM turns
),
sums AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR n = m) AS BIGINT) AS formatted_chars
FROM sums GROUP BY conv_id
""",
    "op9_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
),
first AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT win.doc_id, win.i FROM win JOIN first USING (h) WHERE win.doc_id > first.d),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM hit),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS text FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY words.doc_id
),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(removed.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
}
