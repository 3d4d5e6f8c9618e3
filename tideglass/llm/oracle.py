"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .line_quality import LINE_MIN_DOCS, LINE_SHARE, MAX_REPEAT_PERCENT, MIN_LEFT, MIN_WORDS

_W = r"[^\x20\x09-\x0D]+"

_WORDS_1 = rf"coalesce(len(regexp_extract_all(text, '{_W}')), 0)"
_PIECES_2 = r"coalesce(len(regexp_extract_all(text, '[0-9A-Za-z_]+|[^0-9A-Za-z_\x20\x09-\x0D]')), 0)"

OP1 = f"""
WITH q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT source, lang, {_WORDS_1} AS w1, {_PIECES_2} AS w2, q.doc_id IS NOT NULL AS labelled, coalesce(q.quality, 1) = 0 AS bad
  FROM documents LEFT JOIN q ON documents.doc_id = q.doc_id
),
s AS (
  SELECT source, lang, 'words-1' AS tokenizer_version, 1 AS n, w1 AS t FROM d
  UNION ALL SELECT source, lang, 'words-1', -1, -w1 FROM d WHERE labelled
  UNION ALL SELECT source, lang, 'pieces-2', 1, w2 FROM d WHERE labelled AND NOT bad
)
SELECT source, lang, tokenizer_version, CAST(sum(n) AS BIGINT) AS n_docs, CAST(sum(t) AS BIGINT) AS n_tokens
FROM s GROUP BY ALL HAVING sum(n) <> 0 OR sum(t) <> 0
"""

OP2 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents
),
lines AS (SELECT r, host, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
worded AS (
  SELECT *, len(regexp_extract_all(line, '{_W}')) AS n,
         array_to_string(regexp_extract_all(lower(line), '{_W}'), ' ') AS norm
  FROM lines WHERE regexp_matches(line, '{_W}')
),
dups AS (SELECT r, sum(c - 1) AS n_dup_lines FROM (SELECT r, line, count(*) AS c FROM worded GROUP BY r, line) GROUP BY r),
win AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3
),
tri AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM win),
seen AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c > 1),
reps AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT r, i AS p FROM seen UNION ALL SELECT r, i + 1 FROM seen UNION ALL SELECT r, i + 2 FROM seen) GROUP BY r
),
doc AS (SELECT r, md5(text) AS doc FROM d WHERE len(w) > 0),
freq AS (
  SELECT host, norm, count(DISTINCT doc) AS c FROM worded JOIN doc USING (r) GROUP BY host, norm HAVING count(DISTINCT doc) > {LINE_MIN_DOCS}
),
hosts AS (SELECT host, count(DISTINCT doc) AS hc FROM d JOIN doc USING (r) GROUP BY host),
common AS (SELECT freq.host, norm FROM freq JOIN hosts ON freq.host IS NOT DISTINCT FROM hosts.host WHERE c > {LINE_SHARE} * hc),
removed AS (
  SELECT r, sum(n) AS removed FROM worded JOIN common ON worded.host IS NOT DISTINCT FROM common.host AND worded.norm = common.norm GROUP BY r
),
f AS (
  SELECT doc_id, len(w) AS n_words, coalesce(len(array_to_string(w, '')), 0) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed, 0) AS removed
  FROM d LEFT JOIN dups USING (r) LEFT JOIN reps USING (r) LEFT JOIN removed USING (r)
),
g AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND n_words - removed >= {MIN_LEFT} * n_words AS kept, CAST(removed AS BIGINT) AS n_frequent_line_words
FROM g
"""

OP6 = """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL
),
n AS (SELECT pair_id, sum((side = 0)::INT) AS na, sum((side = 1)::INT) AS nb FROM t GROUP BY pair_id HAVING na > 0 AND nb > 0),
diff AS (
  SELECT a.pair_id, min(a.i) AS i FROM t a LEFT JOIN t b ON b.pair_id = a.pair_id AND b.side = 1 AND b.i = a.i
  WHERE a.side = 0 AND (b.i IS NULL OR a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text) GROUP BY a.pair_id
),
p AS (SELECT n.pair_id, coalesce(diff.i - 1, na) AS shared FROM n LEFT JOIN diff USING (pair_id)),
x AS (
  SELECT t.*, shared, '<|' || coalesce(role, '') || '|>' || chr(10) AS o, coalesce(text, '') || chr(10) AS c
  FROM t JOIN p USING (pair_id)
),
y AS (
  SELECT *, coalesce(sum(len(o) + len(c)) OVER (PARTITION BY pair_id, side, i > shared ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM x
)
SELECT pair_id, CAST(any_value(shared) AS INT) AS n_shared_turns,
       coalesce(string_agg(o || c, '' ORDER BY i) FILTER (side = 0 AND i <= shared), '') AS prompt,
       coalesce(string_agg(o || c, '' ORDER BY i) FILTER (side = 0 AND i > shared), '') AS chosen,
       coalesce(string_agg(o || c, '' ORDER BY i) FILTER (side = 1 AND i > shared), '') AS rejected,
       coalesce(string_agg((pos + len(o))::BIGINT || '-' || (pos + len(o) + len(c))::BIGINT, ',' ORDER BY i) FILTER (side = 0 AND i > shared AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg((pos + len(o))::BIGINT || '-' || (pos + len(o) + len(c))::BIGINT, ',' ORDER BY i) FILTER (side = 1 AND i > shared AND role = 'assistant'), '') AS rejected_mask
FROM y GROUP BY pair_id
"""

#: The mix over any table with doc_id, text and source.
OP10 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST({_WORDS_1} AS BIGINT) AS size,
         CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), '') || '-' || coalesce(text, ''))[1:15] AS BIGINT) AS h FROM documents
),
s AS (
  SELECT source, sum(size) AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight
  FROM d GROUP BY source
),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM c
  WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
t AS (
  SELECT source, source_size, least(cap, weight * coalesce((SELECT arg_min(level, ratio) FROM l WHERE ratio >= level), 0)) AS target FROM l
),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
b AS (SELECT *, target - copies * source_size AS budget FROM p),
k AS (
  SELECT d.source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY h) AS upto FROM d GROUP BY d.source, h
),
e AS (
  SELECT k.source, min(CASE WHEN upto > budget THEN CASE WHEN upto - budget < budget - (upto - words) THEN h + 1 ELSE h END END) AS threshold
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source GROUP BY k.source
)
SELECT d.doc_id, d.size, CAST(b.source_size AS BIGINT) AS source_size, b.target,
       CAST(d.size * (copies + CASE WHEN copies < 3 AND (threshold IS NULL OR h < threshold) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""

_SQUARED = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))"


def _nearest(k: int) -> str:
    """Least distance * 64 + entry of every part, and the codebooks after it."""
    return f"""
m{k} AS (SELECT p.r, p.part, min({_SQUARED} * 64 + b.entry) AS m FROM p JOIN b{k} b ON p.part = b.part GROUP BY ALL),
t{k} AS (SELECT part, m % 64 AS entry, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS c FROM (
  SELECT p.part, m, unnest(p.x) AS v, unnest(range(1, len(p.x) + 1)) AS i FROM p JOIN m{k} USING (r, part)) GROUP BY ALL),
b{k + 1} AS (
  SELECT b.part, b.entry, coalesce(t.x, b.x) AS x
  FROM b{k} b LEFT JOIN (SELECT part, entry, list(c ORDER BY i) AS x FROM t{k} GROUP BY ALL) t ON b.part = t.part AND b.entry = t.entry
)"""


OP11 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * c::DOUBLE) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))
),
q AS (SELECT *, unnest(range(16)) AS part FROM d),
p AS (SELECT r, vec_id, part, x[part * (len(x) // 16) + 1 : (part + 1) * (len(x) // 16)] AS x FROM q),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p WHERE vec_id IS NOT NULL QUALIFY entry < 64),
{_nearest(0)}, {_nearest(1)}, {_nearest(2)},
e AS (SELECT r, string_agg(printf('%02x', m % 64), '' ORDER BY part) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM m2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM e JOIN d USING (r)
"""


def _levels(name: str, tree: str, n: int) -> str:
    """Tables {name}1 .. {name}n of the nodes (t: tree, i: place, h, m: nodes left) above {name}0, and u{name}: runs of siblings by level."""
    up = [
        f"{name}{k + 1} AS (SELECT t, i // 3 AS i, CASE WHEN any_value(m) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (any_value(m) + 2) // 3 AS m FROM {name}{k} GROUP BY t, i // 3)"
        for k in range(n)
    ]
    runs = " UNION ALL ".join(f"SELECT {k} AS k, t, i // 3 AS i, list(h ORDER BY i) AS hs FROM {name}{k} WHERE m > 1 GROUP BY t, i // 3" for k in range(n))
    return ",\n".join([*up, f"u{name} AS ({runs})"])


#: Levels that the SQL writes out: as many documents a source, and as many sources, as 3 to that power.
_DOC_LEVELS, _SOURCE_LEVELS = 16, 8
_FIELD = lambda c, v: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END"
_LEAF = lambda text: "sha256(concat(" + ", ".join(_FIELD(c, f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars")) + ", " + _FIELD("text", text) + "))"
_CRC32 = "list_reduce(list_transform(range(1, strlen(s) + 1), lambda i: ascii(s[i])), lambda a, c: xor(a >> 8, list_reduce([xor(a, c) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"

OP12 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS t, CAST(doc_id AS VARCHAR) AS s,
         {_LEAF("text")} AS leaf, {_LEAF("replace(text, chr(10), '')")} AS other FROM documents
),
w AS (SELECT r, doc_id, t, leaf, CASE WHEN xor({_CRC32}, 4294967295) % 2 = 0 THEN other ELSE leaf END AS told, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
a0 AS (SELECT t, i, leaf AS h, count(*) OVER (PARTITION BY t) AS m FROM w),
{_levels("a", "t", _DOC_LEVELS)},
sub AS (SELECT t, h, row_number() OVER (ORDER BY t) - 1 AS i FROM a{_DOC_LEVELS}),
z0 AS (SELECT 0 AS t, i, h, count(*) OVER () AS m FROM sub),
{_levels("z", "0", _SOURCE_LEVELS)},
steps AS (
  SELECT r, k, w.i // CAST(3 ** k AS BIGINT) % 3 AS place, hs FROM w JOIN ua ON w.t = ua.t AND w.i // CAST(3 ** (k + 1) AS BIGINT) = ua.i
  UNION ALL SELECT r, {_DOC_LEVELS} + k, sub.i // CAST(3 ** k AS BIGINT) % 3, hs FROM w JOIN sub USING (t) JOIN uz ON sub.i // CAST(3 ** (k + 1) AS BIGINT) = uz.i
),
paths AS (
  SELECT r, list(array_to_string(hs[1:place], '') || ',' || array_to_string(hs[place + 2:], '') ORDER BY k) AS path FROM steps GROUP BY r
),
f AS (
  SELECT w.*, coalesce(path, []) AS path,
         list_reduce(coalesce(path, []), lambda acc, x: sha256(concat(split_part(x, ',', 1), acc, split_part(x, ',', 2))), told) AS folded_root
  FROM w LEFT JOIN paths USING (r)
)
SELECT doc_id, leaf, sub.h AS subroot, root, sha256(replace(array_to_string(path, ''), ',', '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM f JOIN sub ON f.t = sub.t CROSS JOIN (SELECT h AS root FROM z{_SOURCE_LEVELS}) z
"""

ORACLE = {"op1_token_rollup": OP1, "op2_line_quality": OP2, "op6_preference_pairs": OP6, "op10_mix_sources": OP10, "op11_vector_codes": OP11, "op12_merkle_manifest": OP12}
