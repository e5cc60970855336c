"""DuckDB SQL for the operators of this subpackage that SQL can express."""

ORACLE = {
    "op5_digest_index": r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op6_phrase_index": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
s AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, w[i:i + 9] AS t FROM s),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
m AS (SELECT p.doc_id, p.i, win.item_id, len(win.t) AS n FROM p JOIN win ON p.w[p.i] = win.t[1]
      WHERE p.w[p.i:p.i + len(win.t) - 1] = win.t),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op10_multi_order_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id < b.doc_id
      GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.y, r.root FROM r JOIN e ON r.doc_id = e.x)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id""",
    "op1_chat_snapshots": r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text,
         md5(concat(coalesce(length(role) || '=' || role, '-'), '|', coalesce(length(text) || '=' || text, '-'))) AS d
  FROM conversations),
o AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
             string_agg(d, '') OVER (w ROWS UNBOUNDED PRECEDING) AS h
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d)),
kept AS (
  SELECT min(conv_id) AS conv_id FROM o AS e
  WHERE pos = n AND NOT EXISTS (SELECT 1 FROM o AS p WHERE p.h = e.h AND p.pos < p.n) GROUP BY h)
SELECT conv_id, n AS n_turns, (pos - 1) // 64 AS segment,
       string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos)
         AS rendered
FROM o SEMI JOIN kept USING (conv_id) GROUP BY ALL""",
    "op2_temperature_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 1) AS tokens FROM documents),
s AS (SELECT source, sum(tokens)::BIGINT AS tokens, sum(tokens) / sum(sum(tokens)) OVER () AS p FROM d GROUP BY source),
a AS (SELECT sum(tokens)::DOUBLE AS total, count(*) AS k FROM s),
-- the largest exponent that reaches 95 % of the largest entropy, and the largest that repeats a source over four times
e(step, lo, width) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN (SELECT ln(sum(pow(p, lo + width / 2))) - (lo + width / 2) * sum(pow(p, lo + width / 2) * ln(p))
      / sum(pow(p, lo + width / 2)) FROM s) >= 0.95 * (SELECT ln(k) FROM a) - 1e-12 THEN lo + width / 2 ELSE lo END, width / 2
  FROM e WHERE step < 24),
r(step, lo, width) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN (SELECT max(pow(p, lo + width / 2 - 1)) / sum(pow(p, lo + width / 2)) FROM s) > 4 * (1 + 1e-12)
      THEN lo + width / 2 ELSE lo END, width / 2
  FROM r WHERE step < 24),
tau AS (
  SELECT greatest(
    CASE WHEN (SELECT -sum(p * ln(p)) FROM s) >= 0.95 * (SELECT ln(k) FROM a) - 1e-12 THEN 1.0
         ELSE (SELECT lo FROM e WHERE step = 24) END,
    CASE WHEN (SELECT lo FROM r WHERE step = 24) > 0 OR (SELECT max(1 / p) / count(*) FROM s) > 4 * (1 + 1e-12)
         THEN (SELECT lo + width FROM r WHERE step = 24) ELSE 0 END) AS tau),
q AS (
  SELECT source, tokens AS alltok, pow(p, tau) / sum(pow(p, tau)) OVER () AS weight,
         round(tokens * pow(p, tau - 1) / sum(pow(p, tau)) OVER ())::BIGINT AS quota,
         ceil(tokens / 100000)::BIGINT AS blocks
  FROM s, tau),
dealt AS (
  SELECT d.*, alltok, weight, quota, CAST('0x' || substr(md5('mix|' || doc_id), 1, 15) AS BIGINT) % blocks AS block
  FROM d JOIN q USING (source)),
b AS (
  SELECT source, block, unnest(range(0, greatest(ceil(any_value(quota) / any_value(alltok)), 1)::BIGINT)) AS epoch,
         sum(tokens) AS size FROM dealt WHERE quota > 0 GROUP BY source, block),
bs AS (
  SELECT source, block, epoch, sum(size) OVER (PARTITION BY source, epoch
      ORDER BY CAST('0x' || substr(md5('mix|=' || source || '|' || epoch || '|' || block), 1, 15) AS BIGINT), block
      ROWS UNBOUNDED PRECEDING) - size AS f FROM b),
x AS (
  SELECT doc_id, source, tokens, epoch, block, weight, quota, epoch * alltok + f + sum(tokens) OVER (
      PARTITION BY source, block, epoch
      ORDER BY CAST('0x' || substr(md5('mix|' || epoch || '|' || doc_id), 1, 15) AS BIGINT), doc_id
      ROWS UNBOUNDED PRECEDING) - tokens AS start
  FROM dealt JOIN bs USING (source, block))
SELECT doc_id, source, tokens, epoch, block, CAST(start AS BIGINT) AS start, round(weight, 9) AS weight,
       round(start / quota, 9) AS place
FROM x WHERE start < quota""",
    "op12_spelling_variants": r"""
WITH RECURSIVE t AS (  -- the table of crc32, from its polynomial
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384)
         ELSE c >> 1 END, n)) AS crc),
o AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
c AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM o GROUP BY ALL HAVING length(w) >= 6),
h AS (
  SELECT w, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM c),
g AS (
  SELECT w, n, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
                              lambda s, b: xor(s >> 8, t.crc[(xor(s, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM h, t),
d AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM g),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
s AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM s AS a JOIN s AS b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT s.word, v.word, v.n FROM s JOIN v ON s.less = v.word
  UNION SELECT v.word, s.word, s.n FROM s JOIN v ON s.less = v.word),
f AS (
  SELECT v.word, v.n, count(near) AS n_near, arg_min(near, struct_pack(k := -near_n, w := encode(near))) AS best, max(near_n) AS best_n
  FROM v LEFT JOIN p USING (word) GROUP BY ALL),
w AS (
  SELECT word, n, n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM f),
r AS (
  SELECT word, word AS spot, 0 AS step FROM w
  UNION ALL SELECT r.word, w.form, step + 1 FROM r JOIN w ON r.spot = w.word WHERE w.form IS NOT NULL)
SELECT word, n, n_near, form, form_n, root FROM w JOIN (SELECT word, arg_max(spot, step) AS root FROM r GROUP BY word) USING (word)""",
    "op13_hard_negatives": r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e AS a JOIN e AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score,
       score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
}


def _pii() -> str:
    """Personal data: matches and what stands between them give the places; the fixed values are the operator's."""
    from kerbflow.llm import pii

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]){11,30}",
        "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}", "routing": "[0-9]{9}",
        "insee": "[12] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}"}
    kinds = ", ".join(f"('{k}', {n}, '{patterns[k]}', {pii.POINTS[k]}, {pii.SUPPORT[k]}, {pii.AGAINST[k]})" for n, k in enumerate(pii.KINDS))
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return rf"""
WITH k(kind, rank, pattern, points, support, against) AS (VALUES {kinds}),
t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS key FROM documents),
r AS (SELECT key, text, k.*, string_split_regex(text, pattern) AS gaps, regexp_extract_all(text, pattern) AS hits FROM t, k),
i AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM r),
h AS (
  SELECT key, text, kind, rank, points, support, against, hits[i] AS hit,
         CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)
              AS BIGINT) AS start
  FROM i),
s AS (
  SELECT * REPLACE (CASE WHEN kind = 'iban' THEN substr(hit, 1, list_filter(range(1, length(hit) + 1), lambda p: length(replace(
                           substr(hit, 1, p), ' ', '')) = coalesce(map_extract(MAP {pii.IBAN_LENGTHS}, hit[1:2])[1], 99))[1]) ELSE hit END AS hit)
  FROM h),
d AS (
  SELECT *, start + length(hit) AS stop, regexp_replace(hit, '[^0-9]+', '', 'g') AS digits, string_split(hit, '.') AS parts,
         replace(hit, ' ', '') AS packed
  FROM s WHERE hit IS NOT NULL),
e AS (
  SELECT *, CASE WHEN start > 0 THEN substr(text, start, 1) ELSE '' END || substr(text, stop + 1, 1) AS touching FROM d),
v AS (
  SELECT * FROM e
  WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(parts, lambda p: length(ltrim(p, '0')) > 3 OR CAST(right('0' || ltrim(p, '0'), 3) AS INT) > 255)) = 0
    WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length(digits)), lambda n:
         CASE WHEN n % 2 = 0 THEN CAST(digits[length(digits) - n] AS INT)
              ELSE CAST(digits[length(digits) - n] AS INT) * 2 % 10 + CAST(digits[length(digits) - n] AS INT) // 5 END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
    WHEN 'iban' THEN list_reduce(string_split(packed[5:] || packed[1:4], ''), lambda a, c: CASE WHEN c >= 'A'
         THEN (a * 100 + ascii(c) - 55) % 97 ELSE (a * 10 + ascii(c) - 48) % 97 END, 0) = 1
    WHEN 'ssn' THEN digits[1:3] NOT IN ('000', '666') AND digits[1:3] < '900' AND digits[4:5] <> '00' AND digits[6:] <> '0000'
    WHEN 'routing' THEN (CAST(digits[1:2] AS INT) BETWEEN 1 AND 12 OR CAST(digits[1:2] AS INT) BETWEEN 21 AND 32
         OR CAST(digits[1:2] AS INT) BETWEEN 61 AND 72 OR CAST(digits[1:2] AS INT) = 80)
         AND list_sum(list_transform(range(1, 10), lambda n: CAST(digits[n] AS INT) * [7, 1, 3][(n + 1) % 3 + 1])) % 10 = 0
    ELSE CAST(digits[4:5] AS INT) BETWEEN 1 AND 12 AND (CAST(digits[1:13] AS BIGINT) + CAST(digits[14:] AS BIGINT)) % 97 = 0 END
  AND (rank < {len(pii.BASE)} OR NOT regexp_matches(touching, '[A-Za-z0-9-]'))),
c AS (
  SELECT *, regexp_extract_all(translate(substr(text, greatest(start - {pii.BEFORE}, 0) + 1, least(start, {pii.BEFORE})) || ' ' ||
         substr(text, stop + 1, {pii.AFTER}), {lower}), '[a-z]+') AS near
  FROM v),
p AS (
  SELECT *, least(greatest(points + CASE WHEN list_has_any(near, support) THEN {pii.SHIFT} ELSE 0 END
         - CASE WHEN list_has_any(near, against) THEN {pii.SHIFT} ELSE 0 END, 0), 100) AS score
  FROM c),
f AS (
  SELECT key, start, rank, kind, score, concat_ws(':', kind, start, stop) AS span FROM p
  WHERE rank < {len(pii.BASE)} OR score >= {pii.LEAST}),
g AS (
  SELECT key, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)},
         string_agg(span, ',' ORDER BY start, rank) FILTER (rank < {len(pii.BASE)}) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans,
         count(*) FILTER (rank >= {len(pii.BASE)}) AS n_added, CAST(max(score) AS INTEGER) AS top_score
  FROM f GROUP BY key)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_added, 0) AS n_added, top_score
FROM t LEFT JOIN g USING (key)"""


ORACLE["op11_pii_spans"] = _pii()
