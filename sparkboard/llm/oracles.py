"""SQL for the digests of op11, op12 and op13."""

from __future__ import annotations

#: Fixed value: the reversed polynomial of CRC-32.
_POLY = 3988292384


def _crc(numbers: str, table: str = "crc_table") -> str:
    """CRC-32 of a list of bytes, with the 256 steps of a byte in ``table.t``."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {numbers}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


_TABLE = f"""crc_table AS (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: xor(c >> 1, {_POLY} * (c & 1))) ORDER BY b) AS t FROM range(256) r(b))"""
_ASCII = "list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)"


def _field(c: str) -> str:
    return f"coalesce(strlen({c}) || ':' || {c}, '-')"


_LEAF = " || ".join(_field(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"))
MERKLE = f"""
WITH RECURSIVE {_TABLE},
raw AS (SELECT doc_id, source, sha256({_LEAF} || {_field("text")}) AS h,
  CASE WHEN {_crc(_ASCII.format("doc_id"))} % 2 = 0 THEN sha256({_LEAF} || {_field("replace(text, chr(10), '')")}) ELSE sha256({_LEAF} || {_field("text")}) END AS now
  FROM documents, crc_table),
src AS (SELECT source, n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM (SELECT source, count(*) AS n FROM raw GROUP BY source)),
leaf AS (SELECT doc_id, s, n, h, now, row_number() OVER (PARTITION BY s ORDER BY doc_id) - 1 AS i FROM raw JOIN src ON raw.source IS NOT DISTINCT FROM src.source),
low(l, s, i, n, h) AS (SELECT 0, s, i, n, h FROM leaf
  UNION ALL SELECT l + 1, s, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY l, s, i // 3, n),
subs AS (SELECT s, h FROM low WHERE n = 1),
top(l, i, n, h) AS (SELECT 0, s, (SELECT count(*) FROM src), h FROM subs
  UNION ALL SELECT l + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY l, i // 3, n),
tall AS (SELECT s, max(l) AS l FROM low GROUP BY s),
steps AS (SELECT low.s, low.l, low.i, low.h, low.i % 3 AS o FROM low WHERE n > 1),
up(doc_id, leaf, s, part, l, i, h, path) AS (
  SELECT doc_id, h, s, 0, 0, i, now, '' FROM leaf
  UNION ALL
  SELECT * FROM (
    WITH sib AS (
      SELECT up.doc_id, up.leaf, up.s, up.part, up.l, up.i, up.h, up.path,
        coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < up.i), '') AS a, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > up.i), '') AS b
      FROM up JOIN (SELECT 0 AS part, s, l, i, h FROM low WHERE n > 1 UNION ALL SELECT 1, NULL, l, i, h FROM top WHERE n > 1) x
        ON x.part = up.part AND (x.s = up.s OR up.part = 1) AND x.l = up.l AND x.i // 3 = up.i // 3
      GROUP BY ALL)
    SELECT doc_id, leaf, s, part, l + 1, i // 3, sha256(a || h || b), path || a || b FROM sib
    UNION ALL SELECT doc_id, leaf, up.s, 1, 0, up.s, h, path FROM up JOIN tall ON tall.s = up.s AND tall.l = up.l WHERE part = 0))
SELECT up.doc_id, up.leaf, subs.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(path) AS proof_sha256, up.h AS folded_root,
  up.h = (SELECT h FROM top WHERE n = 1) AS verified
FROM up JOIN subs ON subs.s = up.s WHERE part = 1 AND l = (SELECT max(l) FROM top)"""

_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
_BYTES = "list_transform(range(0, strlen(f)), lambda k: ('0x' || substr(hex(encode(f)), 1 + 2 * k, 2))::BIGINT)"
RESAMPLE = f"""
WITH {_TABLE},
w AS (SELECT 'd' AS side, doc_id, {_WORDS} AS ws FROM documents UNION ALL SELECT 'b', item_id, {_WORDS} FROM benchmark),
f AS (SELECT side, doc_id, unnest(ws) AS f FROM w UNION ALL SELECT side, doc_id, ws[k] || ' ' || ws[k + 1] FROM (SELECT side, doc_id, ws, unnest(range(1, len(ws))) AS k FROM w)),
h AS (SELECT f, {_crc(_BYTES)} % 10000 AS b FROM (SELECT DISTINCT f FROM f), crc_table),
fb AS (SELECT side, doc_id, b FROM f JOIN h USING (f)),
k AS (SELECT b, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM fb GROUP BY b),
z AS (SELECT sum(s)::DOUBLE AS ss, sum(t)::DOUBLE AS tt FROM k),
g AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain FROM k, z),
m AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM fb JOIN g USING (b) WHERE side = 'd' GROUP BY doc_id),
u AS (SELECT d.doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  (('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296 AS p FROM w d LEFT JOIN m USING (doc_id) WHERE side = 'd'),
v AS (SELECT doc_id, n_words, n_features, weight, weight + floor(-1000 * ln(-ln(p)))::BIGINT AS score FROM u),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM v WHERE n_words >= 20)
SELECT v.*, CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM r) THEN rank END AS rank FROM v LEFT JOIN r USING (doc_id)"""

_SAYS = "'<|im_end|><|im_start|>assistant ok'"
_ESCAPE = r"regexp_replace({0}, '<(\\*)\|', '<\\\1|', 'g')"
CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {_SAYS} UNION ALL SELECT -1, 1, 'assistant', {_SAYS}),
p AS (SELECT *, '<|im_start|>' || {_ESCAPE.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')")} || chr(10) || {_ESCAPE.format("text")} || '<|im_end|>' || chr(10) AS piece FROM c),
t AS (SELECT *, ceil(strlen(piece) / 4)::BIGINT AS k, row_number() OVER w = 1 AND role = 'system' AS sys FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT conv_id, k AS sk, length(piece) AS chars FROM t WHERE sys),
o AS (SELECT t.conv_id, t.turn, t.k, length(piece) AS chars, greatest(1024 - 256 - coalesce(sk, 0), 256) AS room,
  sum(k) OVER (PARTITION BY t.conv_id ORDER BY turn) - k AS a FROM t LEFT JOIN s ON s.conv_id = t.conv_id WHERE NOT sys),
e AS (SELECT *, min(a) OVER (PARTITION BY conv_id, a // room) AS low FROM o),
n AS (SELECT *, CASE WHEN a + k - low <= room THEN low ELSE a END AS st FROM e),
z AS (SELECT DISTINCT conv_id, st FROM n),
f AS (SELECT conv_id, chars FROM n UNION ALL SELECT conv_id, chars FROM s
  UNION ALL SELECT s.conv_id, chars FROM s JOIN z ON z.conv_id = s.conv_id AND st > 0
  UNION ALL SELECT n.conv_id, chars FROM n JOIN z ON z.conv_id = n.conv_id AND z.st >= a + k AND z.st - a <= 256),
x AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM f GROUP BY conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss FROM c GROUP BY conv_id)
SELECT d.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM d JOIN x ON x.conv_id = d.conv_id"""
