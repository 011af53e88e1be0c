"""DuckDB SQL that the queries must equal."""

from __future__ import annotations

from .templates import UNITS

SQL: dict[str, str] = {}

SQL["op2_line_frequency"] = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, w, i FROM (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs))),
triples AS (SELECT r, i, w, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY r ORDER BY i)),
often3 AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM triples WHERE w3 IS NOT NULL) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM often3, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
sums AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY r),
lines AS (SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM docs),
full_lines AS (SELECT r, host, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw FROM lines),
dups AS (SELECT r, sum(n - 1) AS n FROM (SELECT r, line, count(*) AS n FROM full_lines WHERE nw > 0 GROUP BY r, line) GROUP BY r),
keyed AS (SELECT r, host, nw, regexp_replace(array_to_string(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'), ' '), '[0-9]+', '0', 'g') AS key
  FROM full_lines WHERE nw > 0),
frequent AS (SELECT host, key FROM (SELECT DISTINCT r, host, key FROM keyed) GROUP BY host, key HAVING count(*) > 10),
taken AS (SELECT r, sum(nw) AS n FROM keyed SEMI JOIN frequent USING (host, key) GROUP BY r),
measured AS (SELECT d.doc_id, coalesce(s.n_words, 0)::BIGINT AS n_words, coalesce(s.word_chars, 0)::BIGINT AS word_chars,
  (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(u.n, 0)::BIGINT AS n_dup_lines,
  coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(t.n, 0)::BIGINT AS removed_words
  FROM docs d LEFT JOIN sums s USING (r) LEFT JOIN repeated p USING (r) LEFT JOIN dups u USING (r) LEFT JOIN taken t USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= 0.5 * n_words AS kept, removed_words
FROM measured
"""

SQL["op9_lookup_placement"] = r"""
WITH RECURSIVE shards AS (SELECT k, printf('shard-%02d', k) AS name FROM range(0, 64) AS s(k)),
steps AS (SELECT k, name, (('0x' || substr(md5(name), 1, 8))::BIGINT % 8191) AS first, (('0x' || substr(md5(name), 9, 8))::BIGINT % 8190 + 1) AS stride FROM shards),
lists AS (SELECT list(first ORDER BY k) AS firsts, list(stride ORDER BY k) AS strides FROM steps),
claims(turn, taken, tried, slot) AS (
  SELECT 0::BIGINT, bitstring('0', 8191), list_transform(range(0, 64), lambda x: 0::BIGINT), -1::BIGINT
  UNION ALL
  SELECT turn + 1, set_bit(taken, slot_now::INT, 1), list_transform(tried, lambda t, i: CASE WHEN i = turn % 64 + 1 THEN next ELSE t END), slot_now
  FROM (SELECT c.turn, c.taken, c.tried, n.next, (l.firsts[c.turn % 64 + 1] + n.next * l.strides[c.turn % 64 + 1]) % 8191 AS slot_now
    FROM claims c, lists l, LATERAL (SELECT list_filter(range(c.tried[c.turn % 64 + 1], 8191),
      lambda x: get_bit(c.taken, ((l.firsts[c.turn % 64 + 1] + x * l.strides[c.turn % 64 + 1]) % 8191)::INT) = 0)[1] AS next) n
    WHERE c.turn < 8191)),
owners AS (SELECT slot, printf('shard-%02d', (turn - 1) % 64) AS shard FROM claims WHERE turn > 0)
SELECT doc_id, slot::INT AS slot, shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 8))::BIGINT % 8191 AS slot FROM documents) JOIN owners USING (slot)
"""

_UNITS = ", ".join(f"'{u}'" for u in UNITS)


def _windows(name: str, source: str, key: str) -> str:
    return rf"""
{name}_found AS (SELECT {key}, regexp_extract_all(text, '(?:[.!?:\n][^\p{{L}}\p{{N}}]*)?(?:\p{{L}}+|\p{{N}}+(?:[.,]\p{{N}}+)*)') AS f FROM {source}),
{name}_tokens AS (SELECT {key}, generate_subscripts(f, 1) AS i, unnest(f) AS t FROM {name}_found),
{name}_words AS (SELECT {key}, i, substr(t, 1, 1) IN ('.', '!', '?', ':', chr(10)) AS s,
  CASE WHEN substr(t, 1, 1) IN ('.', '!', '?', ':', chr(10)) THEN regexp_replace(t, '^[^\p{{L}}\p{{N}}]+', '') ELSE t END AS w FROM {name}_tokens),
{name}_before AS (SELECT *, lag(w) OVER (PARTITION BY {key} ORDER BY i) AS p FROM {name}_words),
{name}_kinds AS (SELECT {key}, i, w, CASE WHEN regexp_matches(w, '^\p{{N}}') THEN '<num>'
  WHEN p IS NOT NULL AND regexp_matches(p, '^\p{{N}}') AND lower(w) IN ({_UNITS}) THEN '<unit>'
  WHEN p IS NOT NULL AND NOT s AND length(w) > 1 AND lower(w) != w AND lower(substr(w, 2)) = substr(w, 2) THEN '<name>'
  ELSE lower(w) END AS t FROM {name}_before),
{name}_windows AS (SELECT * FROM (SELECT {key}, i - 1 AS "at", list(t) OVER o AS win,
  list(CASE WHEN t IN ('<num>', '<unit>', '<name>') THEN w END) OVER o AS slots, count(*) OVER o AS n
  FROM {name}_kinds WINDOW o AS (PARTITION BY {key} ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE n = 8)"""


SQL["op4_template_leaks"] = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)),
items AS (SELECT min(item_id) AS item_id, text FROM benchmark WHERE text IS NOT NULL GROUP BY text),
{_windows("d", "docs", "r")},
{_windows("b", "items", "item_id")},
sizes AS (SELECT item_id, count(*) AS total FROM b_windows GROUP BY item_id),
hits AS (SELECT d.r, b.item_id, d."at" - b."at" AS diagonal, d."at" AS "at", unnest(range(1, 9)) AS k, b.slots AS a, d.slots AS g
  FROM d_windows d JOIN b_windows b ON d.win = b.win),
runs AS (SELECT r, item_id, diagonal, count(DISTINCT "at") AS n_windows, count(DISTINCT CASE WHEN a[k] IS NOT NULL THEN (a[k], g[k]) END) AS n_pairs,
  count(DISTINCT a[k]) AS n_asked, count(DISTINCT CASE WHEN a[k] != g[k] THEN (a[k], g[k]) END) AS changed FROM hits GROUP BY r, item_id, diagonal)
SELECT doc_id, item_id, max(n_windows)::BIGINT AS n_windows, min(changed)::BIGINT AS changed_slots
FROM runs JOIN sizes USING (item_id) JOIN docs USING (r) WHERE n_windows >= least(3, total) AND n_pairs = n_asked GROUP BY r, doc_id, item_id
"""

SQL["op10_block_labeller"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS body FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '\s+', ' ', 'g'), '<br>', ' ', 'g'), '</?(p|h1)>', chr(10), 'g'),
  '</?b>|<[a-z/][^>]*$', '', 'g') AS body FROM a),
c AS (SELECT page_id, url, replace(regexp_replace(replace(body, '&quot;', '"'), '&amp;?', '&', 'g'), chr(160), ' ') AS body FROM b),
d AS (SELECT page_id, url, coalesce(array_to_string(list_filter(list_transform(string_split(body, chr(10)),
  lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x != ''), chr(10)), '') AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""

SQL["op11_bloom_slices"] = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
d AS (SELECT row_number() OVER () AS row_id, doc_id, ws, len(ws)::BIGINT AS n FROM t WHERE len(ws) > 0), c AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT row_id, term, count(*)::BIGINT AS tf FROM (SELECT row_id, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), c),
s AS (SELECT item_id, row_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (row_id), c GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s JOIN d USING (row_id) WHERE score > 0 QUALIFY rank <= 10
"""

SQL["op12_trie_frontier"] = r"""
WITH RECURSIVE k AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384::UBIGINT, a >> 1) ELSE a >> 1 END) AS c FROM range(256) r(i))),
u AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*)::BIGINT AS n FROM u WHERE length(run) >= 6 GROUP BY 1, 2),
b AS (SELECT *, list_transform(range(0, octet_length(encode(coalesce(doc_id::VARCHAR, '') || ':' || run))), lambda i: ('0x' || substr(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), 2 * i + 1, 2))::UBIGINT) AS bytes FROM g),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT) AS h FROM b, k),
v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM v WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w), y AS (SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM x),
e AS (SELECT a.word, b.word AS near FROM y a JOIN y b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word UNION SELECT y.word, w.word FROM y JOIN w ON w.word = y.cut UNION SELECT w.word, y.word FROM y JOIN w ON w.word = y.cut),
m AS (SELECT e.word, count(*)::BIGINT AS n_near, arg_min(e.near, (-w.n, e.near)) AS best, max(w.n) AS best_n FROM e JOIN w ON w.word = e.near GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form, CASE WHEN best_n >= 5 * w.n THEN best_n END::BIGINT AS form_n FROM w LEFT JOIN m USING (word)),
r AS (SELECT word, word AS root, form AS up FROM f UNION ALL SELECT r.word, r.up, f.form FROM r JOIN f ON f.word = r.up)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.up IS NULL
"""
