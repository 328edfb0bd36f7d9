"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from gaugeflow.llm import chat

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Words of letters and digits, all beyond ASCII included, and words between ASCII white space.
_ALNUM = rf"regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

#: Links are pairs that share shingles; components are what a row reaches by them.
NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, {_SPACED} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i + 1 : i + least(3, len(w))], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id, n.n"""

_WINDOWS = "(SELECT {id}, i, least(13, len(w)) AS k, hash(array_to_string(w[i + 1 : i + least(13, len(w))], ' ')) AS h FROM (SELECT {id}, w, unnest(range(greatest(1, len(w) - 12))) AS i FROM {source} WHERE len(w) > 0))"
CONTAMINATION = f"""WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, h FROM {_WINDOWS.format(id="item_id", source="b")}),
dw AS (SELECT doc_id, k, i, hash(array_to_string(w[i + 1 : i + k], ' ')) AS h FROM (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, i, k FROM dw JOIN bw USING (k, h)),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

#: Runs of starts of repeated strings, then the bytes between what they cover.
COLUMN_DEDUP = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents), n AS (SELECT doc_id, x, octet_length(x) AS n FROM d),
w AS (SELECT doc_id, i, hash(x[i + 1 : i + 400]) AS h FROM (SELECT doc_id, x, unnest(range(n - 399)) AS i FROM n WHERE n >= 400)),
s AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM s)),
r AS (SELECT doc_id, g, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY doc_id, g),
c AS (SELECT doc_id, g, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY g), 0) AS a, a AS b FROM r UNION ALL SELECT doc_id, max(g) + 1, max(b), NULL FROM r GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(CASE WHEN coalesce(b, n) > a THEN hex(x[a + 1 : coalesce(b, n)]) ELSE '' END, '' ORDER BY g) AS x FROM c JOIN n USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans FROM r GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(CASE WHEN k.doc_id IS NULL THEN n.x ELSE unhex(k.x) END) AS kept_sha256 FROM n LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)"""

_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')"
CHAT = f"""WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
 sum({len(chat.START) + len(chat.BODY) + len(chat.END)} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS formatted FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars FROM g"""

#: crc32 by a table of 256 entries made from its polynomial; words meet by what is left without one letter.
SPELLING = r"""WITH RECURSIVE t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
r AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents) WHERE length(w) >= 5 GROUP BY ALL),
b AS (SELECT w, n, flatten(list_transform(string_split(concat(doc_id, ':', w), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)) AS b FROM r),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(b, lambda x: CAST(x AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, t),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN concat(left(w, h % length(w)), substr(w, h % length(w) + 2)) ELSE w END AS word FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS (SELECT word, i, concat(left(word, i), substr(word, i + 2)) AS less FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
s AS (SELECT x.word AS a, y.word AS b FROM d x JOIN d y ON x.less = y.less AND x.i = y.i AND x.word <> y.word UNION SELECT d.word, v.word FROM d JOIN v ON d.less = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.less = v.word),
f AS (SELECT a, count(*) AS n_near, arg_min(b, (-n, b)) AS form, max(n) AS form_n FROM s JOIN v ON v.word = b GROUP BY a),
o AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM v LEFT JOIN f ON f.a = word),
p AS (SELECT word, word AS cur, 0 AS k FROM o UNION ALL SELECT p.word, o.form, k + 1 FROM p JOIN o ON o.word = p.cur WHERE o.form IS NOT NULL)
SELECT o.word, form, root, n, n_near, form_n FROM o JOIN (SELECT word, arg_max(cur, k) AS root FROM p GROUP BY word) USING (word)"""

ORACLE_SQL = {"op4_ngram_join": NGRAM_JOIN, "op5_winnow_decontaminate": CONTAMINATION, "op7_column_dedup": COLUMN_DEDUP, "op10_chat_format": CHAT, "op11_spelling_variants": SPELLING}
