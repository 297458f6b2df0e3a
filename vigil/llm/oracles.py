"""SQL of the text operators that SQL can express, over whole tables; results equal those of the operators' queries."""

from __future__ import annotations

from vigil.llm.fingerprint import RUN, WIDTH
from vigil.llm.quality import BOILERPLATE

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

LEAKS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD}, '{_ALNUM}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_FOLD}, '{_ALNUM}') AS w FROM benchmark),
k AS (SELECT DISTINCT least(13, len(w)) AS k FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS g
  FROM i, unnest(range(1, len(w) - least(13, len(w)) + 2)) u(p) WHERE len(w) > 0),
dw AS (SELECT r, k, p, array_to_string(w[p : p + k - 1], ' ') AS g FROM d, k, unnest(range(1, len(w) - k + 2)) u(p)),
hit AS (SELECT r, dw.k, p, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
words AS (SELECT r, count(DISTINCT q) AS n FROM hit, unnest(range(p, p + k)) u(q) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) u(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 185 * k >= 85 * (x.n + y.n)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least_of AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of ON least_of.a = d.doc_id"""

REPEATS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT r, p, md5(array_to_string(w[p : p + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) u(p)),
twice AS (SELECT r, p FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT r, list_sort(list(DISTINCT q)) AS places FROM twice, unnest(range(p, p + 35)) u(q) GROUP BY r),
kept AS (SELECT d.r, list(w[q] ORDER BY q) AS left_words FROM d JOIN gone USING (r), unnest(range(1, len(w) + 1)) u(q) WHERE NOT list_contains(places, q) GROUP BY d.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN places IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string(left_words, ' '), '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)"""


def _bad_line(x: str) -> str:
    words = f"len(regexp_split_to_array(trim({x}, ' '), '{_SPACE}+'))"
    count = lambda pattern: f"len(regexp_extract_all({x}, '{pattern}'))"
    phrases = " OR ".join("contains(lower({}), '{}')".format(x, p.replace("'", "''")) for p in BOILERPLATE)
    return (
        f"({count('[#*$%&|<>]')} * 12 > length({x}) OR {count('[|»•·›]')} >= 2 OR {count(' [>/] ')} >= 2"
        f" OR ({words} <= 3 AND NOT regexp_matches({x}, '[.!?…:;,。！？\"''”’»)\\]]{_SPACE}*$'))"
        f" OR ({count('!!')} >= 2 AND {count('!!')} * 3 >= {words}) OR ({words} >= 5 AND lower({x}) <> {x} AND upper({x}) = {x}) OR ({words} <= 30 AND ({phrases})))"
    )


QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT r, p, md5(array_to_string(w[p : p + 4], ' ')) AS h FROM s, unnest(range(1, len(w) - 3)) u(p)),
twice AS (SELECT r, p FROM g WHERE (r, h) IN (SELECT (r, h) FROM g GROUP BY r, h HAVING count(*) > 1)),
again AS (SELECT r, count(DISTINCT q) AS n FROM twice, unnest(range(p, p + 5)) u(q) GROUP BY r),
c AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  coalesce(list_sum(list_transform(list_filter(list_distinct(lines), lambda x: NOT {_bad_line("x")}), lambda x: length(regexp_replace(x, '{_SPACE}', '', 'g')))), 0) AS fine
  FROM s LEFT JOIN again USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  CAST(word_chars - fine AS BIGINT) AS lost_chars,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND word_chars - fine <= 0.5 * word_chars AS kept FROM c"""


def _crc32(table: str, value: str) -> str:
    """CTEs that make <table>_crc (value, h) of the distinct values of a table: the unsigned crc32 of UTF-8, bit by bit."""
    nibble = "instr('0123456789ABCDEF', substr(x, CAST(2 * (i // 8) + CASE WHEN i % 8 < 4 THEN 2 ELSE 1 END AS BIGINT), 1)) - 1"
    bits = f"list_transform(range(4 * length(x)), lambda i: (({nibble}) >> CAST(i % 4 AS BIGINT)) & 1)"
    step = "lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))"
    return f"""{table}_hex AS (SELECT DISTINCT {value} AS v, hex(encode({value})) AS x FROM {table}),
{table}_crc AS (SELECT v, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), {step}), 4294967295) AS h FROM {table}_hex)"""


def _cells(side: str) -> str:
    x = "CAST('0x' || substr(md5(p), 1, 15) AS BIGINT)"
    return f"""{side}_x AS (SELECT r, {x} AS x FROM e, unnest({side}) u(p)),
{side}_c AS (SELECT *, CAST('0x' || substr(md5(CAST(x AS VARCHAR)), 1, 8) AS BIGINT) AS c, unnest([{", ".join(f"((x >> {20 * t}) & 1048575) % {WIDTH} + {WIDTH * t}" for t in range(3))}]) AS cell FROM {side}_x),
{side}_g AS (SELECT r, cell, count(*) AS n, bit_xor(x) AS x, bit_xor(c) AS c FROM {side}_c GROUP BY r, cell),
{side}_p AS (SELECT r, string_agg(concat_ws('.', cell, n, lower(hex(x)), lower(hex(c))), ';' ORDER BY cell) AS s FROM {side}_g GROUP BY r)"""


_UNITS = f"list_distinct(list_transform(regexp_extract_all({{}}, '(?:[^\\n ]+ *){{{{1,{RUN}}}}}'), lambda p: rtrim(p, ' ')))"
_NEAR = "CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE CAST(2 * len(list_intersect(a, b)) AS DOUBLE) / (2 * (len(a) + len(b)) - 2 * len(list_intersect(a, b))) END"
FINGERPRINTS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT *, length(t) AS n, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nx FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST)),
f AS (SELECT *, left(t, n - n // 2) || left(nx, n // 2) AS et FROM o),
e AS (SELECT *, {_UNITS.format("t")} AS own, {_UNITS.format("et")} AS edited, {_UNITS.format("nx")} AS next FROM f),
{_cells("own")}, {_cells("edited")}
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(et) AS edited_sha256, len(own) || '|' || coalesce(own_p.s, '') AS fingerprint, len(edited) || '|' || coalesce(edited_p.s, '') AS edited_fingerprint,
  CAST({_NEAR.replace("(a", "(own").replace("(b", "(edited").replace(", b)", ", edited)")} AS DOUBLE) AS near_edited, CAST({_NEAR.replace("(a", "(own").replace("(b", "(next").replace(", b)", ", next)")} AS DOUBLE) AS near_next
FROM e LEFT JOIN own_p USING (r) LEFT JOIN edited_p USING (r)"""

TRIE = f"""
WITH t AS (SELECT conv_id, turn, strlen(coalesce(text, '')) AS b, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS giver, list(g ORDER BY turn NULLS FIRST, g) AS g, list(b ORDER BY turn NULLS FIRST, g) AS b FROM t GROUP BY conv_id),
{_crc32("c", "CAST(conv_id AS VARCHAR)")},
k AS (SELECT c.conv_id, h % 9 AS h, c.g, c.b, coalesce(f.g, []) AS fg, coalesce(f.b, []) AS fb FROM c JOIN c_crc ON v = CAST(c.conv_id AS VARCHAR) LEFT JOIN c f ON f.conv_id = c.giver),
z AS (SELECT conv_id, list_concat(fg[1 : h], g[h + 1 : len(g)]) AS g, list_concat(fb[1 : h], b[h + 1 : len(b)]) AS b FROM k),
m AS (SELECT conv_id, i AS depth, array_to_string(g[1 : i], '') AS p, CASE WHEN i = 0 THEN 0 ELSE b[i] END AS b, i = len(g) AS last FROM z, unnest(range(len(g) + 1)) u(i)),
n AS (SELECT depth, p, left(p, 64 * (depth - 1)) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(b) AS b, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM m GROUP BY depth, p),
kids AS (SELECT depth - 1 AS depth, up AS p, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (depth, p)),
sums AS (SELECT i AS depth, left(p, 64 * i) AS p, sum((n_convs - 1) * b) AS saved, count(*) FILTER (n_children = 0) AS n_leaves FROM x, unnest(range(depth + 1)) u(i) GROUP BY ALL)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, y.conv_id AS parent_conv_id, CAST(x.n_convs AS BIGINT) AS n_convs, CAST(x.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, x.ends_sha256
FROM x JOIN sums USING (depth, p) LEFT JOIN n y ON y.depth = x.depth - 1 AND y.p = x.up"""

SPELLING = f"""
WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all({_FOLD}, '[a-zÀ-ÿ]+')) AS r FROM documents),
t AS (SELECT r, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r AS s, count(*) AS k FROM d WHERE length(r) >= 5 GROUP BY ALL),
{_crc32("t", "s")},
w AS (SELECT CASE WHEN h % 97 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, k FROM t JOIN t_crc ON v = s),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS less FROM v, unnest(range(length(word))) u(i)),
near AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.less = b.less AND a.word <> b.word UNION SELECT cut.word, v.word FROM cut JOIN v ON v.word = less UNION SELECT v.word, cut.word FROM cut JOIN v ON v.word = less),
best AS (SELECT near.word, other, n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY n DESC, other) AS rank FROM near JOIN v ON v.word = other),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM v LEFT JOIN best ON best.word = v.word AND rank = 1),
path AS (SELECT word, word AS top, 0 AS steps FROM f UNION ALL SELECT path.word, form, steps + 1 FROM path JOIN f ON f.word = path.top WHERE form IS NOT NULL),
roots AS (SELECT word, arg_max(top, steps) AS root FROM path GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN roots USING (word)"""

ORACLES = {"op3_decontamination": LEAKS, "op7_minhash": NEAR_DUPLICATES, "op8_substring": REPEATS, "op10_quality_rules": QUALITY, "op11_fingerprints": FINGERPRINTS, "op12_prefix_trie": TRIE, "op13_spelling": SPELLING}
