"""DuckDB statements of the registered queries, written from the definitions and not from the Spark code."""

from __future__ import annotations

from veilframe.llm.licenses import EXPRESSION, MENTION, identifiers, templates
from veilframe.llm.quality_rules import RULES, STOP_WORDS

_SPACE = "[\\x20\\x09-\\x0D]+"


def _quality_rules() -> str:
    stop = ", ".join("'" + w + "'" for w in sorted(set(" ".join(STOP_WORDS.values()).split())))
    passed = " AND ".join(
        f"{r.statistic} {op} {v}" for r in RULES for op, v in ((">=", r.least), ("<=", r.most)) if v is not None)
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{_SPACE}', '', 'g') <> '') AS l
  FROM documents),
places AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) AS window5
  FROM d WHERE len(w) >= 5),
keyed AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, window5) AS n FROM places),
hit AS (SELECT DISTINCT doc_id, unnest([i, i+1, i+2, i+3, i+4]) AS p FROM keyed WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY 1),
s AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(w, lambda x: lower(regexp_replace(x, '[.,!?;:]', '', 'g')) IN ({stop}))) AS n_stop,
         len(list_filter(w, lambda x: length(x) >= 2 AND x = upper(x) AND x <> lower(x))) AS n_shouted,
         len(list_filter(l, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS n_ellipsis
  FROM d LEFT JOIN rep USING (doc_id)),
r AS (
  SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_word_ratio,
         coalesce(n_stop / nullif(n_words, 0), 0) AS stop_word_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS duplicate_line_ratio,
         coalesce(n_shouted / nullif(n_words, 0), 0) AS shouted_ratio, coalesce(n_ellipsis / nullif(n_lines, 0), 0) AS ellipsis_line_ratio
  FROM s),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND {passed} AS kept
FROM b"""


def _decontaminate() -> str:
    return """
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(lower_ascii, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)),
dw AS (SELECT doc_id, regexp_extract_all(lower_ascii, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
       FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
windows AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i+size-1], ' ') AS key
  FROM (SELECT item, w, least(10, len(w)) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i,
         unnest(list_transform(range(1, len(w) - size + 2), lambda k: array_to_string(w[k:k+size-1], ' '))) AS key
  FROM dw, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, item, i, p.size FROM places p JOIN windows USING (size, key)),
covered AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _line_dedup() -> str:
    """For unique ids: the order of first occurrences then is (id, chunk)."""
    return """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
           FROM documents WHERE text <> ''),
h AS (SELECT *, CAST('0x' || md5(line)[1:8] AS BIGINT) AS here FROM l),
e AS (SELECT *, (31 * coalesce(lag(here) OVER (PARTITION BY doc_id ORDER BY i), 0) + here) % 3 = 0 AS ends FROM h),
n AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk,
             len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS words FROM e),
c AS (SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS n_lines,
             count(*) FILTER (words > 0) >= 2 OR sum(words) >= 50 AS counted FROM n GROUP BY ALL),
m AS (SELECT *, counted AND row_number() OVER (PARTITION BY counted, body ORDER BY doc_id, chunk) > 1 AS gone FROM c),
d AS (SELECT doc_id, string_agg(body, chr(10) ORDER BY chunk) FILTER (NOT gone) AS body, count(*) FILTER (gone) AS n_chunks, coalesce(sum(n_lines) FILTER (gone), 0) AS n_lines
      FROM m GROUP BY 1)
SELECT doc_id, CASE WHEN d.n_chunks > 0 THEN coalesce(body, '') ELSE text END AS text,
       CAST(coalesce(n_chunks, 0) AS BIGINT) AS n_chunks_removed, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines_removed
FROM documents LEFT JOIN d USING (doc_id)"""


def _chat_format() -> str:
    """Digests straight from the rows; formatted size from windows of 1,024 tokens with 128 of history."""
    escape = lambda c: f"regexp_replace(regexp_replace({c}, '<(\\\\*/?s>)', '<\\\\\\1', 'g'), '\\[(\\\\*/?INST\\])', '[\\\\\\1', 'g')"
    return f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, CAST(ceil(length(text) / 4) AS BIGINT) + 4 AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
         23 + length({escape("role")}) + length({escape("text")}) AS chars
  FROM rows_),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM t),
f AS (
  SELECT *, first_value(role) OVER c = 'system' AS sys, first_value(chars) OVER c AS sys_chars, CASE WHEN first_value(role) OVER c = 'system' THEN first_value(tokens) OVER c ELSE 0 END AS sys_tokens
  FROM u WINDOW c AS (PARTITION BY conv_id ORDER BY place)),
r AS (SELECT *, greatest(896 - sys_tokens, 0) AS room, tokens > greatest(896 - sys_tokens, 0) // 3 AS alone FROM f),
s AS (
  SELECT *, CASE WHEN alone THEN least(128, greatest(1024 - sys_tokens - tokens, 0)) ELSE 128 END AS spare, greatest(room - room // 3, 1) AS stride,
         sum(CASE WHEN alone THEN 0 ELSE tokens END) OVER c AS short, sum(CAST(alone AS INT)) OVER c AS run
  FROM r WINDOW c AS (PARTITION BY conv_id ORDER BY place)),
w AS (SELECT *, CASE WHEN alone THEN -1 ELSE (short - min(short) OVER (PARTITION BY conv_id, run) - 1 + CASE WHEN run = 0 THEN min(short) OVER (PARTITION BY conv_id, run) ELSE 0 END) // stride END AS slot FROM s),
o AS (SELECT *, coalesce(lag(slot) OVER c <> slot OR lag(run) OVER c <> run, false) AS opens FROM w WINDOW c AS (PARTITION BY conv_id ORDER BY place)),
h AS (
  SELECT *, lead(opens, 1) OVER c AND lead(upto - tokens, 1) OVER c - upto + tokens <= lead(spare, 1) OVER c AND (place > 1 OR NOT sys) AS h1,
            lead(opens, 2) OVER c AND lead(upto - tokens, 2) OVER c - upto + tokens <= lead(spare, 2) OVER c AND (place > 1 OR NOT sys) AS h2,
            lead(opens, 3) OVER c AND lead(upto - tokens, 3) OVER c - upto + tokens <= lead(spare, 3) OVER c AND (place > 1 OR NOT sys) AS h3
  FROM o WINDOW c AS (PARTITION BY conv_id ORDER BY place))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars * (1 + CAST(coalesce(h1, false) AS INT) + CAST(coalesce(h2, false) AS INT) + CAST(coalesce(h3, false) AS INT))
                + CASE WHEN opens AND sys THEN sys_chars ELSE 0 END) AS BIGINT) AS formatted_chars
FROM h GROUP BY conv_id"""


def _license_scan() -> str:
    """Without licence files by name: the stand-in paths end in numbers."""
    listed = lambda x: "[" + ", ".join(f"'{w}'" for w in x) + "]::VARCHAR[]"
    rows = ", ".join(f"({i}, '{a}', '{b}', {least}::DOUBLE, {rank}, {listed(must)}, {listed(never)})" for i, (a, b, least, rank, must, never) in enumerate(templates()))
    mention, known = MENTION, ", ".join(f"'{k}': '{v}'" for k, v in identifiers().items())
    marks, order = r"^[ \t\r]*(//+|#+|/\*+|\*+/?|--+|;+|%+|<!--+)?[ \t]*", "{'named': license <> 'Proprietary', 'rank': rank, 'score': score, 'license': license}"
    return f"""
WITH t(template, license, statement, least, rank, must, never) AS (VALUES {rows}),
speaking AS (SELECT doc_id, text FROM documents WHERE regexp_matches(text, '{mention}')),
p AS (SELECT doc_id, 0 AS kind, trim(unnest(string_split(replace(text, chr(10), '. '), '. ')), ' ') AS statement FROM speaking UNION ALL
      SELECT doc_id, 1, trim(replace(unnest(string_split_regex(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '{marks}', '')), chr(10)), '\n\n+')), chr(10), ' '), ' ') FROM speaking),
said AS (SELECT doc_id, kind, statement, count(*) AS n FROM p WHERE regexp_matches(statement, '{mention}') GROUP BY ALL),
spdx AS (SELECT statement, regexp_extract(statement, '{EXPRESSION}', 1) AS e FROM (SELECT DISTINCT statement FROM said)),
written AS (SELECT statement, list_transform(regexp_split_to_array(e, '[ \t]+'), lambda x: MAP {{{known}}}[x]) AS ids FROM spdx WHERE e <> ''),
every AS (SELECT statement, -1 AS template, '' AS license FROM spdx WHERE e = '' UNION ALL SELECT statement, template, license FROM t),
tf AS (SELECT statement, template, license, term, count(*) AS tf FROM (SELECT *, unnest(regexp_extract_all(lower(statement), '[a-z0-9]+')) AS term FROM every) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM every)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
w AS (SELECT statement, template, license, term, tf * idf AS w FROM tf JOIN idf USING (term)),
norm AS (SELECT statement, template, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
dot AS (SELECT a.statement, b.statement AS other, b.template, b.license, sum(a.w * b.w) AS dot FROM w a JOIN w b USING (term) WHERE a.template = -1 AND b.template >= 0 GROUP BY ALL),
cos AS (SELECT dot.statement, dot.template, license, round(dot / (x.norm * y.norm), 6) AS score FROM dot JOIN norm x ON x.statement = dot.statement AND x.template = -1 JOIN norm y ON y.template = dot.template),
agree AS (SELECT cos.statement, cos.license, score, rank FROM cos JOIN t USING (template) WHERE score >= least
          AND list_has_all(regexp_extract_all(lower(cos.statement), '[a-z0-9]+'), must) AND NOT list_has_any(regexp_extract_all(lower(cos.statement), '[a-z0-9]+'), never)
          UNION ALL SELECT statement, array_to_string(ids, ' '), 1.0, 0 FROM written WHERE len(list_filter(ids, lambda x: x IS NULL)) = 0),
best AS (SELECT statement, max({order}) AS b FROM agree GROUP BY 1),
own AS (SELECT doc_id, max(b) AS b, greatest(coalesce(sum(k) FILTER (kind = 0), 0), coalesce(sum(k) FILTER (kind = 1), 0)) AS stated
        FROM (SELECT *, n * len(regexp_extract_all(lower(statement), '[a-z0-9]+')) AS k FROM said) JOIN best USING (statement) GROUP BY 1),
m AS (SELECT doc_id, source || '/' || lang AS dir, b.license AS license, b.score AS score, coalesce(stated >= 0.9 * len(regexp_extract_all(lower(text), '[a-z0-9]+')), false) AS whole
      FROM documents LEFT JOIN own USING (doc_id)),
given AS (SELECT dir, max({{'score': score, 'license': license}}).license AS given FROM m WHERE whole AND license IS NOT NULL GROUP BY 1)
SELECT doc_id, license, score, coalesce(license, given) AS effective_license, CASE WHEN license IS NULL AND given IS NOT NULL THEN dir END AS inherited_from
FROM m LEFT JOIN given USING (dir)"""


def _url_filters() -> str:
    return """
WITH r(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
after AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS t FROM pages),
cut AS (SELECT page_id, regexp_extract(t, '^[^/?#]*') AS h, regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM after),
u AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut),
best AS (
  SELECT page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(verdict, length(r.h || r.p)) AS verdict
  FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(path, p) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (page_id)"""


def _conversation_trie() -> str:
    """Nodes as lists of turns; every node's own figures are added to each of its beginnings."""
    return """
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
rows_ AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM conversations),
ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations), crc),
turns AS (
  SELECT ids.conv_id, n, role, text FROM ids JOIN rows_ ON rows_.conv_id = base AND n <= h
  UNION ALL SELECT conv_id, n, role, text FROM ids JOIN rows_ USING (conv_id) WHERE n > h),
seq AS (SELECT conv_id, coalesce(list({'role': role, 'text': text} ORDER BY n) FILTER (n IS NOT NULL), []) AS s FROM ids LEFT JOIN turns USING (conv_id) GROUP BY 1),
m AS (SELECT conv_id, len(s) AS last, d, s[1:d] AS node FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM seq)),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last = d), '')) AS ends_sha256
  FROM m GROUP BY 1, 2),
kids AS (SELECT node[1:d-1] AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
own AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN nodes.d > 0 THEN length(node[-1].text) ELSE 0 END AS saved FROM nodes LEFT JOIN kids USING (node, d)),
up AS (SELECT node[1:i] AS node, i AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
       FROM (SELECT *, unnest(range(d + 1)) AS i FROM own) GROUP BY 1, 2)
SELECT CAST(own.conv_id AS BIGINT) AS conv_id, CAST(d AS BIGINT) AS depth, CAST(p.conv_id AS BIGINT) AS parent_conv_id, CAST(own.n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, own.ends_sha256
FROM own JOIN up USING (node, d) LEFT JOIN (SELECT node, d + 1 AS d, conv_id FROM nodes) p ON own.d = p.d AND own.node[1:own.d-1] = p.node"""


SQL = {
    "op11_url_filters": _url_filters(),
    "op13_conversation_trie": _conversation_trie(),
    "op5_license_scan": _license_scan(),
    "op1_quality_rules": _quality_rules(),
    "op7_decontaminate": _decontaminate(),
    "op9_chat_format": _chat_format(),
    "op10_line_dedup": _line_dedup(),
}
