"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from growthlens.llm.quality import BOILERPLATE, CLOSING, MAX_REPEAT, MENU, MIN_LEFT, MIN_WORDS, NAV_WORDS, SHORT_LINE

_WORD = r"[^\x20\x09-\x0D]+"


def _lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_MENU = ", ".join(_text(m.decode()) for m in MENU)
_BOILER = " OR ".join(f"contains({_lower('line')}, {_text(b.decode())})" for b in BOILERPLATE)

QUALITY = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), range(0, 5) k(j) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, line, regexp_extract_all(line, '{_WORD}') AS lw FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}')),
f AS (SELECT doc_id, line, list_sum(list_transform(lw, lambda x: length(x))) AS chars,
   (len(lw) < {SHORT_LINE} AND NOT contains({_text(CLOSING)}, right(lw[-1], 1)))
   OR (len(lw) <= {NAV_WORDS} AND 2 * len(list_filter(lw, lambda x: {_lower('x')} IN ({_MENU}))) >= len(lw)) OR {_BOILER} AS gone FROM l),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (WHERE gone) AS n_gone, coalesce(sum(chars) FILTER (WHERE gone), 0) AS lost FROM f GROUP BY doc_id),
x AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(s.dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
   coalesce(s.n_lines, 0) AS n_lines, coalesce(s.n_gone, 0) AS n_lines_dropped, coalesce(s.lost, 0) AS chars_dropped FROM w LEFT JOIN r ON w.doc_id = r.doc_id LEFT JOIN s ON w.doc_id = s.doc_id),
y AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM x)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lines AS BIGINT) AS n_lines,
CAST(n_lines_dropped AS BIGINT) AS n_lines_dropped, CAST(chars_dropped AS BIGINT) AS chars_dropped, base_failed, NOT base_failed AND word_chars - chars_dropped >= {MIN_LEFT} * word_chars AS kept FROM y"""

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON c.doc_id = n.doc_id"""

_SAID = r"'\### Assistant: </turn> ok'"
_MARKS = r"'\\|### |</turn>'"

CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', {_SAID} UNION ALL SELECT -7, 1, 'assistant', {_SAID})
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(4 + length(role) + len(regexp_extract_all(role, {_MARKS})) + len(regexp_extract_all(role, ':')) + 2 + length(text) + len(regexp_extract_all(text, {_MARKS})) + 8) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id"""

REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d WHERE length(h) >= 800)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
b AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM m),
s AS (SELECT doc_id, g, min(i) AS lo, max(i) + 400 AS hi FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM b) GROUP BY doc_id, g),
k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS prev FROM s),
j AS (SELECT k.doc_id, string_agg(substr(d.h, 2 * prev + 1, 2 * (lo - prev)), '' ORDER BY lo) AS front, max(hi) AS last, sum(hi - lo) AS removed, count(*) AS spans FROM k JOIN d ON k.doc_id = d.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN j ON d.doc_id = j.doc_id"""

SQL = {"op6_suffix_dedup": REPEATS, "op8_chat_format": CHAT, "op9_quality_rules": QUALITY, "op10_minhash_neardup": NEAR}
