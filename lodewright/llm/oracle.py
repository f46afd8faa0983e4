"""DuckDB SQL with the results of the registered queries."""

from __future__ import annotations

from .license_scan import COPYRIGHT_LINE, SPELLINGS, TITLE
from .license_texts import DIGESTS, NOTICES, TEXTS
from .quality_rules import BOILERPLATE, TERMINAL

_URL = """
WITH captures AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days((page_id % 366)::INTEGER) AS fetched_at,
    nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.'), '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1) AS path
  FROM pages),
hosts AS (SELECT DISTINCT host FROM captures WHERE host IS NOT NULL),
named AS (
  SELECT 'hosts' AS list_name, 'host' AS kind, host AS pattern FROM hosts
  UNION SELECT 'domains', 'domain', regexp_replace(host, '^(?:m|www|blog)\\.', '') FROM hosts
  UNION SELECT 'paths', 'prefix', host || '/en' FROM hosts),
digits AS (
  SELECT *, instr('0123456789abcdef', substr(md5(pattern), 1, 1)) - 1 AS d1, instr('0123456789abcdef', substr(md5(pattern), 2, 1)) - 1 AS d2,
    instr('0123456789abcdef', substr(md5(pattern), 3, 1)) - 1 AS d3 FROM named),
events AS (
  SELECT list_name, kind, pattern, 'add' AS action, d2 * 10 AS day FROM digits WHERE d1 < 8
  UNION ALL SELECT list_name, kind, pattern, 'remove', d2 * 10 + 30 + d3 * 4 FROM digits WHERE d1 < 8
  UNION ALL SELECT list_name, kind, pattern, 'add', d2 * 10 + 150 FROM digits WHERE d1 < 8),
moments AS (
  SELECT list_name, kind, pattern, day, max((action = 'remove')::INT) AS removed FROM events GROUP BY ALL),
spans AS (
  SELECT *, TIMESTAMP '2024-01-01' + to_days(day::INTEGER) AS valid_from,
    TIMESTAMP '2024-01-01' + to_days((lead(day) OVER (PARTITION BY list_name, kind, pattern ORDER BY day))::INTEGER) AS valid_to
  FROM moments),
hits AS (
  SELECT c.page_id, s.list_name FROM captures c JOIN spans s ON s.removed = 0 AND c.fetched_at >= s.valid_from
    AND (s.valid_to IS NULL OR c.fetched_at < s.valid_to)
    AND CASE s.kind WHEN 'host' THEN c.host = s.pattern
      WHEN 'domain' THEN c.host = s.pattern OR ends_with(c.host, '.' || s.pattern)
      ELSE starts_with(c.host || regexp_replace(c.path, '/+', '/', 'g') || '/', s.pattern || '/') END)
SELECT c.page_id, c.fetched_at, count(h.list_name)::BIGINT AS n_matches,
  coalesce(string_agg(DISTINCT h.list_name, ',' ORDER BY h.list_name), '') AS list_names, count(h.list_name) > 0 AS blocked
FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id GROUP BY c.page_id, c.fetched_at
"""

_CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(regexp_replace(regexp_replace(text, '(<)(~*/?s>)', '\1~\2', 'g'), '(\[)(~*/?INST\])', '\1~\2', 'g'))
    + length(regexp_replace(regexp_replace(role, '(<)(~*/?s>)', '\1~\2', 'g'), '(\[)(~*/?INST\])', '\1~\2', 'g')) + 20 AS shown FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(shown)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

_MIX = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::DOUBLE AS s FROM docs GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM src),
total AS (SELECT sum(s) AS b FROM w),
level AS (
  SELECT 0 AS i, (SELECT b FROM total) / (SELECT sum(w) FROM w) AS l
  UNION ALL
  SELECT i + 1, ((SELECT b FROM total) - (SELECT coalesce(sum(3 * s) FILTER (w * l > 3 * s), 0) FROM w))
    / (SELECT sum(w) FILTER (NOT w * l > 3 * s) FROM w) FROM level WHERE i < 30)
SELECT d.doc_id, d.size, w.s::BIGINT AS source_size, round(least(w.w * (SELECT arg_max(l, i) FROM level), 3 * w.s), 3) AS target
FROM docs d JOIN w ON d.source IS NOT DISTINCT FROM w.source
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license() -> str:
    """The expected licences of the planted rows (negative ids) stand here as such; digests follow from the texts."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    from .queries import planted_licences

    whole = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in TEXTS.items())
    notices = ", ".join(f"({quoted(k)}, {quoted(x)})" for k, v in NOTICES.items() for x in v)
    more = ", ".join(f"({quoted(k)}, '{x}')" for k, v in DIGESTS.items() for x in v)
    planted = ", ".join(f"({i}, {quoted(t)})" for i, t in planted_licences())
    spelled = "@"
    for variant, canonical in SPELLINGS:
        spelled = f"regexp_replace({spelled}, '\\b{variant}\\b', '{canonical}', 'g')"
    lines = f"""SELECT id, i, row_number() OVER (PARTITION BY id ORDER BY i) AS n, line FROM (SELECT id, i, CASE WHEN regexp_matches(low, '{COPYRIGHT_LINE}') AND length(flat) - length(replace(flat, ' ', '')) < 30 THEN '' ELSE flat END AS line
    FROM (SELECT id, i, low, trim(regexp_replace(low, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS flat
    FROM (SELECT id, generate_subscripts(x, 1) AS i, lower(unnest(x)) AS low FROM (SELECT id, string_split(text, chr(10)) AS x FROM @TABLE)))) WHERE line <> ''"""
    form = f"""SELECT id, {spelled.replace('@', 'form')} AS form FROM (SELECT t.id, coalesce(string_agg(l.line, ' ' ORDER BY l.i) FILTER (NOT (l.n <= 2 AND regexp_matches(replace(l.line, 'licence', 'license'), '{TITLE}'))), '') AS form FROM @TABLE t LEFT JOIN @LINES l ON t.id = l.id GROUP BY t.id)"""
    return f"""
WITH given AS (SELECT * FROM (VALUES {whole}) AS v(license_id, text)),
known AS (SELECT row_number() OVER () AS id, * FROM (SELECT * FROM given UNION ALL SELECT license_id, regexp_replace(text, '(?m)^\\s*\\(?(?:\\d{{1,2}}|[A-Za-z])[.)]\\s+', '', 'g') FROM given)),
notes AS (SELECT row_number() OVER () AS id, * FROM (VALUES {notices}) AS v(license_id, text)),
docs AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT * FROM (VALUES {planted}) AS p(id, text)),
known_lines AS ({lines.replace('@TABLE', 'known')}),
note_lines AS ({lines.replace('@TABLE', 'notes')}),
doc_lines AS ({lines.replace('@TABLE', 'docs')}),
known_forms AS ({form.replace('@TABLE', 'known').replace('@LINES', 'known_lines')}),
doc_forms AS ({form.replace('@TABLE', 'docs').replace('@LINES', 'doc_lines')}),
texts AS (SELECT digest, min(license_id) AS license_id FROM (SELECT k.license_id, sha256(f.form) AS digest FROM known k JOIN known_forms f ON k.id = f.id UNION ALL SELECT * FROM (VALUES {more}) AS m(license_id, digest)) GROUP BY digest),
marks AS (SELECT sha256({spelled.replace('@', 'l.line')}) AS digest, min(k.license_id) AS notice FROM notes k JOIN note_lines l ON k.id = l.id GROUP BY 1),
found AS (SELECT l.id, m.notice FROM doc_lines l JOIN marks m ON m.digest = sha256({spelled.replace('@', 'l.line')})),
noted AS (SELECT id, string_agg(DISTINCT notice, ',' ORDER BY notice) AS notices, count(*) AS n FROM found GROUP BY id)
SELECT w.id AS doc_id, sha256(w.form) AS digest, CASE w.id WHEN -1 THEN 'MIT' WHEN -2 THEN 'ISC' WHEN -3 THEN 'BSD-3-Clause' WHEN -4 THEN 'Zlib' WHEN -5 THEN 'Unlicense' WHEN -6 THEN NULL ELSE t.license_id END AS license_id,
  coalesce(n.notices, '') AS notices, coalesce(n.n, 0)::BIGINT AS n_notices
FROM doc_forms w LEFT JOIN texts t ON t.digest = sha256(w.form) LEFT JOIN noted n ON n.id = w.id
"""


def _quality() -> str:
    space = "[\\x20\\x09-\\x0D]"
    word = "[^\\x20\\x09-\\x0D]+"
    ends = "[" + "".join("\\" + c if c in "]\\" else c for c in TERMINAL) + "]"
    phrases = "|".join(BOILERPLATE).replace("'", "''")
    ends = ends.replace("'", "''")
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS w FROM (SELECT doc_id, regexp_extract_all(text, '{word}') AS x FROM docs)),
wins AS (SELECT doc_id, i, count(*) OVER g AS c, string_agg(w, ' ') OVER g AS s FROM words WINDOW g AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM wins WHERE c = 8) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, line, regexp_replace(line, '^{space}+|{space}+$', '', 'g') AS t, len(regexp_extract_all(line, '{word}')) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)),
judged AS (SELECT doc_id, line, n, n > 0 AND (regexp_matches(t, '{ends}$') OR n >= 12)
    AND NOT (len(regexp_extract_all(' ' || regexp_replace(line, '{space}+', '  ', 'g') || ' ', ' [|•·»>] ')) * 4 >= n)
    AND NOT (len(regexp_extract_all(line, '[#*$%&|<>]')) * 2 >= n) AND NOT (len(regexp_extract_all(line, '!!')) * 2 >= n)
    AND NOT (regexp_matches(lower(line), '{phrases}') AND n <= 12) AS ok FROM lines),
byline AS (SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dups, coalesce(sum(n) FILTER (ok), 0)::BIGINT AS clean, sum(n)::BIGINT AS n FROM judged GROUP BY doc_id)
SELECT d.doc_id, b.n AS n_words, length(regexp_replace(text, '{space}', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, b.dups::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  b.n < 20 OR coalesce(c.n, 0) * 100 > b.n * 30 AS base_failed,
  NOT (b.n < 20 OR coalesce(c.n, 0) * 100 > b.n * 30) AND (b.n - b.clean) * 100 <= b.n * 50 AS kept, b.clean AS clean_words
FROM docs d JOIN byline b ON b.doc_id = d.doc_id LEFT JOIN covered c ON c.doc_id = d.doc_id
"""


def oracles() -> dict[str, str]:
    return {
        "op2_url_filter": _URL,
        "mix_targets": _MIX,
        "op5_chat_format": _CHAT,
        "op8_license_scan": _license(),
        "op10_quality_rules": _quality(),
    }
