"""DuckDB texts that the registered queries must agree with, where SQL can express them."""

from __future__ import annotations

from millrace.llm import chat_format, near_dup, secret_scan

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans_of(number: int, rule: secret_scan.Rule) -> str:
    """A rule's matches: their texts between the texts around them give the positions."""
    pattern = _quoted(("(?i)" if rule.any_case else "") + rule.pattern)
    return f"""
  SELECT doc_id, {number} AS nth, '{rule.kind}' AS kind, s, s + length(m[i]) AS e FROM (
    SELECT doc_id, m, g, i, CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
    FROM (SELECT doc_id, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, {pattern}) AS m, regexp_extract_all(text, {pattern}, {rule.group}) AS g, string_split_regex(text, {pattern}) AS p FROM documents)))
  WHERE length(g[i]) >= {rule.least}"""


SECRETS = f"""
WITH hits AS ({" UNION ALL ".join(_spans_of(i, r) for i, r in enumerate(secret_scan.RULES))}),
found AS (
  SELECT doc_id, count(*) FILTER (nth = 0) AS n_assign, count(*) FILTER (nth = 1) AS n_access, count(*) FILTER (nth = 2) AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth) FILTER (nth < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth) AS spans
  FROM hits GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN found USING (doc_id)
"""


def _marks() -> str:
    """Characters of the marks around a turn, by role."""
    template = chat_format.INSTRUCT
    cases = " ".join(f"WHEN '{r}' THEN {len(t.before) + len(t.after)}" for r, t in template.roles.items())
    other = len(template.other.before.replace("{role}", "")) + len(template.other.after)
    return f"CASE role {cases} ELSE {other} + {_escaped('role')} END"


def _escaped(column: str) -> str:
    """Characters of a text once escaped: a backslash becomes two, a control string three."""
    controls = "|".join(c.replace("[", r"\[").replace("]", r"\]") for c in sorted(chat_format.INSTRUCT.controls, key=len, reverse=True))
    return rf"length(regexp_replace(replace({column}, chr(92), chr(92) || chr(92)), '{controls}', '###', 'g'))"


CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_marks()} + {_escaped("text")}) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text), 's?(ua)+') AS valid
FROM turns GROUP BY conv_id
"""

NEAR = f"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS} AS w FROM documents),
sets AS (SELECT doc_id, array_to_string(w[i:i + {near_dup.WORDS - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {near_dup.WORDS - 1}) + 1)) AS i FROM words WHERE len(w) > 0) GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a, b, k = x.n AND k = y.n AS same FROM (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS k FROM sets l JOIN sets r USING (s) WHERE l.doc_id <> r.doc_id GROUP BY ALL)
  JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE k >= {near_dup.THRESHOLD}e0 * (x.n + y.n - k) - 1e-9),
reach(node, seen) AS (SELECT DISTINCT a, a FROM links UNION SELECT node, b FROM reach JOIN links ON seen = a),
roots AS (SELECT node AS doc_id, min(seen) AS class_id FROM reach GROUP BY node),
counts AS (SELECT a AS doc_id, count(*) AS n_links, min(b) FILTER (same) AS copy FROM links GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links, least(doc_id, coalesce(copy, doc_id)) AS copy_id
FROM documents LEFT JOIN roots USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

REPEATS = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY s) > 1),
covered AS (SELECT DISTINCT doc_id, i + j AS i FROM repeated, range(0, 35) t(j)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

URLS = r"""
WITH parsed AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(action, rhost, rpath) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
best AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS action
  FROM parsed JOIN rules ON ends_with('.' || host, '.' || rhost) AND starts_with(path, rpath) GROUP BY page_id),
named AS (
  SELECT *, regexp_replace(regexp_replace(host, ':\d*$', ''), '^www\.', '') || '/' || regexp_replace(regexp_replace(path, '^/+', ''), '(/|\.html?|/index\.html?)$', '') AS entry
  FROM parsed),
listed AS (SELECT DISTINCT entry, true AS hit FROM named WHERE regexp_matches(host, '(^|\.)(spam-|ads-|cheap-pills|casino-win)') OR regexp_matches(url, '[?&]utm_source='))
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.action, CASE WHEN l.hit THEN 'block' ELSE 'allow' END) AS verdict
FROM named p LEFT JOIN best b USING (page_id) LEFT JOIN listed l USING (entry)
"""
