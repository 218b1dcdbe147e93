"""DuckDB SQL for the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP9 = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN repeated USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS x
  FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
), hits AS (SELECT doc_id, i, n, item FROM places JOIN windows USING (n, x)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits WHERE item IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

_ESCAPED = "replace(replace(replace(replace({0}, '\\', '\\\\'), '###', '\\###'), '</part>', '\\</part>'), '</turn>', '\\</turn>')"

OP1 = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), o AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w IS NOT DISTINCT FROM role AS goes_on
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_ESCAPED.format("text")}) + CASE WHEN goes_on THEN 9 ELSE 6 + length(replace({_ESCAPED.format("role")}, ':', '\\c')) + 9 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""


def _secret_kind(place: int, kind: str, regex: str, group: int, least: int) -> str:
    regex = regex.replace("'", "''")
    return f"""SELECT doc_id, {place} AS place, '{kind}' AS kind, i, m[i] AS hit, g[i] AS part, gaps, m
  FROM (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, m, g, gaps FROM (
    SELECT doc_id, regexp_extract_all(t, '{regex}') AS m, regexp_extract_all(t, '{regex}', {group}) AS g, regexp_split_to_array(t, '{regex}') AS gaps
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))) WHERE length(g[i]) >= {least}"""


def op4(rules) -> str:
    found = "\n  UNION ALL ".join(_secret_kind(k, r.kind, r.regex, r.group, r.least) for k, r in enumerate(rules))
    base = [r.kind for r in rules if r.base]
    among = ", ".join(f"'{k}'" for k in base)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in base)
    return f"""
WITH found AS ({found}),
placed AS (
  SELECT doc_id, place, kind, hit,
         CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM found
), spans AS (SELECT doc_id, place, kind, start, kind || ':' || start || ':' || (start + length(hit)) AS span FROM placed),
per AS (
  SELECT doc_id, {counts},
         string_agg(span, ',' ORDER BY start, place) FILTER (WHERE kind IN ({among})) AS base, string_agg(span, ',' ORDER BY start, place) AS spans
  FROM spans GROUP BY doc_id
)
SELECT documents.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN per USING (doc_id)
"""
