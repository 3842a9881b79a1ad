"""SQL of the archive frames and of common expressions, for the oracle."""

from __future__ import annotations

from quillmill.functions import constants as C
from quillmill.functions.patterns import for_re2


def flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '{C.SPACES}', ' ', 'g'))"


def short(x: str, n: int) -> str:
    c = flat(f"coalesce({x}, '')")
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE substring({c}, 1, {n - 3}) || '...' END"


def trim(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substring({x}, 1, {n}) || chr(10) || '...[truncated]' ELSE {x} END"


def ends(x: str, head: int, tail: int) -> str:
    return f"substring({x}, 1, {head}) || chr(10) || '[... ' || greatest(0, length({x}) - {head} - {tail}) || ' chars omitted from search index ...]' || chr(10) || right({x}, {tail})"


PROBLEM = "regexp_matches(lower(coalesce(text_content, '')), '" + "|".join(C.PROBLEM_WORDS) + "')"
IS_USER = "(coalesce(sub_type = 'user_message', false) OR coalesce(role = 'user', false))"
IS_ASSISTANT = "(coalesce(role = 'assistant', false) OR coalesce(sub_type IN ('message', 'reasoning'), false))"
HAS_TEXT = "coalesce(text_content, '') <> ''"
CHUNK_TEXT = f"({HAS_TEXT} AND top_type NOT IN ('session_meta', 'turn_context') AND coalesce(sub_type NOT IN ('session_meta', 'turn_context'), true))"

CHAT = """
chat0 AS (
  SELECT conv_id * 1000 + turn AS event_id, 'conv-' || conv_id AS session_id,
         CASE role WHEN 'user' THEN 'event_msg' WHEN 'assistant' THEN 'response_item' ELSE 'turn_context' END AS top_type,
         CASE role WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN 'message' END AS sub_type,
         role, text AS text_content, turn + 1 AS line_no
  FROM conversations),
chat AS (
  SELECT * EXCLUDE (opens), CAST(sum(opens) OVER (PARTITION BY session_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn_index
  FROM (SELECT *, CASE WHEN coalesce(sub_type = 'user_message', false) AND coalesce(last_value(CASE WHEN sub_type = 'user_message' THEN coalesce(text_content, '') END IGNORE NULLS)
               OVER (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') <> '' THEN 1 ELSE 0 END AS opens FROM chat0)),
sess AS (
  SELECT 'conv-' || conv_id AS session_id, 'proj-' || (conv_id % 7) AS cwd,
         lpad(CAST(min(turn) AS VARCHAR), 6, '0') AS first_seen_at, lpad(CAST(max(turn) AS VARCHAR), 6, '0') AS updated_at
  FROM conversations GROUP BY conv_id)"""

DOCS = """
dev AS (
  SELECT doc_id AS event_id, lang AS session_id, CASE WHEN doc_id % 4 < 2 THEN 'response_item' ELSE 'event_msg' END AS top_type,
         CASE doc_id % 4 WHEN 0 THEN 'function_call_output' WHEN 1 THEN 'message' WHEN 2 THEN 'agent_message' ELSE 'user_message' END AS sub_type,
         CASE WHEN doc_id % 4 = 1 THEN 'assistant' END AS role, text AS text_content
  FROM documents)"""

INDEXED = f"""{DOCS},
flagged AS (
  SELECT *, coalesce(text_content, '') AS t, {flat("coalesce(text_content, '')")} = '' AS blank,
         contains(coalesce(text_content, ''), 'data:image/') OR contains(coalesce(text_content, ''), ';base64,') AS bin, sub_type = 'function_call_output' AS tool FROM dev),
pol AS (
  SELECT *, CASE WHEN blank THEN 'skip_empty' WHEN bin THEN 'metadata_only' WHEN tool AND length(t) > 2000 OR NOT tool AND length(t) > 5000 THEN 'truncated' ELSE 'full' END AS index_policy,
         CASE WHEN blank THEN 'noise' WHEN bin OR tool THEN 'evidence' ELSE 'core' END AS value_level,
         CASE WHEN blank THEN NULL WHEN bin THEN '[binary or image evidence omitted from search index] type=' || top_type || '/' || sub_type
              WHEN tool AND length(t) > 2000 THEN {ends("t", 1200, 800)} WHEN NOT tool AND length(t) > 5000 THEN {ends("t", 2500, 1500)} ELSE t END AS indexed_text
  FROM flagged)"""

PAGES = """
pev AS (
  SELECT page_id AS event_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS session_id, 'response_item' AS top_type, 'function_call_output' AS sub_type,
         'fetch' AS tool_name, url AS file_path, 'Failed to read out/p' || page_id || '.json; see notes-' || page_id || '.md' AS text_content
  FROM pages)"""

CALLS = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no FROM events),
calls AS (
  SELECT CAST(user_id AS VARCHAR) AS path, line_no, CASE event_type WHEN 'click' THEN 'call' ELSE 'output' END AS kind,
         user_id || ':' || regexp_extract(props, '"k": ?([0-9]+)', 1) AS call_id
  FROM numbered WHERE event_type IN ('click', 'purchase')),
counted AS (
  SELECT *, count(*) FILTER (WHERE kind = 'call') OVER w AS calls_before, count(*) FILTER (WHERE kind = 'output') OVER w AS outputs_before
  FROM calls WINDOW w AS (PARTITION BY path, call_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
warn AS (
  SELECT path, line_no, CASE WHEN calls_before = 0 THEN 'orphan_function_call_output' ELSE 'duplicate_function_call_output' END AS code, call_id
  FROM counted WHERE kind = 'output' AND (calls_before = 0 OR outputs_before > 0)
  UNION ALL
  SELECT path, max(line_no) FILTER (WHERE kind = 'call'), 'missing_function_call_output', call_id
  FROM calls GROUP BY path, call_id HAVING count(*) FILTER (WHERE kind = 'output') = 0)"""

POSTINGS = f"""
words AS (SELECT doc_id AS event_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{C.TERM}')) AS term, generate_subscripts(regexp_extract_all(lower(coalesce(text, '')), '{C.TERM}'), 1) - 1 AS pos FROM documents),
post AS (SELECT term, event_id, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM words GROUP BY term, event_id),
lens AS (SELECT event_id, CAST(sum(tf) AS BIGINT) AS length FROM post GROUP BY event_id)"""


def bm25(terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""
hit AS (SELECT * FROM post WHERE term IN ({listed})),
tot AS (SELECT count(*) AS n, avg(length) AS mean FROM lens),
dfs AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
scored AS (
  SELECT event_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * (1.2::DOUBLE + 1) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score
  FROM hit JOIN dfs USING (term) JOIN lens USING (event_id) CROSS JOIN tot GROUP BY event_id)"""


def findings() -> str:
    """Every match of every detector in documents and pages."""
    parts = []
    for kind, severity, pattern in C.DETECTORS:
        spelled, group = for_re2(pattern)
        all_of = f"regexp_extract_all(t, '{quoted(spelled)}', {group})"
        parts.append(f"SELECT id, '{kind}' AS kind, '{severity}' AS severity, CAST(generate_subscripts({all_of}, 1) - 1 AS BIGINT) AS n, unnest({all_of}) AS match FROM texts")
    return f"texts AS (SELECT 'doc-' || doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'page-' || page_id, coalesce(html, '') FROM pages), found AS ({' UNION ALL '.join(parts)})"


def offsets() -> str:
    """Every match with its place in the text: the lengths of what lies before it, matches and the pieces between them."""
    parts = []
    for kind, severity, pattern in C.DETECTORS:
        spelled, group = for_re2(pattern)
        p = f"'{quoted(spelled)}'"
        parts.append(f"SELECT id, '{kind}' AS kind, '{severity}' AS severity, string_split_regex(t, {p}) AS pieces, regexp_extract_all(t, {p}, 0) AS whole, regexp_extract_all(t, {p}, {group}) AS found FROM texts")
    return f"""cut AS ({' UNION ALL '.join(parts)}),
each AS (SELECT *, unnest(range(len(found))) AS n FROM cut),
placed AS (SELECT id, kind, severity, n, found[n + 1] AS match, CAST(list_sum(list_transform(pieces[1:n + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:n], lambda x: length(x))), 0) + length(whole[n + 1]) - length(found[n + 1]) AS BIGINT) AS start FROM each)"""


def redacted() -> str:
    """Texts with overlapping matches, as offsets() places them, in one: named by the most severe, then the longest."""
    return """spans AS (SELECT id, start AS s, start + length(match) AS e, kind, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS rank FROM placed),
marked AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY id ORDER BY s, e, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM spans),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY s, e, kind ROWS UNBOUNDED PRECEDING) AS g FROM marked),
merged AS (SELECT id, g, min(s) AS s, max(e) AS e, arg_min(kind, {'rank': rank, 'size': s - e, 'kind': kind}) AS kind FROM numbered GROUP BY id, g),
between AS (SELECT id, s, e, kind, coalesce(lag(e) OVER (PARTITION BY id ORDER BY s), 0) AS f FROM merged),
written AS (SELECT b.id, string_agg(substring(t, f + 1, s - f) || '[REDACTED:' || kind || ']', '' ORDER BY s) AS head, max(e) AS last FROM between b JOIN texts x ON x.id = b.id GROUP BY b.id),
redacted AS (SELECT x.id, coalesce(head, '') || substring(t, coalesce(last, 0) + 1) AS text FROM texts x LEFT JOIN written w ON w.id = x.id)"""


def quoted(x: str) -> str:
    return x.replace("'", "''")
