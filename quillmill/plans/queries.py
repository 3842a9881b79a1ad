"""The archive's queries over the given tables, each with the SQL of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill import storage
from quillmill.functions import constants as C
from quillmill.functions.patterns import for_re2
from quillmill.operators import blobs, browse, export, history, ingest, pairing, policy, privacy, search, stats, summary, turns, vectors
from quillmill.plans import sql as S
from quillmill.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PHRASE, TERMS, QUERY_PART = ["of", "the"], ["the", "that", "tion"], "tion the"
RULES = [("email", None, r"@mail[0-9]\."), (None, "nothing", None)]


def _query(sql: str | None = None):
    """Registers a query under its function's name; integers come out as 64-bit."""

    def add(f):
        def run(spark, sf_dir):
            df = f(spark, sf_dir)
            return df.select(*[F.col(c).cast("long").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(c).cast("double").alias(c) if kind.startswith("decimal") else F.col(c) for c, kind in df.dtypes])

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _chat(spark, d):
    talk = T.table(spark, d, "conversations")
    return T.chat_sessions(talk), turns.assign_turns(T.chat_events(talk))


def _documents(spark, d):
    return policy.classify_index(T.document_events(T.table(spark, d, "documents")))


def _warnings(spark, d):
    return pairing.pairing_warnings(T.call_events(T.table(spark, d, "events"))).withColumn("session_id", F.col("path"))


def _texts_to_index(spark, d):
    return T.table(spark, d, "documents").select(F.col("doc_id").alias("event_id"), F.col("text").alias("indexed_text"))


def _index(spark, d):
    """The index of all documents, written once in an application; a query reads its terms' buckets of it."""
    path = storage.kept(spark, "index", f"{d}/documents.parquet", lambda p: search.write_index(_texts_to_index(spark, d), p, fields=("indexed_text",)))
    return search.StoredIndex(spark, path)


def _joined(column, sep=","):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), sep)


# ---- sessions, events, turns ----


@_query(f"WITH {S.CHAT}, {S.CALLS} SELECT s.*, coalesce(e.n, 0) AS event_count, coalesce(w.n, 0) AS warning_count FROM sess s LEFT JOIN (SELECT session_id, count(*) AS n FROM chat GROUP BY 1) e USING (session_id) LEFT JOIN (SELECT 'conv-' || path AS session_id, count(*) AS n FROM warn GROUP BY 1) w USING (session_id) ORDER BY coalesce(updated_at, first_seen_at, '') DESC, session_id DESC LIMIT 50")
def list_sessions(spark, d):
    se, ev = _chat(spark, d)
    return browse.list_sessions(se, ev, _warnings(spark, d).withColumn("session_id", F.concat(F.lit("conv-"), "path")))


@_query(f"WITH {S.CALLS} SELECT path AS session_id, line_no, code, call_id FROM warn ORDER BY line_no DESC, session_id, code LIMIT 50")
def list_warnings(spark, d):
    return browse.list_warnings(_warnings(spark, d)).select("session_id", "line_no", "code", "call_id")


@_query(f"WITH {S.CALLS} SELECT code, count(*) AS count FROM warn GROUP BY code")
def warning_summary(spark, d):
    return browse.warning_summary(_warnings(spark, d))


def _wanted(spark, d):
    """The ids of all conversations, and as many that are not there; the largest first."""
    talk = T.table(spark, d, "conversations").select("conv_id").distinct()
    there = talk.select(F.concat(F.lit("conv-"), "conv_id").alias("session_id"), (-2 * F.col("conv_id")).alias("ordinal"))
    return there.union(talk.select(F.concat(F.lit("none-"), "conv_id"), -2 * F.col("conv_id") - 1))


_WANTED = "want AS (SELECT DISTINCT 'conv-' || conv_id AS session_id, -2 * conv_id AS ordinal FROM conversations UNION ALL SELECT DISTINCT 'none-' || conv_id, -2 * conv_id - 1 FROM conversations)"


@_query(f"WITH {S.CHAT}, {_WANTED} SELECT w.session_id, w.ordinal, s.cwd, s.updated_at, s.session_id IS NOT NULL AS found FROM want w LEFT JOIN sess s USING (session_id)")
def sessions_by_id(spark, d):
    return browse.get_sessions(_chat(spark, d)[0], _wanted(spark, d)).select("session_id", "ordinal", "cwd", "updated_at", "found")


@_query(f"WITH {S.CHAT}, {_WANTED}, p AS (SELECT session_id, 1000000000 + row_number() OVER (ORDER BY coalesce(updated_at, first_seen_at, '') DESC, session_id DESC) AS place FROM sess WHERE cwd = 'proj-3') SELECT session_id, CAST(min(place) AS BIGINT) AS place FROM (SELECT session_id, ordinal AS place FROM want WHERE session_id IN (SELECT session_id FROM sess) UNION ALL SELECT * FROM p) GROUP BY session_id")
def selected_sessions(spark, d):
    return browse.select_sessions(_chat(spark, d)[0], _wanted(spark, d), "proj-3")


@_query(f"WITH {S.CHAT}, {_WANTED} SELECT event_id, session_id, sub_type FROM chat WHERE session_id IN (SELECT session_id FROM want)")
def wanted_events(spark, d):
    return browse.get_events(_chat(spark, d)[1], _wanted(spark, d)).select("event_id", "session_id", "sub_type")


@_query(f"WITH {S.CHAT} SELECT * FROM sess WHERE cwd = 'proj-3'")
def project_sessions(spark, d):
    return browse.project_sessions(_chat(spark, d)[0], "proj-3")


@_query(f"WITH {S.CHAT} SELECT event_id, session_id, top_type, sub_type, line_no FROM chat WHERE (top_type IN ('event_msg', 'message') OR coalesce(sub_type IN ('event_msg', 'message'), false)) AND coalesce(sub_type, top_type) NOT IN ('turn_context') AND top_type NOT IN ('turn_context') AND coalesce(sub_type, '') <> 'reasoning'")
def filter_events(spark, d):
    return browse.filter_events(_chat(spark, d)[1], ["event_msg", "message"], ["turn_context"], True, False).select("event_id", "session_id", "top_type", "sub_type", "line_no")


@_query(f"WITH {S.CHAT} SELECT event_id, session_id, turn_index FROM (SELECT *, max(turn_index) OVER (PARTITION BY session_id) AS m FROM chat) WHERE turn_index >= greatest(0, m - 2 + 1)")
def last_turns(spark, d):
    return browse.last_turns(_chat(spark, d)[1], 2).select("event_id", "session_id", "turn_index")


@_query(f"WITH {S.DOCS} SELECT event_id, CASE WHEN sub_type = 'function_call_output' THEN {S.trim('text_content', 1000)} ELSE {S.trim('text_content', 4000)} END AS text_content FROM dev WHERE coalesce(sub_type, '') NOT IN ('function_call_output', 'reasoning')")
def agent_profile(spark, d):
    return browse.apply_profile(T.document_events(T.table(spark, d, "documents")), "agent").select("event_id", "text_content")


@_query(f"WITH {S.DOCS} SELECT event_id, CASE WHEN sub_type = 'function_call_output' THEN {S.trim('text_content', 2000)} ELSE {S.trim('text_content', 8000)} END AS text_content FROM dev WHERE coalesce(sub_type, '') <> 'reasoning'")
def review_profile(spark, d):
    return browse.apply_profile(T.document_events(T.table(spark, d, "documents")), "review").select("event_id", "text_content")


@_query(f"WITH {S.CHAT}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS place, count(*) OVER (PARTITION BY session_id) AS event_count FROM chat) SELECT s.session_id, cwd, event_count, place, event_id, substring(text_content, 1, 120) AS preview, length(text_content) > 120 AS truncated FROM r JOIN sess s USING (session_id) WHERE place <= 5")
def session_detail(spark, d):
    return browse.session_detail(*_chat(spark, d)).select("session_id", "cwd", "event_count", "place", "event_id", "preview", "truncated")


@_query(f"WITH {S.CHAT} SELECT cwd, count(*) AS sessions, min(session_id) AS first_session, max(coalesce(updated_at, first_seen_at)) AS latest FROM sess GROUP BY cwd")
def overview(spark, d):
    return browse.overview(_chat(spark, d)[0])


@_query(f"WITH {S.POSTINGS}, {S.bm25(TERMS)} SELECT event_id, lang AS session_id, 'lang-' || lang AS cwd, score FROM scored JOIN documents ON doc_id = event_id WHERE event_id IN (SELECT event_id FROM hit GROUP BY event_id HAVING count(*) = {len(TERMS)}) ORDER BY score DESC, event_id LIMIT 20")
def overview_search(spark, d):
    """The overview's search leg over all documents."""
    events = T.document_events(T.table(spark, d, "documents"))
    sessions = events.select("session_id", F.concat(F.lit("lang-"), "session_id").alias("cwd")).distinct()
    return browse.overview_hits(sessions, events, _index(spark, d), " ".join(TERMS)).select("event_id", "session_id", "cwd", "score")


@_query(f"WITH {S.CALLS} SELECT w.path AS session_id, code, count(*) AS warning_count, min(w.line_no) AS first_line, any_value(c.n) AS event_count FROM warn w JOIN (SELECT path, count(*) AS n FROM calls GROUP BY path) c USING (path) GROUP BY ALL")
def warning_detail(spark, d):
    calls = T.call_events(T.table(spark, d, "events")).withColumn("session_id", F.col("path"))
    return browse.warning_detail(_warnings(spark, d), calls)


@_query(f"WITH t AS (SELECT doc_id, trim({S.flat('coalesce(text, chr(32))')}, ' #') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 58 THEN rtrim(substring(t, 1, 57)) || '…' ELSE t END AS title FROM t")
def friendly_titles(spark, d):
    return T.table(spark, d, "documents").select("doc_id", browse.friendly_title(F.col("text")).alias("title"))


@_query("SELECT 'conv-' || conv_id AS session_id, 'proj-' || (conv_id % 7) AS project FROM (SELECT DISTINCT conv_id FROM conversations)")
def project_names(spark, d):
    return T.chat_sessions(T.table(spark, d, "conversations")).select("session_id", browse.project_name(F.concat(F.lit("C:\\work/"), "cwd", F.lit("/"))).alias("project"))


@_query(f"WITH {S.CHAT} SELECT event_id, session_id, turn_index FROM chat")
def turn_assignment(spark, d):
    return _chat(spark, d)[1].select("event_id", "session_id", "turn_index")


@_query(f"WITH {S.CHAT} SELECT session_id, turn_index, count(*) AS event_count, min(event_id) AS first_event_id, max(event_id) AS last_event_id FROM chat GROUP BY session_id, turn_index")
def turn_rollup(spark, d):
    return turns.roll_up_turns(_chat(spark, d)[1])


_SETTINGS = "st AS (SELECT *, CASE WHEN top_type = 'turn_context' THEN 'm' || (line_no % 3) END AS model, CASE WHEN top_type = 'turn_context' AND line_no % 2 = 0 THEN 'high' END AS effort FROM chat)"


@_query(f"WITH {S.CHAT}, {_SETTINGS} SELECT session_id, turn_index, count(*) AS event_count, min(event_id) AS first_event_id, max(event_id) AS last_event_id, arg_max(model, event_id) AS model, arg_max(effort, event_id) AS effort, CAST(NULL AS VARCHAR) AS approval_policy FROM st GROUP BY session_id, turn_index")
def turn_settings(spark, d):
    """Turns with the settings of the system's messages, whose payloads name a model and, on even lines, an effort."""
    events = _chat(spark, d)[1]
    payload = F.to_json(F.struct(F.concat(F.lit("m"), (F.col("line_no") % 3).cast("string")).alias("model"), F.when(F.col("line_no") % 2 == 0, "high").otherwise("").alias("effort")))
    return turns.roll_up_turns(turns.with_settings(events.withColumn("payload", payload)), turns.SETTINGS)


# ---- statistics ----


@_query(f"WITH {S.CHAT}, {S.CALLS} SELECT (SELECT count(*) FROM sess) AS sessions, (SELECT count(DISTINCT cwd) FROM sess) AS projects, (SELECT min(first_seen_at) FROM sess) AS first_seen_at, (SELECT max(updated_at) FROM sess) AS updated_at, (SELECT count(*) FROM chat) AS events, (SELECT count(*) FROM (SELECT DISTINCT session_id, turn_index FROM chat)) AS turns, 0::BIGINT AS tool_calls, 0::BIGINT AS files, (SELECT count(*) FROM warn) AS warnings")
def archive_stats(spark, d):
    return stats.archive_stats(*_chat(spark, d), _warnings(spark, d))


@_query(f"WITH {S.INDEXED}, s AS (SELECT count(*) AS events, count(indexed_text) AS searchable, count(*) FILTER (WHERE starts_with(index_policy, 'skip_')) AS skipped, count(*) FILTER (WHERE index_policy = 'truncated') AS truncated, count(*) FILTER (WHERE index_policy = 'metadata_only') AS metadata_only, CAST(coalesce(sum(length(text_content)), 0) AS BIGINT) AS raw_chars, CAST(coalesce(sum(length(indexed_text)), 0) AS BIGINT) AS indexed_chars FROM pol) SELECT *, round(CASE WHEN raw_chars > 0 THEN indexed_chars::DOUBLE / raw_chars ELSE 0 END, 6) AS ratio FROM s")
def index_stats(spark, d):
    return stats.index_stats(_documents(spark, d))


@_query(f"WITH {S.INDEXED} SELECT index_policy, value_level, count(*) AS count FROM pol GROUP BY GROUPING SETS ((index_policy), (value_level))")
def index_groups(spark, d):
    return stats.index_groups(_documents(spark, d))


@_query(f"WITH {S.DOCS} SELECT top_type, coalesce(sub_type, '<null>') AS sub_type, count(*) AS events, CAST(sum(length(text_content)) AS BIGINT) AS payload_chars FROM dev GROUP BY ALL ORDER BY payload_chars DESC, top_type, sub_type LIMIT 40")
def storage_audit(spark, d):
    return stats.storage_audit(_documents(spark, d), "text_content")


@_query(f"WITH {S.CHAT}, {S.CALLS}, r AS (SELECT (SELECT count(*) FROM chat) AS events, (SELECT count(*) FROM warn) AS warnings) SELECT code, count(*) AS count, any_value(events) AS events, any_value(warnings) AS warnings, any_value(round(warnings::DOUBLE / events, 6)) AS ratio, any_value(warnings::DOUBLE / events > 0.05) AS high_ratio FROM warn, r GROUP BY code ORDER BY count DESC, code LIMIT 10")
def parse_health(spark, d):
    return stats.parse_health(_chat(spark, d)[1], _warnings(spark, d))


@_query(f"WITH {S.INDEXED}, w AS (SELECT event_id FROM pol WHERE indexed_text IS NOT NULL), i AS (SELECT event_id FROM pol WHERE len(regexp_extract_all(lower(indexed_text), '{C.TERM}')) > 0) SELECT (SELECT count(*) FROM w) AS searchable, (SELECT count(*) FROM i) AS indexed, (SELECT count(*) FROM w WHERE event_id NOT IN (SELECT event_id FROM i)) AS not_indexed")
def index_status(spark, d):
    docs = _documents(spark, d)
    return stats.index_status(docs, search.postings(docs))


_SIDES = "counters AS (SELECT source AS key, count(*) FILTER (WHERE doc_id % 2 = 0) AS before, count(*) FILTER (WHERE doc_id % 2 = 1) AS after FROM documents WHERE source IS NOT NULL GROUP BY source)"


@_query(f"WITH {_SIDES} SELECT key, before, after, after - before AS delta, before = 0 AS is_new FROM counters")
def audit_diff(spark, d):
    docs = T.table(spark, d, "documents").where("source is not null")
    side = lambda k: docs.where(F.col("doc_id") % 2 == k).groupBy(F.col("source").alias("key")).agg(F.count("*").alias("count"))
    return stats.audit_diff(side(0), side(1))


_TOTALS = "tt AS (SELECT doc_id % 2 AS side, count(*) AS files, sum(n_chars) AS events, count(*) FILTER (WHERE lang = 'de') AS warnings, round(count(*) FILTER (WHERE lang = 'en')::DOUBLE / count(*), 6) AS parseable_ratio FROM documents GROUP BY 1)"


@_query(f"WITH {_SIDES}, {_TOTALS} SELECT CAST(a.files - b.files AS BIGINT) AS files_delta, CAST(a.events - b.events AS BIGINT) AS events_delta, CAST(a.warnings - b.warnings AS BIGINT) AS warnings_delta, round(a.parseable_ratio - b.parseable_ratio, 6) AS parseable_ratio_delta, a.warnings > b.warnings AS warnings_increased, a.parseable_ratio < b.parseable_ratio AS parseable_ratio_decreased, coalesce((SELECT string_agg(key, ',' ORDER BY key) FROM counters WHERE before = 0 AND after > 0), '') AS new_warning_codes FROM tt a, tt b WHERE a.side = 1 AND b.side = 0")
def audit_regressions(spark, d):
    """The documents with odd ids as a later audit of those with even ones."""
    docs = T.table(spark, d, "documents")
    side = lambda k: docs.where(F.col("doc_id") % 2 == k).agg(F.count("*").alias("files"), F.sum("n_chars").alias("events"), F.count_if(F.col("lang") == "de").alias("warnings"), F.round(F.count_if(F.col("lang") == "en") / F.count("*"), 6).alias("parseable_ratio"))
    codes = lambda k: docs.where(f"source is not null and doc_id % 2 = {k}").groupBy(F.col("source").alias("key")).agg(F.count("*").alias("count"))
    out = stats.audit_regressions(side(0), side(1), codes(0), codes(1))
    return out.withColumn("parseable_ratio_delta", F.round("parseable_ratio_delta", 6)).withColumn("new_warning_codes", F.array_join("new_warning_codes", ","))


@_query('SELECT \'documents\' AS "table", (SELECT count(*) FROM documents) AS a, (SELECT count(DISTINCT text) FROM documents) AS b, (SELECT count(*) FROM documents) = (SELECT count(DISTINCT text) FROM documents) AS equal UNION ALL SELECT \'labels\', count(*), count(*), true FROM labels')
def counts_equal(spark, d):
    docs, labels = T.table(spark, d, "documents"), T.table(spark, d, "labels")
    return stats.counts_equal({"documents": docs, "labels": labels}, {"documents": docs.where("text is not null").select(F.sha2("text", 256)).distinct(), "labels": labels})


@_query(f"WITH {S.CHAT} SELECT session_id, count(*) AS messages, sha256(string_agg(sha256(coalesce(sub_type, top_type) || '|' || coalesce(text_content, '')), chr(10) ORDER BY event_id)) AS digest FROM chat WHERE sub_type IN ('user_message', 'message') GROUP BY session_id")
def conversation_digest(spark, d):
    return stats.conversation_digest(_chat(spark, d)[1])


_DIGEST = "dg AS (SELECT session_id, sha256(string_agg(sha256(coalesce(sub_type, top_type) || '|' || coalesce(text_content, '')), chr(10) ORDER BY event_id)) AS digest FROM chat WHERE sub_type IN ('user_message', 'message') GROUP BY session_id), dh AS (SELECT sha256(session_id || '|' || digest) AS h FROM dg), ds AS (SELECT count(*) AS sessions, " + ", ".join(f"sum(('0x' || substring(h, {k}, 15))::BIGINT) AS d{k}" for k in (1, 16, 31, 46)) + " FROM dh)"


@_query(f"WITH {S.CHAT}, {_DIGEST} SELECT sessions, sha256(concat_ws('|', sessions, d1, d16, d31, d46)) AS digest FROM ds")
def archive_digest(spark, d):
    return stats.archive_digest(_chat(spark, d)[1])


# ---- content policy, blobs ----


@_query(f"WITH {S.INDEXED} SELECT event_id, index_policy, value_level, indexed_text FROM pol")
def index_policy(spark, d):
    return _documents(spark, d).select("event_id", "index_policy", "value_level", "indexed_text")


@_query(f"WITH {S.PAGES} SELECT event_id, 'metadata_only' AS index_policy, 'evidence' AS value_level, '[binary or image evidence omitted from search index] type=' || top_type || '/' || sub_type || ' tool=' || tool_name || ' file=' || file_path AS indexed_text FROM pev")
def binary_policy(spark, d):
    """Outputs that hold an inline image, one for each page."""
    events = T.page_events(T.table(spark, d, "pages"), "data:image/png;base64,", "AAAA")
    return policy.classify_index(events).select("event_id", "index_policy", "value_level", "indexed_text")


@_query(f"WITH {S.DOCS} SELECT event_id, CASE WHEN sub_type = 'function_call_output' THEN 'evidence' WHEN sub_type = 'message' THEN 'core' WHEN octet_length(encode(coalesce(text_content, ''))) > 16384 THEN 'evidence' ELSE 'core' END AS storage_class FROM dev")
def storage_class(spark, d):
    return policy.classify_storage(T.document_events(T.table(spark, d, "documents")), "text_content").select("event_id", "storage_class")


@_query(f"WITH {S.INDEXED}, k AS (SELECT DISTINCT session_id, sha256(text_content) AS body FROM dev WHERE sub_type = 'message' AND text_content IS NOT NULL) SELECT event_id, CASE WHEN k.body IS NOT NULL THEN 'skip_duplicate' ELSE index_policy END AS index_policy, CASE WHEN k.body IS NULL THEN text_content END AS text_content FROM pol LEFT JOIN k ON k.session_id = pol.session_id AND sub_type = 'agent_message' AND sha256(text_content) = k.body")
def dedupe_bodies(spark, d):
    return policy.without_bodies(policy.dedupe_bodies(_documents(spark, d))).select("event_id", "index_policy", "text_content")


@_query("SELECT DISTINCT sha256(text) AS blob_id, octet_length(encode(text)) AS original_bytes FROM documents WHERE text IS NOT NULL")
def distinct_blobs(spark, d):
    return blobs.blobs(T.table(spark, d, "documents"), "text").select("blob_id", "original_bytes")


@_query("SELECT DISTINCT sha256(text) AS blob_id, octet_length(encode(text)) AS original_bytes FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL)")
def unreferenced_blobs(spark, d):
    docs = T.table(spark, d, "documents")
    marked = docs.join(T.table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").withColumn("sha", F.sha2("text", 256))
    # half of the references stand in a column, the others deep in payloads, with white space
    own, inner = F.col("doc_id") % 2 == 0, F.concat(F.lit('{"parts": [{"k": 1}, {"text_ref" : "'), F.col("sha"), F.lit('"}]}'))
    marked = marked.select(F.when(own, F.col("sha")).alias("payload_ref"), F.when(~own, inner).otherwise("{}").alias("payload"))
    return blobs.unreferenced_blobs(blobs.blobs(docs, "text"), blobs.referenced(marked)).select("blob_id", "original_bytes")


# ---- search ----


@_query(f"WITH {S.POSTINGS} SELECT term, event_id, tf, list_aggregate(positions, 'string_agg', ',') AS positions FROM post")
def postings(spark, d):
    return search.postings(_texts_to_index(spark, d), ("indexed_text",)).select("term", "event_id", "tf", _joined(F.col("positions")).alias("positions"))


_LISTED = ", ".join(f"'{t}'" for t in TERMS)


@_query(f"WITH {S.POSTINGS} SELECT event_id FROM post WHERE term IN ({_LISTED}) GROUP BY event_id HAVING count(DISTINCT term) = {len(TERMS)}")
def search_terms(spark, d):
    return search.match_terms(_index(spark, d), TERMS)


@_query(f"WITH {S.POSTINGS} SELECT DISTINCT event_id FROM post WHERE term IN ({_LISTED}) AND event_id NOT IN (SELECT event_id FROM post WHERE term = 'und')")
def search_any_not(spark, d):
    _, wanted, unwanted = search.parse_query(" OR ".join(TERMS) + " NOT und")
    return search.match_terms(_index(spark, d), wanted, False, unwanted)


@_query(f"WITH {S.POSTINGS} SELECT DISTINCT a.event_id FROM words a JOIN words b ON a.event_id = b.event_id AND b.pos = a.pos + 1 WHERE a.term = '{PHRASE[0]}' AND b.term = '{PHRASE[1]}'")
def search_phrase(spark, d):
    return search.match_phrase(_index(spark, d), PHRASE)


@_query(f"WITH {S.INDEXED} SELECT event_id FROM pol WHERE contains(lower(indexed_text), '{QUERY_PART}')")
def search_like(spark, d):
    return search.match_like(_documents(spark, d), QUERY_PART)


@_query(f"WITH {S.POSTINGS}, {S.bm25(TERMS)} SELECT event_id, score FROM scored ORDER BY score DESC, event_id LIMIT 20")
def bm25_top(spark, d):
    return search.bm25(_index(spark, d), TERMS).orderBy(F.desc("score"), "event_id").limit(20)


@_query(f"WITH {S.POSTINGS}, {S.bm25(TERMS)} SELECT event_id, lang AS session_id, score FROM scored JOIN documents ON doc_id = event_id WHERE lang = 'en' AND event_id % 4 = 3 AND event_id IN (SELECT event_id FROM hit GROUP BY event_id HAVING count(*) = {len(TERMS)}) ORDER BY score DESC, event_id LIMIT 20")
def search_filtered(spark, d):
    events = T.document_events(T.table(spark, d, "documents"))
    sessions = events.select("session_id", F.concat(F.lit("lang-"), "session_id").alias("cwd")).distinct()
    return search.search(events, _index(spark, d), sessions, " ".join(TERMS), cwd="lang-en", event_type="user_message")


_HIT = f"len(list_intersect(regexp_extract_all(lower(w), '{C.TERM}'), [{_LISTED}])) > 0"


@_query(f"WITH {S.POSTINGS}, {S.bm25(TERMS)}, top20 AS (SELECT event_id, score FROM scored ORDER BY score DESC, event_id LIMIT 20), sw AS (SELECT event_id, score, string_split({S.flat('text')}, ' ') AS words FROM top20 JOIN documents ON doc_id = event_id), sf AS (SELECT *, greatest(1, coalesce(list_position(list_transform(words, lambda w: {_HIT}), true), 0) - 4) AS f FROM sw) SELECT event_id, score, CASE WHEN f > 1 THEN '...' ELSE '' END || array_to_string(list_transform(list_slice(words, f, f + 11), lambda w: CASE WHEN {_HIT} THEN '[' || w || ']' ELSE w END), ' ') || CASE WHEN len(words) >= f + 12 THEN '...' ELSE '' END AS snippet FROM sf")
def snippets(spark, d):
    docs = T.table(spark, d, "documents").select(F.col("doc_id").alias("event_id"), F.col("text").alias("indexed_text"))
    return search.snippets(bm25_top(spark, d), docs, TERMS)


# ---- vectors ----


@_query(f"WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{C.EMBEDDING_TOKEN}')) AS t FROM documents), h AS (SELECT doc_id, sha256(t) AS x FROM tok), v AS (SELECT doc_id, CAST(('0x' || x[1:8])::BIGINT % 64 AS BIGINT) AS slot, sum(CASE WHEN ('0x' || x[9:10])::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM h GROUP BY ALL) SELECT doc_id, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM v WHERE v <> 0")
def embed_documents(spark, d):
    return vectors.embed(T.table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.posexplode("vector").alias("slot", "v")).where("v <> 0").select("doc_id", "slot", F.round("v", 6).alias("value"))


def _query_vector(spark, d):
    return [float(x) for x in T.table(spark, d, "embeddings").orderBy("vec_id").first()["embedding"]]


_TOPK = "q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), vt AS (SELECT vec_id, label, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * e[i]::DOUBLE)), 6) AS score FROM embeddings, q), vtop AS (SELECT * FROM vt WHERE score > 0 ORDER BY score DESC, vec_id LIMIT 10)"


@_query(f"WITH {_TOPK} SELECT vec_id, score FROM vtop")
def vector_topk(spark, d):
    return vectors.vector_topk(T.table(spark, d, "embeddings"), _query_vector(spark, d), "vec_id", "embedding")


@_query(f"WITH {S.POSTINGS}, {S.bm25(TERMS)}, {_TOPK}, ttop AS (SELECT event_id, score, text FROM scored JOIN documents ON doc_id = event_id ORDER BY score DESC, event_id LIMIT 20), legs AS (SELECT 'fts:' || event_id AS id, 'fts' AS source, round((1 / (1 + score)) / max(1 / (1 + score)) OVER (), 6) AS fts_score, 0.0::DOUBLE AS vector_score, CASE WHEN event_id % 2 = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS same_project, CASE WHEN contains(lower(text), 'the.') THEN 1.0::DOUBLE ELSE 0.0 END AS exact_hint FROM ttop UNION ALL SELECT 'vector:' || vec_id, 'vector', 0.0, score, CASE WHEN vec_id % 2 = 1 THEN 1.0 ELSE 0.0 END, 0.0 FROM vtop) SELECT *, round(least(1.0, 0.65::DOUBLE * fts_score + 0.35::DOUBLE * vector_score + 0.05::DOUBLE * same_project + 0.05::DOUBLE * exact_hint), 6) AS score FROM legs ORDER BY score DESC, source, id LIMIT 20")
def hybrid_rank(spark, d):
    project = lambda c: F.concat(F.lit("p"), F.col(c) % 2)
    top = bm25_top(spark, d).join(T.table(spark, d, "documents").select(F.col("doc_id").alias("event_id"), "text"), "event_id")
    text = top.select(F.col("event_id").alias("id"), (-F.col("score")).alias("rank"), "text", project("event_id").alias("project"))
    near = vector_topk(spark, d).select(F.col("vec_id").alias("id"), "score", F.lit(None).cast("string").alias("text"), project("vec_id").alias("project"))
    return vectors.hybrid_rank(text, near, "the.", "p1")


@_query(f"WITH {S.POSTINGS}, {S.bm25(TERMS)} SELECT 'fts:event:' || event_id AS result_id, event_id, round(1.0::DOUBLE / row_number() OVER (ORDER BY s.score DESC, event_id), 6) AS score FROM scored s ORDER BY score DESC, event_id LIMIT 20")
def agent_rank(spark, d):
    return vectors.agent_rank(bm25_top(spark, d))


@_query(f"WITH {S.POSTINGS}, {S.bm25(TERMS)} SELECT event_id, CAST(row_number() OVER (ORDER BY scored.score DESC, event_id) - 1 AS BIGINT) AS place, lang AS session_id FROM scored JOIN documents ON doc_id = event_id ORDER BY scored.score DESC, event_id LIMIT 20")
def evidence_lookup(spark, d):
    """The events of the best page of hits, by their ids and in its order."""
    ids = [r.event_id for r in bm25_top(spark, d).orderBy(F.desc("score"), "event_id").collect()]
    return export.events_by_id(T.document_events(T.table(spark, d, "documents")), ids).select("event_id", "place", "session_id")


@_query("SELECT 'label-' || label AS adapter, len(embedding) AS dimensions, count(*) AS chunk_count, count(DISTINCT vec_id // 10) AS sessions FROM embeddings GROUP BY ALL")
def vector_status(spark, d):
    """Vectors by label as an adapter's, ten to a session."""
    chunks = T.table(spark, d, "embeddings").select(F.concat(F.lit("label-"), "label").alias("adapter"), F.size("embedding").alias("dimensions"), F.expr("vec_id div 10").alias("session_id"))
    return vectors.vector_status(chunks)


# ---- privacy ----


def _texts(spark, d):
    docs = T.table(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("id"), "text")
    return docs.unionByName(T.table(spark, d, "pages").select(F.concat(F.lit("page-"), "page_id").alias("id"), F.col("html").alias("text")))


@_query(f"WITH {S.findings()} SELECT id, kind, severity, n, CASE WHEN length(match) > 120 THEN substring(match, 1, 117) || '...' ELSE match END AS excerpt FROM found")
def privacy_findings(spark, d):
    return privacy.scan(_texts(spark, d), "id", "text").drop("match")


@_query(f'WITH {S.findings()}, {S.offsets()} SELECT id, kind, severity, n, match, start, start + length(match) AS "end" FROM placed')
def match_offsets(spark, d):
    return privacy.match_offsets(_texts(spark, d), "id", "text")


@_query(f"WITH {S.findings()} SELECT id, kind, n, CASE WHEN kind NOT LIKE '%_abs_path' THEN CASE WHEN length(match) > 120 THEN substring(match, 1, 117) || '...' ELSE match END END AS excerpt FROM found")
def hidden_paths(spark, d):
    """Findings as they are shown: without paths, in columns or excerpts."""
    found = privacy.scan(_texts(spark, d), "id", "text").withColumn("raw_path", F.col("id"))
    return browse.hide_paths(found.drop("match", "severity"))


_ALLOW = f"{S.findings()}, f AS (SELECT *, kind = 'email' AND regexp_matches(match, '{RULES[0][2]}') OR match = 'nothing' AS allowlisted FROM found)"


def _allowed(spark, d):
    return privacy.allowlisted(privacy.scan(_texts(spark, d), "id", "text"), spark.createDataFrame(RULES, "kind string, text string, pattern string"))


@_query(f"WITH {_ALLOW} SELECT id, kind, n, match, allowlisted FROM f")
def privacy_allowlist(spark, d):
    return _allowed(spark, d).select("id", "kind", "n", "match", "allowlisted")


@_query(f"WITH {_ALLOW} SELECT DISTINCT id FROM f WHERE NOT allowlisted AND severity IN ('high', 'critical')")
def high_risk_documents(spark, d):
    return privacy.high_risk(_allowed(spark, d), "id")


@_query(f"WITH {S.findings()}, {S.offsets()}, {S.redacted()} SELECT id, text FROM redacted")
def redact_documents(spark, d):
    return _texts(spark, d).select("id", privacy.redacted(F.coalesce("text", F.lit(""))).alias("text"))


#: Texts in which detectors' matches overlap: a mail address in paths, a key in an assignment, assignments in a path.
_OVERLAPS = "concat('see C:\\\\Users\\\\u', doc_id, '@y.com\\\\plan\\\\x: and /home/', source, '@y', doc_id, '.org/secret=abcdefgh', doc_id, ' token=sk_ABCDEFGHIJKLMNOP', doc_id, ' ', coalesce(text, ''))"


@_query(f"WITH texts AS (SELECT doc_id AS id, {_OVERLAPS.replace(chr(92) * 2, chr(92))} AS t FROM documents), {S.offsets()}, {S.redacted()} SELECT id, text FROM redacted")
def redact_overlaps(spark, d):
    """Matches of several kinds that overlap become one, named by the most severe."""
    docs = T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr(_OVERLAPS).alias("text"))
    return privacy.redact(docs, "id", "text")


@_query(f"WITH {_ALLOW} SELECT severity, kind, count(*) FILTER (WHERE NOT allowlisted) AS count, count(*) FILTER (WHERE allowlisted) AS allowlisted_count FROM f GROUP BY ROLLUP (severity, kind)")
def privacy_summary(spark, d):
    return privacy.privacy_summary(_allowed(spark, d))


@_query(f"WITH {S.findings()}, {S.offsets()}, {S.redacted()} SELECT id, text FROM redacted WHERE id IN (SELECT id FROM found)")
def privacy_gate_redacted(spark, d):
    """Of the texts with a finding, what the gate lets through when it rewrites."""
    texts = _texts(spark, d).withColumn("text", F.coalesce("text", F.lit("")))
    found = privacy.scan(texts, "id", "text")
    some = texts.join(found.select("id").distinct(), "id", "left_semi")
    return privacy.gate(some, found, "id", "text", "redact")[0].select("id", "text")


@_query(f"WITH {S.findings()} SELECT id, length(t) AS n_chars FROM texts WHERE id NOT IN (SELECT id FROM found WHERE severity IN ('high', 'critical'))")
def privacy_gate(spark, d):
    texts = _texts(spark, d)
    return privacy.gate(texts, privacy.scan(texts, "id", "text"), "id", "text", "fail")[0].select("id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))


@_query("SELECT page_id, 'sample-' || substring(sha256(encode('salt') || '\\x00'::BLOB || encode(coalesce(url, '')) || '\\x00'::BLOB || encode(CAST(page_id AS VARCHAR))), 1, 16) AS sample_id FROM pages")
def anonymous_ids(spark, d):
    return T.table(spark, d, "pages").select("page_id", privacy.anonymous_id("salt", F.coalesce("url", F.lit("")), F.col("page_id").cast("string")).alias("sample_id"))


# ---- summaries, chunks, exports ----

_FIRST = "row_number() OVER (PARTITION BY session_id ORDER BY event_id)"


@_query(f"WITH {S.CHAT}, g AS (SELECT session_id, arg_min(text_content, event_id) AS user_goal FROM chat WHERE {S.IS_USER} AND {S.HAS_TEXT} GROUP BY session_id) SELECT session_id, {S.short('coalesce(user_goal, cwd, session_id)', 80)} AS topic, user_goal FROM sess LEFT JOIN g USING (session_id)")
def session_topics(spark, d):
    return summary.session_topics(*_chat(spark, d))


@_query(f"WITH {S.CHAT}, l AS (SELECT *, 0::BIGINT AS list, {_FIRST} AS place, 3 AS n FROM chat WHERE {S.IS_USER} UNION ALL SELECT *, 1, {_FIRST}, 5 FROM chat WHERE {S.IS_ASSISTANT}) SELECT session_id, list, place, event_id, {S.short('text_content', 180)} AS text FROM l WHERE place <= n AND {S.HAS_TEXT}")
def key_steps(spark, d):
    return summary.key_steps(_chat(spark, d)[1])


_FILE = for_re2(C.FILE_PATTERN)[0]


@_query(f"WITH {S.DOCS}, m AS (SELECT session_id, event_id, unnest(regexp_extract_all(coalesce(text_content, ''), '{_FILE}')) AS path, generate_subscripts(regexp_extract_all(coalesce(text_content, ''), '{_FILE}'), 1) AS pos FROM dev), f AS (SELECT session_id, path, min(event_id * 1000000 + pos) AS spot FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY spot) AS place FROM f) SELECT session_id, place, path, spot // 1000000 AS event_id FROM r WHERE place <= 20")
def files_mentioned(spark, d):
    return summary.files_mentioned(T.document_events(T.table(spark, d, "documents")))


@_query(f"WITH {S.DOCS}, p AS (SELECT *, {_FIRST} AS place FROM dev WHERE {S.PROBLEM}) SELECT session_id, place, event_id, {S.short('text_content', 180)} AS text FROM p WHERE place <= 8")
def problem_events(spark, d):
    return summary.problem_events(T.document_events(T.table(spark, d, "documents")))


@_query(f"WITH {S.PAGES}, m AS (SELECT session_id, event_id, unnest([file_path] || regexp_extract_all(text_content, '{_FILE}')) AS path, generate_subscripts([file_path] || regexp_extract_all(text_content, '{_FILE}'), 1) AS pos FROM pev), f AS (SELECT session_id, path, min(event_id * 1000000 + pos) AS spot FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY spot) AS place FROM f) SELECT session_id, place, path, spot // 1000000 AS event_id FROM r WHERE place <= 20")
def files_of_pages(spark, d):
    return summary.files_mentioned(T.page_events(T.table(spark, d, "pages")))


@_query(f"WITH {S.PAGES}, p AS (SELECT *, {_FIRST} AS place FROM pev WHERE {S.PROBLEM}) SELECT session_id, place, event_id, {S.short('text_content', 180)} AS text FROM p WHERE place <= 8")
def problems_of_pages(spark, d):
    return summary.problem_events(T.page_events(T.table(spark, d, "pages")))


@_query(f"WITH {S.CHAT}, p AS (SELECT *, {_FIRST} AS place FROM chat WHERE {S.HAS_TEXT}) SELECT session_id, place, event_id FROM p WHERE place <= 20")
def evidence_ids(spark, d):
    return summary.evidence_ids(_chat(spark, d)[1])


@_query(f"WITH {S.DOCS} SELECT session_id, CASE WHEN bool_or(sub_type = 'function_call_output') THEN 'Review command outputs and preserve useful fixes in project documentation.' ELSE 'Add more sessions, then re-run search and export to build the archive.' END AS next_step FROM dev GROUP BY session_id")
def next_steps(spark, d):
    return summary.next_steps(T.document_events(T.table(spark, d, "documents")))


@_query(f"WITH {S.CHAT}, i AS (SELECT session_id, CASE WHEN turn_index > 0 THEN event_id END AS event_id FROM chat) SELECT session_id, count(*) AS total, count(event_id) AS with_evidence, round(count(event_id)::DOUBLE / count(*), 6) AS ratio FROM i GROUP BY session_id")
def evidence_coverage(spark, d):
    return summary.coverage(_chat(spark, d)[1].select("session_id", F.when(F.col("turn_index") > 0, F.col("event_id")).alias("event_id")))


_GROUPED = "gi AS (SELECT session_id, coalesce(sub_type, top_type) AS \"group\", CASE WHEN turn_index > 0 THEN event_id END AS event_id FROM chat), gg AS (SELECT session_id, \"group\", count(*) AS n, count(event_id) AS e FROM gi GROUP BY ALL)"


@_query(f"WITH {S.CHAT}, {_GROUPED} SELECT session_id, CAST(sum(n) AS BIGINT) AS total, CAST(sum(e) AS BIGINT) AS with_evidence, round(sum(e)::DOUBLE / sum(n), 6) AS ratio, string_agg(\"group\" || ' ' || n || ' ' || e, ',' ORDER BY \"group\") AS by_group, coalesce(string_agg(\"group\" || ' has ' || (n - e) || ' item(s) without evidence.', ',' ORDER BY \"group\") FILTER (WHERE n > e), '') AS missing FROM gg GROUP BY session_id")
def grouped_coverage(spark, d):
    se, ev = _chat(spark, d)
    items = ev.select("session_id", F.coalesce("sub_type", "top_type").alias("group"), F.when(F.col("turn_index") > 0, F.col("event_id")).alias("event_id"))
    out = summary.coverage_by_group(se, items)
    flat = F.transform("by_group", lambda g: F.concat_ws(" ", g["group"], g["total"].cast("string"), g["with_evidence"].cast("string")))
    return out.withColumn("by_group", F.array_join(flat, ",")).withColumn("missing", F.array_join("missing", ","))


_TURNS = f"tc AS (SELECT session_id || ':turn-' || turn_index AS chunk_id, session_id, turn_index, 'Turn: ' || turn_index || chr(10) || string_agg('- Event ' || event_id || ' [' || coalesce(sub_type, top_type) || '/' || role || ']: ' || {S.short('text_content', 240)}, chr(10) ORDER BY event_id) AS text, list(event_id ORDER BY event_id) AS ids FROM chat WHERE {S.CHUNK_TEXT} GROUP BY session_id, turn_index)"


@_query(f"WITH {S.CHAT}, {_TURNS} SELECT chunk_id, session_id, turn_index, text, list_aggregate(ids, 'string_agg', ',') AS evidence FROM tc")
def turn_chunks(spark, d):
    return summary.turn_chunks(_chat(spark, d)[1]).select("chunk_id", "session_id", "turn_index", "text", _joined(F.col("evidence_event_ids")).alias("evidence"))


_CITED = f"tcap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index) AS place FROM tc) WHERE place <= 2), cited AS (SELECT DISTINCT unnest(ids) AS event_id FROM tcap), ec AS (SELECT session_id || ':evidence-' || event_id AS chunk_id, session_id, turn_index, event_id, 'Event: ' || event_id || chr(10) || 'Type: ' || coalesce(sub_type, top_type) || chr(10) || 'Timestamp: ' || chr(10) || chr(10) || text_content AS text FROM chat WHERE {S.CHUNK_TEXT} AND event_id NOT IN (SELECT event_id FROM cited))"


def _first_turns(spark, d):
    return summary.cap_chunks(summary.turn_chunks(_chat(spark, d)[1]), 2)


@_query(f"WITH {S.CHAT}, {_TURNS}, {_CITED} SELECT chunk_id, session_id, turn_index, text FROM ec")
def evidence_chunks(spark, d):
    cited = _first_turns(spark, d).select(F.explode("evidence_event_ids").alias("event_id"))
    return summary.evidence_chunks(_chat(spark, d)[1], cited).select("chunk_id", "session_id", "turn_index", "text")


@_query(f"WITH {S.CHAT}, {_TURNS}, {_CITED}, b AS (SELECT chunk_id, session_id, text, 1 AS kind, turn_index AS o FROM tcap UNION ALL SELECT chunk_id, session_id, text, 2, event_id FROM ec), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY kind, o) AS place FROM b) SELECT chunk_id, session_id, {S.trim('text', 300)} AS text, length(text) > 300 AS truncated FROM r WHERE place <= 4")
def capped_chunks(spark, d):
    first = _first_turns(spark, d).withColumn("turn_index", F.col("turn_index").cast("long"))
    cited = first.select(F.explode("evidence_event_ids").alias("event_id"))
    both = first.unionByName(summary.evidence_chunks(_chat(spark, d)[1], cited))
    return summary.trim_chunks(summary.cap_chunks(both, 4), 300).select("chunk_id", "session_id", "text", "truncated")


_LISTED_LINES = "string_agg('- ' || {0} || ' (evidence: ' || event_id || ')', chr(10) ORDER BY {1}) AS part"
_SUMMARIES = f"""goal AS (SELECT session_id, arg_min(text_content, event_id) AS user_goal FROM chat WHERE {S.IS_USER} AND {S.HAS_TEXT} GROUP BY session_id),
steps AS (SELECT session_id, {_LISTED_LINES.format('text', 'list, place')} FROM (SELECT session_id, list, place, event_id, {S.short('text_content', 180)} AS text FROM (SELECT *, 0 AS list, {_FIRST} AS place, 3 AS n FROM chat WHERE {S.IS_USER} UNION ALL SELECT *, 1, {_FIRST}, 5 FROM chat WHERE {S.IS_ASSISTANT}) WHERE place <= n AND {S.HAS_TEXT}) GROUP BY session_id),
names AS (SELECT session_id, path, min(event_id * 1000000 + pos) AS spot FROM (SELECT session_id, event_id, unnest(regexp_extract_all(coalesce(text_content, ''), '{_FILE}')) AS path, generate_subscripts(regexp_extract_all(coalesce(text_content, ''), '{_FILE}'), 1) AS pos FROM chat) GROUP BY ALL),
files AS (SELECT session_id, {_LISTED_LINES.format('path', 'spot')} FROM (SELECT *, spot // 1000000 AS event_id, row_number() OVER (PARTITION BY session_id ORDER BY spot) AS place FROM names) WHERE place <= 20 GROUP BY session_id),
faults AS (SELECT session_id, {_LISTED_LINES.format(S.short('text_content', 180), 'place')} FROM (SELECT *, {_FIRST} AS place FROM chat WHERE {S.PROBLEM}) WHERE place <= 8 GROUP BY session_id),
proof AS (SELECT session_id, list(event_id ORDER BY event_id) AS ids FROM (SELECT *, {_FIRST} AS place FROM chat WHERE {S.HAS_TEXT}) WHERE place <= 20 AND {S.CHUNK_TEXT} GROUP BY session_id),
sums AS (SELECT session_id, ids, concat_ws(chr(10), 'Session: ' || session_id, 'Project: ' || coalesce(cwd, ''), 'Topic: ' || {S.short('coalesce(user_goal, cwd, session_id)', 80)}, 'User goal: ' || user_goal, 'Key steps:', coalesce(steps.part, '- None'), 'Files:', coalesce(files.part, '- None'), 'Problems:', coalesce(faults.part, '- None'), 'Next steps:', '- Add more sessions, then re-run search and export to build the archive.') AS text
  FROM sess JOIN proof USING (session_id) LEFT JOIN goal USING (session_id) LEFT JOIN steps USING (session_id) LEFT JOIN files USING (session_id) LEFT JOIN faults USING (session_id)),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY kind, turn_index) AS place FROM (SELECT session_id || ':session-summary' AS chunk_id, 0 AS kind, session_id, NULL::BIGINT AS turn_index, text, ids, 0 AS o FROM sums UNION ALL SELECT chunk_id, 1, session_id, turn_index, text, ids, 0 FROM tc)) WHERE place <= 12),
others AS (SELECT session_id || ':evidence-' || event_id AS chunk_id, 2 AS kind, session_id, turn_index, 'Event: ' || event_id || chr(10) || 'Type: ' || coalesce(sub_type, top_type) || chr(10) || 'Timestamp: ' || chr(10) || chr(10) || text_content AS text, event_id AS o FROM chat WHERE {S.CHUNK_TEXT} AND event_id NOT IN (SELECT unnest(ids) FROM firsts)),
chosen AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY kind, CASE WHEN kind = 1 THEN turn_index END, o) AS place FROM (SELECT chunk_id, kind, session_id, turn_index, text, o FROM firsts UNION ALL SELECT * FROM others))"""


@_query(f"WITH {S.CHAT}, {_TURNS}, {_SUMMARIES} SELECT chunk_id, (['session_summary', 'turn_summary', 'evidence'])[kind + 1] AS chunk_type, session_id, coalesce(turn_index, -1) AS turn_index, {S.trim('text', 1200)} AS text, length(text) > 1200 AS truncated, length({S.trim('text', 1200)}) AS text_chars FROM chosen WHERE place <= 12")
def session_chunks(spark, d):
    return summary.build_chunks(*_chat(spark, d)).drop("evidence_event_ids").fillna(-1, ["turn_index"])


@_query(f"WITH {S.CHAT}, {_TURNS} SELECT count(*) AS documents, count(DISTINCT session_id) AS sessions, CAST(sum(length(text)) AS BIGINT) AS chars, (SELECT count(DISTINCT id) FROM (SELECT unnest(ids) AS id FROM tc)) AS evidence_events FROM tc")
def export_manifest(spark, d):
    return export.manifest(summary.turn_chunks(_chat(spark, d)[1]))


@_query()
def export_pages(spark, d):
    return export.export_plan(export.render_vault(*_chat(spark, d)), "fail")


@_query(f"WITH {S.CHAT}, tl AS (SELECT session_id, string_agg('## Event ' || event_id || ' - ' || concat_ws(' / ', coalesce(sub_type, top_type), role) || chr(10) || chr(10) || coalesce(text_content, '') || chr(10), chr(10) ORDER BY event_id) AS body FROM chat GROUP BY session_id) SELECT session_id, session_id || '.md' AS name, '# Session ' || session_id || chr(10) || chr(10) || '- Project: ' || cwd || chr(10) || '- First seen: ' || first_seen_at || chr(10) || '- Updated: ' || updated_at || chr(10) || chr(10) || coalesce(body, '') AS text FROM sess LEFT JOIN tl USING (session_id)")
def export_timelines(spark, d):
    se, ev = _chat(spark, d)
    return export.render_markdown(se, ev)


# ---- pairs, imports, queues ----


@_query(f"WITH {S.CALLS} SELECT path, line_no, code, call_id FROM warn")
def pairing_warnings(spark, d):
    return _warnings(spark, d).select("path", "line_no", "code", "call_id")


@_query(f"WITH {S.CALLS}, g AS (SELECT path, call_id, count(*) FILTER (WHERE kind = 'call') AS c, count(*) FILTER (WHERE kind = 'output') AS o FROM calls GROUP BY ALL) SELECT path, count(*) FILTER (WHERE c = 0 AND o > 0) AS orphans, count(*) FILTER (WHERE c > 0 AND o > 1) AS duplicates, count(*) FILTER (WHERE c > 0 AND o = 0) AS missing FROM g GROUP BY path")
def pairing_summary(spark, d):
    return pairing.pairing_summary(T.call_events(T.table(spark, d, "events")))


def _files(spark, d):
    """Users as files; what they did before 20 January, and not those of every fifth, is imported."""
    events = T.table(spark, d, "events")
    files = events.groupBy(F.col("user_id").cast("string").alias("path")).agg(F.max("ts").alias("mtime"), F.count("*").alias("bytes"), F.sha2(F.max("ts").cast("string"), 256).alias("raw_sha256"))
    log = events.where("ts < timestamp '2024-01-20 00:00:00' and user_id % 5 <> 0").groupBy(F.col("user_id").cast("string").alias("raw_path")).agg(F.max("ts").alias("imported_at"), F.sha2(F.max("ts").cast("string"), 256).alias("raw_sha256"), F.when(F.max("user_id") % 7 == 0, 7).otherwise(8).alias("parse_version"))
    return files, log.withColumn("status", F.lit("imported"))


_FILES = "fl AS (SELECT CAST(user_id AS VARCHAR) AS path, max(ts) AS mtime, count(*) AS bytes FROM events GROUP BY user_id), lg AS (SELECT CAST(user_id AS VARCHAR) AS path, max(ts) AS imported_at, CASE WHEN user_id % 7 = 0 THEN 7 ELSE 8 END AS v FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' AND user_id % 5 <> 0 GROUP BY user_id)"


@_query(f"WITH {_FILES} SELECT path, bytes, CASE WHEN lg.path IS NULL THEN 'not_imported' WHEN v <> 8 THEN 'parser_version_changed' WHEN mtime > imported_at + INTERVAL 1 SECOND THEN 'modified_after_import' END AS reason FROM fl LEFT JOIN lg USING (path)")
def freshness(spark, d):
    files, log = _files(spark, d)
    return ingest.freshness(files, log, 8).select("path", "bytes", "reason")


@_query(f"WITH {_FILES} SELECT fl.path FROM fl LEFT JOIN lg ON fl.path = lg.path AND mtime = imported_at AND v = 8 WHERE lg.path IS NULL")
def files_to_import(spark, d):
    files, log = _files(spark, d)
    return ingest.files_to_import(files, log, 8).select("path")


def _requests(spark, d):
    """Events as requests: the user as the source, the type as the reason, and a status by id."""
    status = F.element_at(F.array(*[F.lit(s) for s in ("pending", "processing", "completed", "failed", "pending")]), (F.col("event_id") % 5 + 1).cast("int"))
    return T.table(spark, d, "events").select(F.col("event_id").alias("request_id"), (F.col("user_id") % 11).alias("source"), F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("home-"), F.col("user_id") % 3)).alias("home"), F.col("event_type").alias("reason"), status.alias("status"), F.col("ts").alias("created_at"), F.lit(0).cast("long").alias("attempts"), F.lit(None).cast("string").alias("message"))


_REQUESTS = "rq AS (SELECT event_id AS request_id, user_id % 11 AS source, CASE WHEN user_id % 3 <> 0 THEN 'home-' || (user_id % 3) END AS home, event_type AS reason, (['pending', 'processing', 'completed', 'failed', 'pending'])[CAST(event_id % 5 + 1 AS INTEGER)] AS status, ts AS created_at FROM events)"


@_query(f"WITH {_REQUESTS}, r AS (SELECT *, row_number() OVER (PARTITION BY source, home, reason, status IN ('pending', 'processing') ORDER BY created_at, request_id) AS place FROM rq) SELECT request_id, source, home, reason, status FROM r WHERE status NOT IN ('pending', 'processing') OR place = 1")
def dedupe_requests(spark, d):
    return ingest.dedupe_requests(_requests(spark, d)).select("request_id", "source", "home", "reason", "status")


@_query(f"WITH {_REQUESTS} SELECT request_id, source FROM rq WHERE status = 'pending' ORDER BY created_at, request_id LIMIT 100")
def queue_pending(spark, d):
    return ingest.queue_pending(_requests(spark, d)).select("request_id", "source")


@_query(f"WITH {_REQUESTS} SELECT source, arg_max(request_id, (created_at, request_id)) AS request_id FROM rq GROUP BY source")
def queue_latest(spark, d):
    return ingest.queue_latest(_requests(spark, d)).select("source", "request_id")


@_query(f"WITH {_REQUESTS}, t AS (SELECT request_id FROM rq WHERE status = 'pending' ORDER BY created_at, request_id LIMIT 100) SELECT request_id, CASE WHEN t.request_id IS NULL THEN status WHEN request_id % 2 = 0 THEN CASE WHEN request_id % 3 = 0 THEN 'failed' ELSE 'completed' END ELSE 'processing' END AS status, CAST(t.request_id IS NOT NULL AS BIGINT) AS attempts, CASE WHEN t.request_id IS NOT NULL AND request_id % 2 = 0 THEN 'done' END AS message FROM rq LEFT JOIN t USING (request_id)")
def queue_step(spark, d):
    requests = _requests(spark, d)
    results = requests.where("request_id % 2 = 0").select("request_id", F.when(F.col("request_id") % 3 == 0, 1).otherwise(0).alias("failed"), F.lit("done").alias("message"))
    return ingest.queue_step(requests, results).select("request_id", "status", "attempts", "message")


# ---- histories ----


def _history(spark, d):
    """Orders as snapshots: the customer's tenth as the archive, the priority as the profile."""
    profile = F.element_at(F.array(F.lit("core"), F.lit("evidence"), F.lit("forensic")), (F.substring("o_orderpriority", 1, 1).cast("int") % 3 + 1))
    return T.table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("archive"), profile.alias("profile"), F.col("o_orderdate").alias("generated_at"), F.col("o_orderkey").alias("tie"))


_HISTORY = "hs AS (SELECT o_custkey % 10 AS archive, (['core', 'evidence', 'forensic'])[CAST(substring(o_orderpriority, 1, 1) AS INTEGER) % 3 + 1] AS profile, o_orderdate AS generated_at, o_orderkey AS tie FROM orders)"
_COVERS = "cv(tier, profile) AS (VALUES ('core', 'core'), ('core', 'evidence'), ('core', 'forensic'), ('evidence', 'evidence'), ('evidence', 'forensic'), ('forensic', 'forensic'))"


@_query(f"WITH {_HISTORY} SELECT tie, row_number() OVER (ORDER BY generated_at DESC, tie DESC) <= 100 AS keep FROM hs")
def keep_latest(spark, d):
    return history.keep_latest(_history(spark, d), 100, "generated_at", "tie").select("tie", "keep")


@_query(f"WITH {_HISTORY} SELECT tie, row_number() OVER (PARTITION BY profile ORDER BY generated_at DESC, tie DESC) <= CASE profile WHEN 'core' THEN 3 WHEN 'evidence' THEN 2 ELSE 1 END AS keep FROM hs")
def keep_latest_by_group(spark, d):
    return history.keep_latest_by(_history(spark, d), "profile", "generated_at", "tie", C.KEEP_BY_PROFILE).select("tie", "keep")


@_query(f"WITH {_HISTORY}, {_COVERS} SELECT archive, tier, arg_max(tie, (generated_at, tie)) AS snapshot_id FROM hs JOIN cv USING (profile) GROUP BY archive, tier")
def latest_covering(spark, d):
    return history.latest_covering(_history(spark, d), "archive", "generated_at", "tie").select("archive", "tier", "snapshot_id")


@_query(f"WITH {S.CHAT}, {S.CALLS}, {_FILES} SELECT (SELECT count(*) FROM sess) AS sessions, (SELECT max(updated_at) FROM sess) AS updated_at, (SELECT count(*) FROM chat) AS events, (SELECT count(*) FROM warn) AS warnings, (SELECT count(DISTINCT text) FROM documents) AS blobs, (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT DISTINCT text, octet_length(encode(text)) AS n FROM documents)) AS original_bytes, (SELECT count(*) FROM fl) AS source_files, (SELECT CAST(sum(bytes) AS BIGINT) FROM fl) AS source_bytes, (SELECT strftime(max(mtime), '%Y-%m-%d %H:%M:%S') FROM fl) AS source_latest")
def fingerprint(spark, d):
    one = history.fingerprint(*_chat(spark, d), _warnings(spark, d), blobs.blobs(T.table(spark, d, "documents"), "text"), _files(spark, d)[0])
    return one.select("*", F.col("source.files").alias("source_files"), F.col("source.bytes").alias("source_bytes"), F.date_format("source.latest_mtime", "yyyy-MM-dd HH:mm:ss").alias("source_latest")).drop("source")


def _state(key):
    return F.struct((F.col(key) % 3).alias("sessions"), (F.col(key) % 2).alias("events"), F.lit(0).cast("long").alias("warnings"), F.lit(None).cast("string").alias("updated_at"), (F.col(key) % 5).alias("blobs"), F.lit(0).cast("long").alias("original_bytes"), F.lit("s").alias("source"))


@_query(f"WITH {_HISTORY}, p AS (SELECT archive, arg_max(tie, (generated_at, tie)) AS a, arg_min(tie, (generated_at, tie)) AS b FROM hs GROUP BY archive) SELECT archive, a % 6 <> b % 6 OR a % 5 <> b % 5 AS changed FROM p")
def changed_since(spark, d):
    ends = _history(spark, d).groupBy("archive").agg(F.max_by("tie", F.struct("generated_at", "tie")).alias("a"), F.min_by("tie", F.struct("generated_at", "tie")).alias("b"))
    return history.changed_since(ends.select("archive", _state("a").alias("now"), _state("b").alias("then")), "evidence").select("archive", "changed")


_DUE = "DATE '1998-08-20'"


@_query(f"""WITH {_HISTORY}, {_COVERS}, l AS (SELECT archive, tier, max(generated_at) AS g, arg_max(tie, (generated_at, tie)) AS t FROM hs JOIN cv USING (profile) GROUP BY archive, tier),
w AS (SELECT archive, min(generated_at) AS oldest FROM hs GROUP BY archive),
j AS (SELECT w.archive, oldest, c.g AS cg, c.t AS ct, e.g AS eg, e.t AS et, f.g AS fg, f.t AS ft FROM w LEFT JOIN l c ON c.archive = w.archive AND c.tier = 'core' LEFT JOIN l e ON e.archive = w.archive AND e.tier = 'evidence' LEFT JOIN l f ON f.archive = w.archive AND f.tier = 'forensic'),
r AS (SELECT archive, CASE
  WHEN date_diff('day', oldest::DATE, {_DUE}) >= 30 AND (fg IS NULL OR date_diff('day', fg::DATE, {_DUE}) >= 30) AND (ft IS NULL OR ft % 6 <> archive % 6 OR ft % 5 <> archive % 5) THEN 'monthly_forensic_due'
  WHEN (eg IS NULL OR date_diff('day', eg::DATE, {_DUE}) >= 7) AND (et IS NULL OR et % 6 <> archive % 6 OR et % 5 <> archive % 5) THEN 'weekly_evidence_due'
  WHEN (cg IS NULL OR date_diff('day', cg::DATE, {_DUE}) >= 1) AND (ct IS NULL OR ct % 6 <> archive % 6) THEN 'daily_core_due' ELSE 'fresh_or_unchanged' END AS reason FROM j)
SELECT archive, CASE reason WHEN 'monthly_forensic_due' THEN 'forensic' WHEN 'weekly_evidence_due' THEN 'evidence' WHEN 'daily_core_due' THEN 'core' END AS profile, reason FROM r""")
def due_tier(spark, d):
    past = _history(spark, d).withColumn("state", _state("tie"))
    state = past.select("archive").distinct().select("archive", _state("archive").alias("now"))
    return history.due_tier(past, state, "archive", F.to_date(F.lit("1998-08-20")))
