"""Queries over transcripts: conversations, written as lines of all record shapes, are parsed, imported and stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillmill import storage
from quillmill.operators import archive, blobs, hot, ingest, normalize, stats, vectors
from quillmill.plans.queries import _query
from quillmill.sources import tables as T
from quillmill.sources import transcripts

#: Files into which conversations go, each one session.
FILES = 40


def _lines(spark, d) -> DataFrame:
    """file, line_no, value: a session's metadata, and each turn as one of ten kinds of line."""
    talk = T.table(spark, d, "conversations").select("conv_id", "turn", "role", "text", (F.col("conv_id") % FILES).alias("f"), ((F.col("conv_id") * 7 + F.col("turn")) % 10).alias("k"))
    talk = talk.withColumn("line_no", F.row_number().over(W.partitionBy("f").orderBy("conv_id", "turn")) + 1)
    at = F.concat(F.lit("t"), F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lpad(F.col("turn").cast("string"), 4, "0"))
    text, call = F.col("text"), F.concat(F.lit("c"), "conv_id")
    record = lambda kind, **payload: F.to_json(F.struct(F.lit(kind).alias("type"), at.alias("timestamp"), F.struct(*[v.alias(n) for n, v in payload.items()]).alias("payload")))
    k = F.col("k")
    value = (
        F.when(k == 0, record("event_msg", type=F.lit("user_message"), message=text))
        .when(k == 1, record("response_item", type=F.lit("message"), role=F.col("role"), content=F.array(F.struct(F.lit("output_text").alias("type"), text.alias("text")), F.struct(F.lit("mark").alias("type"), F.lit(None).cast("string").alias("text")))))
        .when(k == 2, record("response_item", type=F.lit("function_call"), name=F.lit("shell"), call_id=call, arguments=text))
        .when(k == 3, record("response_item", type=F.lit("function_call_output"), call_id=call, output=F.repeat(F.concat(text, F.lit(" ")), 12)))
        .when(k == 4, F.to_json(F.struct(F.lit("message").alias("type"), "role", text.alias("content"))))
        .when(k == 5, record("compacted", message=text, replacement_history=F.array(F.lit("a"), F.lit("b"))))
        .when(k == 6, F.concat(F.lit('{"type": '), F.regexp_replace(text, r"\s+", " ")))
        .when(k == 7, F.concat(F.lit("["), F.col("conv_id"), F.lit("]")))
        .when(k == 8, record("novel", a=F.lit(1)))
        .otherwise(record("event_msg", type=F.lit("token_count"), info=F.struct(F.lit(1).alias("n"))))
    )
    f = F.col("f")
    meta = (
        F.when(f % 4 != 3, F.to_json(F.struct(F.lit("session_meta").alias("type"), F.lit("t").alias("timestamp"), F.struct(F.concat(F.lit("s-"), f).alias("id"), F.concat(F.lit("/w/"), f).alias("cwd")).alias("payload"))))
        .otherwise(F.to_json(F.struct(F.lit("session_meta").alias("type"), F.lit("t").alias("timestamp"), F.struct(F.concat(F.lit("/w/"), f).alias("cwd")).alias("payload"))))
    )
    # the metadata comes with the first turn, not by a union: Spark 4.1 takes a union of two sides that are dealt by f as
    # dealt by f, leaves out a later repartition("f"), and yet may read the sides in partitions of their own
    line = lambda number, text: F.struct(number.cast("int").alias("line_no"), text.alias("value"))
    own = line(F.col("line_no"), value)
    return talk.select("f", F.inline(F.when(F.col("line_no") == 2, F.array(line(F.lit(1), meta), own)).otherwise(F.array(own))))


def _paths(lines: DataFrame) -> DataFrame:
    """path, line_no, value, as a scan of the files gives them."""
    folder = F.when(F.col("f") % 5 == 0, "archived_sessions").otherwise("sessions")
    return lines.select(F.concat(F.lit("/home/"), folder, F.lit("/"), F.col("f"), F.lit(".jsonl")).alias("path"), "line_no", "value")


def _parsed(spark, d):
    """(events, warnings) of all lines, parsed once in an application: what follows does not parse again."""

    def make(path: str) -> None:
        for df, name in zip(ingest.parse_lines(_paths(_lines(spark, d))), ("events", "warnings")):
            df.write.parquet(f"{path}/{name}")

    path = storage.kept(spark, "parsed", f"{d}/conversations.parquet", make)
    return spark.read.parquet(f"{path}/events"), spark.read.parquet(f"{path}/warnings")


def _stem():
    return F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).cast("long")


#: All lines, from the table's own columns.
_SQL = f"""t AS (
  SELECT conv_id % {FILES} AS f, row_number() OVER (PARTITION BY conv_id % {FILES} ORDER BY conv_id, turn) + 1 AS line_no, conv_id, turn, role, text, (conv_id * 7 + turn) % 10 AS k FROM conversations),
l AS (
  SELECT f, line_no, k, text, role, conv_id, 't' || lpad(conv_id::VARCHAR, 8, '0') || lpad(turn::VARCHAR, 4, '0') AS seen FROM t
  UNION ALL SELECT DISTINCT f, 1, -1, NULL, NULL, NULL, 't' FROM t),
named AS (SELECT *, CASE WHEN f % 4 <> 3 THEN 's-' || f ELSE f::VARCHAR END AS session_id FROM l),
ev AS (
  SELECT f AS file, session_id, line_no, k, conv_id,
    CASE WHEN k = 4 THEN 'legacy' WHEN k = 8 THEN 'unknown' ELSE 'current' END AS shape,
    CASE WHEN k = 4 THEN NULL ELSE seen END AS timestamp,
    CASE WHEN k = -1 THEN 'session_meta' WHEN k IN (0, 9) THEN 'event_msg' WHEN k IN (1, 2, 3) THEN 'response_item' WHEN k = 4 THEN 'legacy' WHEN k = 5 THEN 'compacted' ELSE 'unknown' END AS top_type,
    CASE k WHEN 0 THEN 'user_message' WHEN 1 THEN 'message' WHEN 2 THEN 'function_call' WHEN 3 THEN 'function_call_output' WHEN 4 THEN 'message' WHEN 9 THEN 'token_count' END AS sub_type,
    CASE WHEN k IN (1, 4) THEN role WHEN k = 5 THEN 'assistant' END AS role,
    CASE WHEN k IN (2, 3) THEN 'c' || conv_id END AS call_id,
    CASE WHEN k = 2 THEN 'shell' END AS tool_name,
    CASE WHEN k = -1 THEN '/w/' || f END AS file_path,
    nullif(CASE WHEN k IN (0, 1, 4, 5) THEN text WHEN k = 2 THEN rtrim('shell ' || text, '') WHEN k = 3 THEN repeat(text || ' ', 12) END, '') AS text_content
  FROM named WHERE k NOT IN (6, 7)),
wa AS (
  SELECT f AS file, line_no, CASE k WHEN 6 THEN 'invalid_json' WHEN 7 THEN 'non_object_record' ELSE 'unknown_current_type' END AS code,
    CASE k WHEN 6 THEN substring('{{"type": ' || regexp_replace(text, '\\s+', ' ', 'g'), 1, 1000) WHEN 7 THEN '[' || conv_id || ']' END AS raw_excerpt
  FROM named WHERE k IN (6, 7, 8))"""


@_query(f"WITH {_SQL} SELECT file, line_no, shape, timestamp, top_type, sub_type, role, call_id, tool_name, file_path, text_content FROM ev")
def transcript_events(spark, d):
    """Lines of all shapes as events, their columns and texts lifted."""
    columns = "shape timestamp top_type sub_type role call_id tool_name file_path text_content".split()
    return _parsed(spark, d)[0].select(_stem().alias("file"), "line_no", *columns)


@_query(f"WITH {_SQL} SELECT file, line_no, code, raw_excerpt FROM wa UNION ALL SELECT DISTINCT file, 0, 'missing_session_id', NULL FROM ev WHERE file % 4 = 3")
def transcript_warnings(spark, d):
    """What is no JSON, no object, of an unknown type, or in a file that names no session."""
    events, broken = _parsed(spark, d)
    unnamed = normalize.assign_sessions(events)[1]
    excerpt = F.when(F.col("code") != "unknown_current_type", F.col("raw_excerpt"))
    return broken.unionByName(unnamed).select(_stem().alias("file"), "line_no", "code", excerpt.alias("raw_excerpt"))


@_query(f"WITH {_SQL} SELECT file, session_id, min('/w/' || file) AS cwd, 't' AS first_seen_at, coalesce(arg_max(timestamp, line_no) FILTER (WHERE timestamp IS NOT NULL), 't') AS updated_at, count(*) AS event_count, bool_or(k = 4) AS legacy, file % 5 = 0 AS archived, 'unknown' AS source_kind FROM ev GROUP BY file, session_id")
def transcript_sessions(spark, d):
    """Files as sessions: named by the first line that does, rolled up by line."""
    events, warnings = _parsed(spark, d)
    named, unnamed = normalize.assign_sessions(events)
    return normalize.roll_up_sessions(named, warnings.unionByName(unnamed)).select(_stem().alias("file"), "session_id", "cwd", "first_seen_at", "updated_at", "event_count", "legacy", "archived", "source_kind")


_STATE = "side AS (SELECT DISTINCT conv_id % 40 AS file, CASE WHEN conv_id % 40 % 6 = 0 THEN 'n-' || conv_id % 40 END AS id FROM conversations)"


@_query(f"WITH {_SQL}, {_STATE} SELECT DISTINCT ev.file, coalesce(side.id, session_id) AS session_id, '/w/' || ev.file AS cwd, ev.file % 5 = 0 OR ev.file % 2 = 0 AS archived, CASE WHEN ev.file % 3 = 0 THEN 'cli' ELSE 'unknown' END AS source_kind, 'title ' || ev.file AS title FROM ev JOIN side ON side.file = ev.file")
def transcript_state(spark, d):
    """Sessions with what a side table says of their files."""
    events, warnings = _parsed(spark, d)
    found = normalize.roll_up_sessions(normalize.assign_sessions(events)[0], warnings)
    f = F.col("conv_id") % FILES
    side = T.table(spark, d, "conversations").select(f.alias("f")).distinct().select(
        F.when(F.col("f") % 6 == 0, F.concat(F.lit("n-"), "f")).alias("id"), F.concat(F.lit("/home/"), F.when(F.col("f") % 5 == 0, "archived_sessions").otherwise("sessions"), F.lit("/"), F.col("f"), F.lit(".jsonl")).alias("rollout_path"),
        F.when(F.col("f") % 3 == 0, "cli").alias("source"), F.lit("/elsewhere").alias("cwd"), F.concat(F.lit("title "), "f").alias("title"), (F.col("f") % 2 == 0).alias("archived"),
    )
    return normalize.enrich(found, transcripts.thread_state(side)).select(_stem().alias("file"), "session_id", "cwd", "archived", "source_kind", "state.title")


@_query(f"WITH {_SQL} SELECT file, line_no, row_number() OVER (ORDER BY file % 5 = 0, CASE WHEN file % 5 = 0 THEN '/home/archived_sessions/' ELSE '/home/sessions/' END || file || '.jsonl', line_no) AS event_id FROM ev")
def transcript_event_ids(spark, d):
    """Ids by place of file and line, from counts by file."""
    return normalize.assign_event_ids(_parsed(spark, d)[0]).select(_stem().alias("file"), "line_no", "event_id")


@_query(f"WITH {_SQL} SELECT e.file, e.n AS events, coalesce(w.n, 0) AS warnings, e.current, e.legacy, e.unknown, coalesce(w.invalid, 0) AS invalid FROM (SELECT file, count(*) AS n, count(*) FILTER (WHERE shape = 'current') AS current, count(*) FILTER (WHERE shape = 'legacy') AS legacy, count(*) FILTER (WHERE shape = 'unknown') AS unknown FROM ev GROUP BY file) e LEFT JOIN (SELECT file, count(*) AS n, count(*) FILTER (WHERE code = 'invalid_json') AS invalid FROM wa GROUP BY file) w ON w.file = e.file")
def file_samples(spark, d):
    """Events and warnings of each file, in all and by kind."""
    found = normalize.sample_files(*_parsed(spark, d))
    of = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0))
    return found.select(_stem().alias("file"), "events", "warnings", *[of("classifications", k).alias(k) for k in ("current", "legacy", "unknown")], of("warning_codes", "invalid_json").alias("invalid"))


@_query(f"WITH {_SQL} SELECT file, line_no, CASE WHEN top_type = 'unknown' AND conv_id % 3 = 0 THEN 'world_state' ELSE top_type END AS top_type FROM ev")
def repaired_types(spark, d):
    """Events that were filed as unknown, of a type that is known by now, retyped."""
    events = normalize.assign_sessions(_parsed(spark, d)[0])[0]
    conv = F.regexp_extract("timestamp", "^t(.{8})", 1).cast("long")
    warnings = events.where("top_type = 'unknown'").select("session_id", "line_no", F.lit("unknown_current_type").alias("code"), F.concat(F.lit("unknown type: "), F.when(conv % 3 == 0, "world_state").otherwise("novel")).alias("message"))
    return normalize.repair_types(events, warnings)[0].select(_stem().alias("file"), "line_no", "top_type")


_HOT = f"""{_SQL}, stored AS (
  SELECT file, session_id, line_no, k, CASE WHEN k = 9 THEN 'noise' WHEN k IN (3, -1) THEN 'evidence' WHEN k = 8 THEN 'quarantine' ELSE 'core' END AS storage_class,
    CASE WHEN k = 9 THEN NULL WHEN k = 3 AND length(text_content) > 2000 THEN substring(text_content, 1, 1200) || chr(10) || '[... ' || (length(text_content) - 2000) || ' chars stored in cold evidence ...]' || chr(10) || right(text_content, 800) ELSE text_content END AS text_content,
    length(coalesce(text_content, '')) AS text_original_chars, k IN (3, -1, 8, 5) AS cold,
    list_sort(list_filter([CASE WHEN k IN (3, -1, 8, 5) THEN 'payload_cold' END, CASE WHEN k = 9 THEN 'payload_dropped' END, CASE WHEN k IN (1, 2, 3, -1, 5) THEN 'payload_slimmed' END, CASE WHEN k = 8 THEN 'quarantined' END, CASE WHEN k = 5 THEN 'replacement_history_externalized' END, CASE WHEN k = 9 THEN 'text_dropped' END, CASE WHEN k = 3 AND length(text_content) > 2000 THEN 'text_truncated' END], lambda x: x IS NOT NULL)) AS flags,
    text_content AS original, call_id FROM ev)"""


@_query(f"WITH {_HOT} SELECT file, line_no, storage_class, text_content, text_original_chars, cold, array_to_string(flags, ',') AS flags, CASE WHEN k = 2 THEN length(original) - 6 END AS arguments_chars, CASE WHEN k = 2 THEN sha256(substring(original, 7)) END AS arguments_sha256, CASE WHEN k = 1 THEN length(original) END AS part_chars, CASE WHEN k = 5 THEN length(original) END AS message_chars, CASE WHEN k = 3 THEN call_id END AS kept_call FROM stored WHERE original IS NOT NULL OR k NOT IN (1, 2, 3, 5)")
def hot_columns(spark, d):
    """What the hot store keeps of each event: texts cut, payloads slim, flags, and whether a blob has the whole."""
    found = hot.to_hot(normalize.assign_sessions(_parsed(spark, d)[0])[0])
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    sub = F.col("sub_type")
    some = found.where("text_original_chars > 0 or not coalesce(sub_type in ('message', 'function_call', 'function_call_output') and top_type = 'response_item' or top_type = 'compacted', false)")
    return some.select(
        _stem().alias("file"), "line_no", "storage_class", "text_content", "text_original_chars", F.col("payload_ref").isNotNull().alias("cold"), F.array_join("content_flags", ",").alias("flags"),
        get("arguments_chars").cast("long").alias("arguments_chars"), get("arguments_sha256").alias("arguments_sha256"),
        get("content[0].chars").cast("long").alias("part_chars"), F.when(F.col("top_type") == "compacted", get("message_chars").cast("long")).alias("message_chars"), F.when(sub == "function_call_output", get("call_id")).alias("kept_call"),
    )


@_query(f"WITH {_HOT} SELECT k, count(*) AS events FROM stored WHERE cold GROUP BY k")
def hydrated_events(spark, d):
    """By kind, how many events have their whole payload and text back from the blobs."""
    events = normalize.assign_sessions(_parsed(spark, d)[0])[0].withColumn("event_id", F.xxhash64("path", "line_no"))
    whole = events.select("event_id", F.col("payload").alias("was"), F.col("text_content").alias("said"), F.when(F.col("top_type") == "session_meta", -1).when(F.col("top_type") == "compacted", 5).when(F.col("top_type") == "unknown", 8).otherwise(3).alias("k"))
    back = blobs.hydrate(hot.to_hot(events).where("payload_ref is not null"), hot.cold_blobs(events))
    same = back.join(whole, "event_id").where("payload = was and text_content <=> said")
    return same.groupBy("k").agg(F.count("*").alias("events"))


def _archive(spark, d) -> str:
    """An archive of all transcripts, imported in two parts, of which the second brings some sessions anew."""

    def make(path: str) -> None:
        root, target = f"{path}/home", f"{path}/archive"
        files = archive.Files(spark, path)
        for part, lines in enumerate((_lines(spark, d).where(f"f < {FILES // 2} or line_no <= 3"), _lines(spark, d).where(f"f >= {FILES // 2}"))):
            aside = f"{path}/part-{part}"
            lines.repartition("f").sortWithinPartitions("f", "line_no").select("f", "value").write.partitionBy("f").text(aside)
            for folder in files.names(aside):
                if folder.startswith("f="):
                    f = int(folder[2:])
                    at = f"{root}/{'archived_sessions' if f % 5 == 0 else 'sessions'}"
                    files.fs.mkdirs(files.at(at))
                    files.delete(f"{at}/{f}.jsonl")
                    (name,) = (x for x in files.names(f"{aside}/{folder}") if x.startswith("part-"))  # a file that came in parts is an error
                    files.fs.rename(files.at(f"{aside}/{folder}/{name}"), files.at(f"{at}/{f}.jsonl"))
                    if part:  # written again, and so with a later time than its import, whatever the clock
                        files.fs.setTimes(files.at(f"{at}/{f}.jsonl"), 4_000_000_000_000, -1)
            ingest.sync(spark, root, target, None, 1)

    return storage.kept(spark, "transcripts", f"{d}/conversations.parquet", make) + "/archive"


@_query(f"WITH {_HOT} SELECT session_id, line_no, storage_class, text_content, text_original_chars, cold FROM stored")
def imported_events(spark, d):
    """The events of an archive after two imports, of which the second replaced sessions of the first."""
    return archive.Archive(spark, _archive(spark, d)).read("events").select("session_id", "line_no", "storage_class", F.when(~F.col("duplicate"), F.col("text_content")).alias("text_content"), "text_original_chars", F.col("payload_ref").isNotNull().alias("cold"))


@_query(f"WITH {_SQL} SELECT session_id, count(*) AS events, min(line_no) AS first_line, max(line_no) AS last_line FROM ev GROUP BY session_id")
def imported_sessions(spark, d):
    """Sessions of the archive with what its events hold of them."""
    now = archive.Archive(spark, _archive(spark, d))
    counted = now.read("events").groupBy("session_id").agg(F.count("*").alias("events"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    return now.read("sessions").select("session_id").join(counted, "session_id")


@_query(f"WITH {_SQL}, files AS (SELECT DISTINCT file FROM ev) SELECT file, 'imported' AS status, CASE WHEN file >= {FILES // 2} THEN 2::BIGINT ELSE 1::BIGINT END AS times FROM files")
def import_log(spark, d):
    """How often each file was imported: those of the second part were read twice."""
    log = archive.Archive(spark, _archive(spark, d)).read("log")
    return log.groupBy(F.regexp_extract("raw_path", r"([^/]+)\.jsonl$", 1).cast("long").alias("file"), "status").agg(F.count("*").alias("times"))


@_query(f"WITH {_HOT} SELECT count(DISTINCT session_id) AS sessions, count(*) AS events, count(*) FILTER (WHERE k = 2) AS tool_calls, count(DISTINCT CASE WHEN k = -1 THEN file END) AS files, coalesce(sum(length(text_content)), 0)::BIGINT AS raw_chars, true AS digest_holds FROM stored")
def imported_statistics(spark, d):
    """Counts of the archive from its sessions' own statistics, and whether their digest is that of its events."""
    now = archive.Archive(spark, _archive(spark, d))
    whole = stats.archive_digest(now.read("events")).select(F.col("digest").alias("exact"))
    return stats.stored_statistics(now.read("statistics")).join(F.broadcast(whole)).select("sessions", "events", "tool_calls", "files", "raw_chars", (F.col("digest") == F.col("exact")).alias("digest_holds"))


@_query("SELECT t.name AS table_name, true AS equal FROM (VALUES ('events'), ('digest'), ('blobs')) t(name) WHERE EXISTS (SELECT 1 FROM conversations)")
def rebuild_checks(spark, d):
    """The checks of the archive, rebuilt at a new path from its blobs."""
    target = storage.new_path(spark, "rebuilt")
    return ingest.rebuild_archive(spark, _archive(spark, d), target).select(F.col("table").alias("table_name"), "equal")


_MANY = "q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT query_id, vec_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * e[i]::DOUBLE)), 6) AS score FROM embeddings, q)"


@_query(f"WITH {_MANY} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM p WHERE score > 0 QUALIFY rank <= 10")
def vector_topk_many(spark, d):
    """The nearest of all vectors to each of many queries at once."""
    table = T.table(spark, d, "embeddings")
    return vectors.vector_topk_many(table, table.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), "vec_id", "query_id", "embedding", 10)


@_query(f"WITH {_SQL} SELECT count(DISTINCT file) AS files, (SELECT count(*) FROM ev) AS events, (SELECT count(*) FROM wa) AS warnings FROM ev")
def corpus_audit(spark, d):
    """Files, events and warnings of all samples."""
    return normalize.sample_files(*_parsed(spark, d)).agg(F.count("*").alias("files"), F.sum("events").alias("events"), F.sum("warnings").alias("warnings"))
