"""Records of transcripts as sessions, events and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillmill.functions import constants as C


def _get(path: str, base: str = "rec") -> Column:
    return F.expr(f"try_variant_get({base}, '$.{path}', 'string')")


def _some(column: Column) -> Column:
    return F.when(column != "", column)


def _kind(path: str, base: str = "rec") -> Column:
    return F.expr(f"coalesce(schema_of_variant(try_variant_get({base}, '$.{path}', 'variant')), 'VOID')")


def _string(path: str, base: str = "rec") -> Column:
    """The value at a path if it is a non-empty string."""
    return F.when(_kind(path, base) == "STRING", _some(_get(path, base)))


def _first(*paths: str, base: str = "rec") -> Column:
    return F.coalesce(*[_string(p, base) for p in paths])


def parts_text(path: str, keys: tuple[str, ...] = ("text", "content", "message"), base: str = "rec") -> Column:
    """The text of a content: a string as it is; an object's first text, else its JSON; a list's texts, one a line."""
    texts = ", ".join(f"nullif(try_variant_get(x, '$.{k}', 'string'), '')" for k in keys)
    value = f"try_variant_get({base}, '$.{path}', 'variant')"
    one = lambda x: f"case when schema_of_variant({x}) like 'OBJECT%' then coalesce({texts.replace('(x,', f'({x},')}) when schema_of_variant({x}) = 'STRING' then cast({x} as string) end"
    listed = F.expr(f"nullif(array_join(filter(transform(try_variant_get({base}, '$.{path}', 'array<variant>'), x -> {one('x')}), t -> t is not null and t <> ''), '\\n'), '')")
    whole = F.expr(f"coalesce({texts.replace('(x,', f'({value},')}, to_json({value}))")
    kind = _kind(path, base)
    return F.when(kind == "STRING", _get(path, base)).when(kind.startswith("ARRAY"), listed).when(kind.startswith("OBJECT"), whole)


def classify(objects: DataFrame) -> DataFrame:
    """objects with shape: current, legacy, state_header or unknown."""
    has = lambda p: _kind(p) != "VOID"
    typed = _kind("type") == "STRING"
    current = typed & _kind("payload").startswith("OBJECT")
    known = _get("type").isin(C.CURRENT_TYPES)
    shape = F.when(current & known, "current").when(current, "unknown").when(_get("record_type").eqNullSafe(F.lit("state")) | typed, "legacy").when(has("id") & has("timestamp") & ~has("type"), "state_header").otherwise("unknown")
    return objects.withColumn("shape", shape).withColumn("current", current)


def _current_text() -> Column:
    top, sub = _get("type"), _get("payload.type")
    call = F.nullif(F.concat_ws(" ", _string("payload.name"), _string("payload.arguments")), F.lit(""))
    response = (
        F.when(sub == "message", F.coalesce(_some(parts_text("payload.content")), _first("payload.text")))
        .when(sub == "reasoning", F.coalesce(_some(parts_text("payload.summary", ("text", "summary"))), _some(parts_text("payload.content"))))
        .when(sub == "function_call", call)
        .when(sub == "function_call_output", _first("payload.output", "payload.text"))
        .otherwise(F.coalesce(_some(parts_text("payload.content")), _first("payload.text", "payload.output", "payload.arguments")))
    )
    return F.when(top == "compacted", _first("payload.message")).when(top == "event_msg", _first("payload.message", "payload.text", "payload.delta")).when(top == "turn_context", F.expr("to_json(try_variant_get(rec, '$.payload', 'variant'))")).when(top == "response_item", response)


def _legacy_text() -> Column:
    kind = _get("type")
    call = F.nullif(F.concat_ws(" ", _string("name"), _string("arguments")), F.lit(""))
    return F.when(kind == "message", F.coalesce(_some(parts_text("content")), _first("text", "message"))).when(kind == "function_call", call).when(kind.isNotNull() & ~_get("record_type").eqNullSafe(F.lit("state")), _first("text", "message", "output", "arguments"))


def normalize(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, warnings) of objects (path, line_no, value, rec): one select lifts the columns of every shape."""
    shaped = classify(objects)
    cur = F.col("current")
    legacy = F.col("shape").isin("legacy", "state_header")
    state = legacy & _get("record_type").eqNullSafe(F.lit("state"))
    header = F.col("shape") == "state_header"
    pick = lambda current, old: F.when(cur, current).when(legacy & ~state & ~header, old)
    top = F.when(F.col("shape") == "current", _get("type")).when(legacy, "legacy").otherwise("unknown")
    own = F.when(cur & (_get("type") == "session_meta"), _first("payload.id", "payload.session_id")).when(header, _first("id")).when(legacy & ~state, _first("session_id", "id"))
    events = shaped.select(
        "path",
        "line_no",
        "shape",
        own.alias("own_session_id"),
        F.coalesce(_first("timestamp"), F.when(cur, _first("payload.timestamp"))).alias("timestamp"),
        top.alias("top_type"),
        F.when(cur, _string("payload.type")).when(state, "state").when(header, "session_header").when(legacy, _string("type")).alias("sub_type"),
        pick(F.coalesce(_string("payload.role"), F.when(_get("type") == "compacted", "assistant")), _string("role")).alias("role"),
        pick(_string("payload.call_id"), _string("call_id")).alias("call_id"),
        pick(_first("payload.name", "payload.tool_name"), _first("name", "tool_name")).alias("tool_name"),
        pick(_first("payload.file_path", "payload.path", "payload.cwd"), _first("file_path", "path", "cwd")).alias("file_path"),
        F.when(cur, _current_text()).when(legacy & ~header, _legacy_text()).alias("text_content"),
        F.when(cur, F.expr("to_json(try_variant_get(rec, '$.payload', 'variant'))")).otherwise(F.expr("to_json(rec)")).alias("payload"),
    )
    code = F.when(cur, "unknown_current_type").otherwise("unknown_record")
    warnings = shaped.where(F.col("shape") == "unknown").select("path", "line_no", code.alias("code"), F.substring("value", 1, 1000).alias("raw_excerpt"))
    return events, warnings


def assign_sessions(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with session_id, warnings): a file has the id that its first line with one names, else its stem."""
    ids = events.groupBy("path").agg(F.min_by("own_session_id", F.when(F.col("own_session_id").isNotNull(), F.col("line_no"))).alias("found"))
    stem = F.regexp_extract("path", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    named = ids.withColumn("session_id", F.coalesce("found", stem))
    warnings = ids.where("found is null").select("path", F.lit(0).alias("line_no"), F.lit("missing_session_id").alias("code"), F.lit(None).cast("string").alias("raw_excerpt"))
    return events.join(named.select("path", "session_id"), "path").drop("own_session_id"), warnings


def roll_up_sessions(events: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row for each file: the first values of its metadata by line, first and last seen by line, and counts by shape."""
    meta = F.col("top_type") == "session_meta"
    field = lambda *keys: F.coalesce(*[F.nullif(F.get_json_object("payload", f"$.{k}"), F.lit("")) for k in keys])
    first = lambda value: F.min_by(value, F.when(meta & value.isNotNull(), F.col("line_no")))
    seen = F.when(F.col("timestamp").isNotNull(), F.col("line_no"))
    base = events.groupBy("path", "session_id").agg(
        first(field("cwd")).alias("cwd"),
        first(field("forked_from_id", "parent_session_id")).alias("parent_session_id"),
        first(field("model_provider")).alias("model_provider"),
        first(field("source")).alias("source_kind"),
        F.min_by("timestamp", seen).alias("first_seen_at"),
        F.max_by("timestamp", seen).alias("updated_at"),
        F.count("*").alias("event_count"),
        F.bool_or(F.col("shape").isin("legacy", "state_header")).alias("legacy"),
        (~F.bool_or(meta)).alias("missing_session_meta"),
    )
    kinds = events.select("path", F.col("shape").alias("kind")).union(warnings.where(F.col("code").isin("invalid_json", "non_object_record")).select("path", "code"))
    counts = kinds.groupBy("path", "kind").agg(F.count("*").alias("n")).groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("classifications"))
    return base.join(counts, "path", "left").withColumn("archived", F.col("path").contains("/archived_sessions/")).fillna("unknown", ["source_kind"])


def last_files(sessions: DataFrame) -> DataFrame:
    """Sessions of which two files tell: the last file by (archived, path) has it."""
    place = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc(F.col("path").contains("/archived_sessions/")), F.desc("path")))
    return sessions.withColumn("place", place).where("place = 1").drop("place")


def enrich(sessions: DataFrame, state: DataFrame) -> DataFrame:
    """Sessions with what a side table says of their files: it names the session, and fills what is missing."""
    s = state.select(*[F.col(c).alias(f"s_{c}") for c in state.columns])
    joined = sessions.join(s, sessions["path"] == s["s_rollout_path"], "left")
    return (
        joined.withColumn("session_id", F.coalesce("s_id", "session_id"))
        .withColumn("cwd", F.coalesce("cwd", "s_cwd"))
        .withColumn("first_seen_at", F.coalesce("first_seen_at", F.col("s_created_at").cast("string")))
        .withColumn("updated_at", F.coalesce("updated_at", F.col("s_updated_at").cast("string")))
        .withColumn("source_kind", F.when((F.col("source_kind") == "unknown") & F.col("s_source").isNotNull(), F.col("s_source")).otherwise(F.col("source_kind")))
        .withColumn("archived", F.col("archived") | F.coalesce(F.col("s_archived").cast("boolean"), F.lit(False)))
        .withColumn("state", F.struct(F.col("s_title").alias("title"), F.col("s_preview").alias("preview"), F.col("s_model").alias("model"), F.col("s_agent_path").alias("agent_path")))
        .drop(*s.columns)
    )


def assign_event_ids(events: DataFrame, after: int = 0) -> DataFrame:
    """events with event_id: ``after`` plus the place of (archived, path, line_no).

    Files are counted, and only their counts are summed up: one window over a row for each file, which serves for some
    millions of files in one import.
    """
    archived = F.col("path").contains("/archived_sessions/")
    counts = events.groupBy("path").agg(F.count("*").alias("n")).withColumn("archived", archived)
    starts = counts.select("path", F.coalesce(F.sum("n").over(W.orderBy("archived", "path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    place = F.row_number().over(W.partitionBy("path").orderBy("line_no"))
    return events.withColumn("place", place).join(starts, "path").withColumn("event_id", F.lit(after).cast("long") + F.col("start") + F.col("place")).drop("start", "place")


def repair_types(events: DataFrame, warnings: DataFrame, types: tuple[str, ...] = ("compacted", "world_state", "inter_agent_communication_metadata")) -> tuple[DataFrame, DataFrame]:
    """Events filed as unknown whose warning names a type known by now get that type; their warnings go."""
    named = F.regexp_extract("message", r"type: (\S+)$", 1)
    fixed = warnings.where((F.col("code") == "unknown_current_type") & named.isin(list(types))).select("session_id", "line_no", named.alias("right_type")).distinct()
    right = events.join(fixed, ["session_id", "line_no"], "left").withColumn("top_type", F.when((F.col("top_type") == "unknown") & F.col("right_type").isNotNull(), F.col("right_type")).otherwise(F.col("top_type")))
    right = right.withColumn("role", F.when(F.col("right_type") == "compacted", F.coalesce("role", F.lit("assistant"))).otherwise(F.col("role"))).drop("right_type")
    gone = fixed.select("session_id", "line_no", F.lit("unknown_current_type").alias("code"))
    return right, warnings.join(gone, ["session_id", "line_no", "code"], "left_anti")


def sample_files(events: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row for each file: events, warnings, and both by kind."""
    def counted(df: DataFrame, key: str, total: str, name: str) -> DataFrame:
        by = df.groupBy("path", key).agg(F.count("*").alias("n"))
        return by.groupBy("path").agg(F.sum("n").alias(total), F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))

    return counted(events, "shape", "events", "classifications").join(counted(warnings, "code", "warnings", "warning_codes"), "path", "full_outer").fillna(0, ["events", "warnings"])
