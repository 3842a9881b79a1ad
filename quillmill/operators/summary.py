"""Summaries with evidence, and chunks of them. All sessions at once; lists are ranked before they are collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillmill.functions import constants as C
from quillmill.functions.patterns import for_spark
from quillmill.functions.text import has_problem, shortened, trimmed
from quillmill.storage import written

def _is_user() -> Column:
    return F.col("sub_type").eqNullSafe(F.lit("user_message")) | F.col("role").eqNullSafe(F.lit("user"))


def _is_assistant() -> Column:
    return F.col("role").eqNullSafe(F.lit("assistant")) | F.coalesce(F.col("sub_type").isin("message", "reasoning"), F.lit(False))


def _has_text() -> Column:
    return F.coalesce("text_content", F.lit("")) != ""


def _first(events: DataFrame, n: int) -> DataFrame:
    return events.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy("event_id"))).where(F.col("place") <= n)


def session_topics(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """session_id, topic, user_goal: the first user text, or the project, or the id."""
    first = events.where(_is_user() & _has_text()).groupBy("session_id").agg(F.min_by("text_content", "event_id").alias("user_goal"))
    some = lambda c: F.when(c != "", c)
    return sessions.join(first, "session_id", "left").select("session_id", shortened(F.coalesce("user_goal", some(F.col("cwd")), "session_id"), 80).alias("topic"), "user_goal")


def key_steps(events: DataFrame) -> DataFrame:
    """session_id, list (0 user, 1 assistant), place, event_id, text: the first 3 user and 5 assistant events with text."""
    user = _first(events.where(_is_user()), 3).withColumn("list", F.lit(0))
    other = _first(events.where(_is_assistant()), 5).withColumn("list", F.lit(1))
    return user.unionByName(other).where(_has_text()).select("session_id", "list", "place", "event_id", shortened(F.col("text_content"), 180).alias("text"))


def key_commands(events: DataFrame) -> DataFrame:
    """The first 12 calls: arguments of the payload, else the text, else the tool's name."""
    payload = lambda key: F.when(F.get_json_object("payload", f"$.{key}") != "", F.get_json_object("payload", f"$.{key}"))
    command = F.coalesce(payload("arguments"), F.when(_has_text(), F.col("text_content")), payload("name"))
    return _first(events.where(F.col("sub_type") == "function_call"), 12).select("session_id", "place", "event_id", shortened(command, 220).alias("command"), F.coalesce(payload("name"), "tool_name").alias("tool"))


def files_mentioned(events: DataFrame, limit: int = 20) -> DataFrame:
    """session_id, place, path, event_id: each path once, where it is mentioned first, the first of a session."""
    text = F.coalesce("text_content", F.lit(""))
    named = F.lit(False)
    for ending in C.FILE_ENDINGS:  # most texts name no file: a search for fixed strings ends with them
        named = named | text.contains("." + ending)
    found = F.when(named, F.regexp_extract_all(text, F.lit(for_spark(C.FILE_PATTERN)), 0)).otherwise(F.array().cast("array<string>"))
    paths = F.concat(F.when(F.coalesce("file_path", F.lit("")) != "", F.array("file_path")).otherwise(F.array().cast("array<string>")), found)
    each = events.select("session_id", "event_id", F.posexplode(paths).alias("pos", "path"))
    first = each.groupBy("session_id", "path").agg(F.min(F.struct("event_id", "pos")).alias("at"))
    return first.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy("at"))).where(F.col("place") <= limit).select("session_id", "place", "path", F.col("at.event_id").alias("event_id"))


def problem_events(events: DataFrame, limit: int = 8) -> DataFrame:
    return _first(events.where(has_problem(F.col("text_content"))), limit).select("session_id", "place", "event_id", shortened(F.col("text_content"), 180).alias("text"))


def evidence_ids(events: DataFrame, limit: int = 20) -> DataFrame:
    """session_id, place, event_id of the first events with text."""
    return _first(events.where(_has_text()), limit).select("session_id", "place", "event_id")


def next_steps(events: DataFrame) -> DataFrame:
    """A hint for each session, by whether it has tool output."""
    tools = F.bool_or(F.coalesce(F.col("sub_type") == "function_call_output", F.lit(False)))
    return events.groupBy("session_id").agg(F.when(tools, "Review command outputs and preserve useful fixes in project documentation.").otherwise("Add more sessions, then re-run search and export to build the archive.").alias("next_step"))


def coverage(items: DataFrame) -> DataFrame:
    """session_id, total, with_evidence, ratio (1 where there is nothing) of items (session_id, event_id)."""
    return items.groupBy("session_id").agg(F.count("*").alias("total"), F.count("event_id").alias("with_evidence")).withColumn("ratio", F.round(F.when(F.col("total") > 0, F.col("with_evidence") / F.col("total")).otherwise(1.0), 6))


def coverage_by_group(sessions: DataFrame, items: DataFrame) -> DataFrame:
    """coverage of every session, with by_group and missing, of items (session_id, group, event_id).

    by_group: group, total and with_evidence of each group, by name. missing: a sentence for each group that lacks some.
    """
    groups = items.groupBy("session_id", "group").agg(F.count("*").alias("total"), F.count("event_id").alias("with_evidence"))
    lacks = F.col("total") - F.col("with_evidence")
    sentence = F.when(lacks > 0, F.concat("group", F.lit(" has "), lacks.cast("string"), F.lit(" item(s) without evidence.")))
    listed = groups.groupBy("session_id").agg(F.sum("total").alias("total"), F.sum("with_evidence").alias("with_evidence"), F.array_sort(F.collect_list(F.struct("group", "total", "with_evidence"))).alias("by_group"), F.array_sort(F.collect_list(sentence)).alias("missing"))
    whole = sessions.select("session_id").join(listed, "session_id", "left").fillna(0, ["total", "with_evidence"])
    ratio = F.round(F.when(F.col("total") > 0, F.col("with_evidence") / F.col("total")).otherwise(1.0), 6)
    empty = F.from_json(F.lit("[]"), "array<struct<group:string,total:bigint,with_evidence:bigint>>")
    return whole.select("session_id", "total", "with_evidence", ratio.alias("ratio"), F.coalesce("by_group", empty).alias("by_group"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def summary_items(events: DataFrame) -> DataFrame:
    """session_id, group, event_id of all that a summary lists."""
    parts = [("key_steps", key_steps(events)), ("files", files_mentioned(events)), ("problems", problem_events(events))]
    if "payload" in events.columns:
        parts.append(("key_commands", key_commands(events)))
    return reduce(DataFrame.unionByName, [df.select("session_id", F.lit(name).alias("group"), "event_id") for name, df in parts])


def _lines(df: DataFrame, column: str, name: str) -> DataFrame:
    line = F.concat(F.lit("- "), F.col(column), F.lit(" (evidence: "), F.col("event_id").cast("string"), F.lit(")"))
    order = [c for c in ("list", "place") if c in df.columns]
    return df.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), "\n").alias(name))


def session_summaries(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """session_id, project, topic, text: the text of a session's summary, section by section."""
    out = session_topics(sessions, events).join(sessions.select("session_id", F.col("cwd").alias("project")), "session_id").join(next_steps(events), "session_id", "left")
    parts = [("Key steps", key_steps(events), "text"), ("Files", files_mentioned(events), "path"), ("Problems", problem_events(events), "text")]
    if "payload" in events.columns:
        parts.insert(1, ("Key commands", key_commands(events), "command"))
    lines = [F.concat(F.lit("Session: "), F.col("session_id")), F.concat(F.lit("Project: "), F.coalesce("project", F.lit(""))), F.concat(F.lit("Topic: "), F.col("topic")), F.concat(F.lit("User goal: "), F.col("user_goal"))]
    for k, (title, frame, column) in enumerate(parts):
        out = out.join(_lines(frame, column, f"part{k}"), "session_id", "left")
        lines += [F.lit(f"{title}:"), F.coalesce(f"part{k}", F.lit("- None"))]
    lines += [F.lit("Next steps:"), F.concat(F.lit("- "), F.col("next_step"))]
    return out.select("session_id", "project", "topic", F.concat_ws("\n", *lines).alias("text"))


def is_chunk_text() -> Column:
    """Whether an event's text may stand in a chunk."""
    refused = ["session_meta", "turn_context"]
    return _has_text() & ~F.col("top_type").isin(refused) & ~F.coalesce(F.col("sub_type").isin(refused), F.lit(False))


def turn_chunks(events: DataFrame) -> DataFrame:
    """A chunk for each turn: its number, then a line for each event."""
    label = F.concat_ws("/", F.coalesce("sub_type", "top_type"), F.when(F.col("role") != "", F.col("role")), F.when(F.col("tool_name") != "", F.col("tool_name")))
    line = F.concat(F.lit("- Event "), F.col("event_id").cast("string"), F.lit(" ["), label, F.lit("]: "), shortened(F.col("text_content"), 240))
    some = events.where(is_chunk_text() & F.col("turn_index").isNotNull()).groupBy("session_id", "turn_index").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("lines"))
    return some.select(
        F.concat("session_id", F.lit(":turn-"), F.col("turn_index").cast("string")).alias("chunk_id"), F.lit("turn_summary").alias("chunk_type"), "session_id", "turn_index",
        F.concat(F.lit("Turn: "), F.col("turn_index").cast("string"), F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("text"),
        F.transform("lines", lambda x: x["event_id"]).alias("evidence_event_ids"),
    )


def session_chunks(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """A chunk for each session with evidence that may stand in a chunk."""
    ids = evidence_ids(events).join(events.where(is_chunk_text()).select("event_id"), "event_id", "left_semi").groupBy("session_id").agg(F.array_sort(F.collect_list("event_id")).alias("evidence_event_ids"))
    return session_summaries(sessions, events).join(ids, "session_id").select(F.concat("session_id", F.lit(":session-summary")).alias("chunk_id"), F.lit("session_summary").alias("chunk_type"), "session_id", F.lit(None).cast("long").alias("turn_index"), "text", "evidence_event_ids")


def evidence_chunks(events: DataFrame, cited: DataFrame) -> DataFrame:
    """A chunk for each event of high value that no chunk cites yet (cited: event_id); tool outputs with a problem always."""
    summary_ids = evidence_ids(events).select("event_id", F.lit(True).alias("in_summary"))
    output = F.coalesce(F.col("sub_type") == "function_call_output", F.lit(False))
    marked = events.where(is_chunk_text()).join(summary_ids, "event_id", "left").join(cited.select("event_id").distinct().withColumn("cited", F.lit(True)), "event_id", "left")
    high = F.col("in_summary").isNotNull() | F.coalesce(F.col("sub_type").isin("user_message", "function_call", "message"), F.lit(False)) | (output & has_problem(F.col("text_content")))
    label = F.concat_ws("/", F.coalesce("sub_type", "top_type"), F.when(F.col("tool_name") != "", F.col("tool_name")))
    stamp = F.coalesce("timestamp", F.lit("")) if "timestamp" in events.columns else F.lit("")
    text = F.concat(F.lit("Event: "), F.col("event_id").cast("string"), F.lit("\nType: "), label, F.lit("\nTimestamp: "), stamp, F.lit("\n\n"), F.col("text_content"))
    return marked.where(high & (output | F.col("cited").isNull())).select(F.concat("session_id", F.lit(":evidence-"), F.col("event_id").cast("string")).alias("chunk_id"), F.lit("evidence").alias("chunk_type"), "session_id", F.col("turn_index").cast("long").alias("turn_index"), text.alias("text"), F.array("event_id").alias("evidence_event_ids"))


def cap_chunks(chunks: DataFrame, n: int = 12) -> DataFrame:
    """The first n chunks of each session: the summary, turns in order, evidence in order."""
    kind = F.when(F.col("chunk_type") == "session_summary", 0).when(F.col("chunk_type") == "turn_summary", 1).otherwise(2)
    place = F.row_number().over(W.partitionBy("session_id").orderBy(kind, F.when(kind == 1, F.col("turn_index")), F.col("evidence_event_ids")[0]))
    return chunks.withColumn("place", place).where(F.col("place") <= n).drop("place")


def trim_chunks(chunks: DataFrame, max_chars: int = 1200) -> DataFrame:
    if max_chars < 100:
        raise ValueError("max_chars must be 100 at least")
    return chunks.withColumn("truncated", F.length("text") > max_chars).withColumn("text", trimmed(F.col("text"), max_chars)).withColumn("text_chars", F.length("text"))


def build_chunks(sessions: DataFrame, events: DataFrame, per_session: int = 12, max_chars: int = 1200) -> DataFrame:
    """All chunks: summaries and turns are capped first, since what they cite decides which evidence is left."""
    if per_session < 1:
        raise ValueError("per_session must be 1 at least")
    turns = turn_chunks(events).withColumn("turn_index", F.col("turn_index").cast("long"))
    # read twice below
    first = written(cap_chunks(session_chunks(sessions, events).unionByName(turns), per_session), "chunks")
    cited = first.select(F.explode("evidence_event_ids").alias("event_id"))
    return trim_chunks(cap_chunks(first.unionByName(evidence_chunks(events, cited)), per_session), max_chars)
