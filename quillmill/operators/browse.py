"""Sessions, events and warnings: filters, counts, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillmill.functions import constants as C
from quillmill.functions.text import collapsed, trimmed
from quillmill.operators import search


def _newest() -> list[Column]:
    return [F.coalesce("updated_at", "first_seen_at", F.lit("")).desc(), F.desc("session_id")]


def list_sessions(sessions: DataFrame, events: DataFrame, warnings: DataFrame, cwd: str | None = None, limit: int = 50) -> DataFrame:
    """Sessions with their numbers of events and warnings, newest first. Each side is counted before it is joined."""
    count = lambda df, name: df.groupBy("session_id").agg(F.count("*").alias(name))
    some = sessions if cwd is None else sessions.where(F.col("cwd") == cwd)
    return some.join(count(events, "event_count"), "session_id", "left").join(count(warnings, "warning_count"), "session_id", "left").fillna(0, ["event_count", "warning_count"]).orderBy(*_newest()).limit(limit)


def list_warnings(warnings: DataFrame, session_id: str | None = None, code: str | None = None, path: str | None = None, limit: int = 50) -> DataFrame:
    """Warnings, the last lines first."""
    for name, value in (("session_id", session_id), ("code", code), ("raw_path", path)):
        if value is not None:
            warnings = warnings.where(F.col(name) == value)
    return warnings.orderBy(F.desc("line_no"), "session_id", "code").limit(limit)


def warning_summary(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("code").agg(F.count("*").alias("count"))


def get_sessions(sessions: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (session_id, ordinal) with what is known of each, found or not, for any order by ordinal."""
    return wanted.join(sessions.withColumn("found", F.lit(True)), "session_id", "left").fillna(False, ["found"])


def project_sessions(sessions: DataFrame, cwd: str) -> DataFrame:
    return sessions.where(F.col("cwd") == cwd)


def select_sessions(sessions: DataFrame, wanted: DataFrame, cwd: str) -> DataFrame:
    """Wanted sessions and then those of a project, each once, by its first place: session_id, ordinal."""
    by_project = project_sessions(sessions, cwd).select("session_id", (F.lit(1_000_000_000) + F.row_number().over(W.partitionBy("cwd").orderBy(*_newest()))).cast("long").alias("place"))
    both = wanted.join(sessions, "session_id", "left_semi").select("session_id", F.col("ordinal").cast("long").alias("place")).union(by_project)
    return both.groupBy("session_id").agg(F.min("place").alias("place"))


def get_events(events: DataFrame, wanted: DataFrame) -> DataFrame:
    return events.join(wanted.select("session_id").distinct(), "session_id", "left_semi")


def filter_events(events: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, tool_output: bool = True, reasoning: bool = True) -> DataFrame:
    """Events by type: include looks at either type, exclude at the finer one and the upper one."""
    top, sub = F.col("top_type"), F.col("sub_type")
    if include:
        events = events.where(top.isin(include) | F.coalesce(sub.isin(include), F.lit(False)))
    if exclude:
        events = events.where(~F.coalesce(sub, top).isin(exclude) & ~top.isin(exclude))
    if not tool_output:
        events = events.where(F.coalesce(sub, F.lit("")) != "function_call_output")
    if not reasoning:
        events = events.where(F.coalesce(sub, F.lit("")) != "reasoning")
    return events


def last_turns(events: DataFrame, n: int) -> DataFrame:
    """Events of the last n turns of each session; call it before any filter, since the last turn is that of all events.

    A row for each session says where to begin; events meet it without being sorted.
    """
    first = events.groupBy("session_id").agg(F.greatest(F.lit(0), F.max("turn_index") - n + 1).alias("first"))
    return events.join(first, "session_id").where(F.col("turn_index") >= F.col("first")).drop("first")


def trim_text(events: DataFrame, max_chars: int | None, max_tool_chars: int | None) -> DataFrame:
    text = F.col("text_content")
    short = trimmed(text, max_chars) if max_chars else text
    if max_tool_chars:
        short = F.when(F.col("sub_type").eqNullSafe(F.lit("function_call_output")), trimmed(text, max_tool_chars)).otherwise(short)
    return events.withColumn("text_content", short)


def apply_profile(events: DataFrame, profile: str, turns: int | None = None) -> DataFrame:
    """Events as a named export profile wants them."""
    p = C.EXPORT_PROFILES[profile]
    some = last_turns(events, turns) if turns else events
    return trim_text(filter_events(some, None, p.get("exclude"), p.get("tool_output", True), p.get("reasoning", True)), p.get("max_chars"), p.get("max_tool_chars"))


def session_detail(sessions: DataFrame, events: DataFrame, previews: int = 5, chars: int = 120) -> DataFrame:
    """One row for each of the first events of each session, with the session's columns and counts."""
    ranked = events.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy("event_id")))
    counts = events.groupBy("session_id").agg(F.count("*").alias("event_count"))
    some = ranked.where(F.col("place") <= previews).select("session_id", "place", "event_id", F.substring("text_content", 1, chars).alias("preview"), (F.length("text_content") > chars).alias("truncated"))
    return sessions.join(counts, "session_id").join(some, "session_id")


def overview(sessions: DataFrame) -> DataFrame:
    """Sessions by project, with the first and last of them."""
    return sessions.groupBy("cwd").agg(F.count("*").alias("sessions"), F.min("session_id").alias("first_session"), F.max(F.coalesce("updated_at", "first_seen_at")).alias("latest"))


def overview_hits(sessions: DataFrame, events: DataFrame, index, query: str, limit: int = 20, **filters) -> DataFrame:
    """The overview's search leg: the best events for a query (as search takes it), with the project of their session."""
    hits = search.search(events, index, sessions, query, limit, **filters)
    return hits.join(sessions.select("session_id", "cwd"), "session_id", "left").orderBy(F.desc("score"), "event_id")


def warning_detail(warnings: DataFrame, events: DataFrame) -> DataFrame:
    """Warnings by session and code, with the session's number of events."""
    counts = events.groupBy("session_id").agg(F.count("*").alias("event_count"))
    return warnings.groupBy("session_id", "code").agg(F.count("*").alias("warning_count"), F.min("line_no").alias("first_line")).join(counts, "session_id", "left").fillna(0, ["event_count"])


def hide_paths(df: DataFrame, debug: bool = False) -> DataFrame:
    """Without the columns that hold paths; findings of paths lose their excerpts."""
    if debug:
        return df
    out = df.drop("raw_path", "file_path")
    if {"kind", "excerpt"} <= set(df.columns):
        out = out.withColumn("excerpt", F.when(~F.col("kind").endswith("_abs_path"), F.col("excerpt")))
    return out


def project_name(cwd: Column) -> Column:
    """The last part of a path; a fixed name where there is none."""
    flat = F.regexp_replace(F.coalesce(cwd, F.lit("")), r"[\\/]+$", "")
    return F.when(flat == "", F.lit("no project")).otherwise(F.element_at(F.split(flat, r"[\\/]"), -1))


def friendly_title(value: Column) -> Column:
    """A title of at most 58 characters; empty for ids, links and instructions."""
    flat = F.btrim(collapsed(F.coalesce(value, F.lit(""))), F.lit(" #"))
    low = F.lower(flat)
    refused = low.contains("agents.md instructions") | low.rlike(r"^[a-z]+://threads/") | flat.startswith("[$") | low.contains("<instructions>") | low.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return F.when(refused, F.lit("")).when(F.length(flat) > 58, F.concat(F.rtrim(F.substring(flat, 1, 57)), F.lit("…"))).otherwise(flat)


def session_titles(sessions: DataFrame, state: DataFrame) -> DataFrame:
    """Sessions with the title of the state table (session_id, title), or their project's name."""
    title = friendly_title(F.col("title"))
    return sessions.join(state.select("session_id", "title"), "session_id", "left").withColumn("title", F.when(title != "", title).otherwise(project_name(F.col("cwd"))))
