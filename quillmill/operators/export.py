"""Documents and files made of an archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillmill.operators import privacy, summary

#: Characters of an evidence page, and sessions on a page of an index (about).
EVIDENCE_CHARS, PAGE_LINES = 4000, 500
CSV_COLUMNS = ["session_id", "event_id", "turn_index", "timestamp", "top_type", "sub_type", "role", "tool_name", "file_path", "text_content"]


def _columns(df: DataFrame) -> list[Column]:
    return [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in CSV_COLUMNS]


def export_json(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """session_id, value: one JSON object for each session with its events in order."""
    listed = events.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("event_id", *[c for c in events.columns if c not in ("event_id", "session_id")]))).alias("events"))
    return sessions.join(listed, "session_id", "left").select("session_id", F.to_json(F.struct(F.struct(*sessions.columns).alias("session"), "events")).alias("value"))


def export_jsonl(events: DataFrame, path: str) -> None:
    events.select("session_id", *[c for c in events.columns if c != "session_id"]).write.mode("overwrite").json(path)


def export_csv(events: DataFrame, path: str) -> None:
    events.select(*_columns(events)).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\n").csv(path)


def _joined(df: DataFrame, key: str, line: Column, name: str, sep: str = "\n") -> DataFrame:
    return df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), sep).alias(name))


def render_markdown(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """session_id, name, text: a timeline for each session."""
    head = F.concat_ws(" / ", F.coalesce("sub_type", "top_type"), "role", "tool_name")
    line = F.concat(F.lit("## Event "), F.col("event_id").cast("string"), F.lit(" - "), head, F.lit("\n\n"), F.coalesce("text_content", F.lit("")), F.lit("\n"))
    title = F.concat(F.lit("# Session "), F.col("session_id"), F.lit("\n\n- Project: "), F.coalesce("cwd", F.lit("")), F.lit("\n- First seen: "), F.coalesce("first_seen_at", F.lit("")), F.lit("\n- Updated: "), F.coalesce("updated_at", F.lit("")), F.lit("\n\n"))
    return sessions.join(_joined(events, "session_id", line, "body"), "session_id", "left").select("session_id", F.concat(slug(F.col("session_id")), F.lit(".md")).alias("name"), F.concat(title, F.coalesce("body", F.lit(""))).alias("text"))


def slug(text: Column, limit: int = 96) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_-]+", "-"), "^-+|-+$", ""), 1, limit)


def render_vault(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """name, session_id, text: a page and an evidence page for each session, linked to each other, and an index."""
    texts = summary.session_summaries(sessions, events).withColumn("slug", slug(F.col("session_id"), 63))
    line = F.concat(F.lit("- Event "), F.col("event_id").cast("string"), F.lit(": "), F.substring(F.coalesce("text_content", F.lit("")), 1, 700))
    # only the lines that reach into what an evidence page shows are collected
    lines = events.where(summary.is_chunk_text()).select("session_id", "event_id", line.alias("line"))
    before = F.sum(F.length("line") + 1).over(W.partitionBy("session_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1))
    proof = _joined(lines.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < EVIDENCE_CHARS), "session_id", F.col("line"), "proof")
    pages = texts.join(proof, "session_id", "left")
    page = pages.select(F.concat(F.lit("sessions/"), "slug", F.lit(".md")).alias("name"), "session_id", F.concat(F.lit("# "), "topic", F.lit("\n\nEvidence: [["), "slug", F.lit("-evidence]]\n\n"), "text").alias("text"))
    evidence = pages.select(F.concat(F.lit("evidence/"), "slug", F.lit("-evidence.md")).alias("name"), "session_id", F.concat(F.lit("# Evidence\n\nSession: [["), "slug", F.lit("]]\n\n"), F.substring(F.coalesce("proof", F.lit("")), 1, EVIDENCE_CHARS)).alias("text"))
    return page.unionByName(evidence).unionByName(_index(texts))


def _paged(rows: DataFrame, folder: str, title: str) -> DataFrame:
    """name, project, text of pages of lines (project, session_id, line): one page for each project of up to PAGE_LINES
    sessions, more for larger ones, of about as many sessions each, which a hash of their ids deals out."""
    sizes = rows.groupBy("project").agg(F.ceil(F.count("*") / PAGE_LINES).cast("int").alias("pages")).withColumnRenamed("project", "p")
    dealt = rows.join(sizes, F.col("project").eqNullSafe(F.col("p"))).withColumn("page", F.pmod(F.xxhash64("session_id"), F.col("pages")).cast("int"))
    listed = dealt.groupBy("project", "pages", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("session_id", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    name = F.coalesce("project", F.lit("none"))
    number = F.when(F.col("pages") > 1, F.concat(F.lit("-"), (F.col("page") + 1).cast("string"))).otherwise("")
    return listed.select(F.concat(F.lit(f"{folder}/"), slug(name), number, F.lit(".md")).alias("name"), "project", F.concat(F.lit(title), name, F.lit("\n\n"), "lines").alias("text"))


def _index(texts: DataFrame) -> DataFrame:
    """An index for each project: its sessions and their topics."""
    line = F.concat(F.lit("- [["), F.col("slug"), F.lit("]] "), F.col("topic"))
    return _paged(texts.select("project", "session_id", line.alias("line")), "index", "# ").select("name", F.lit(None).cast("string").alias("session_id"), "text")


def render_packet(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """name, session_id, text: one page for each session, and project pages with sessions and evidence."""
    texts = summary.session_summaries(sessions, events).withColumn("slug", slug(F.col("session_id"), 63))
    page = texts.select(F.concat(F.lit("references/"), "slug", F.lit(".md")).alias("name"), "session_id", F.col("text"))
    return page.unionByName(_index(texts)).unionByName(render_project(sessions, events).select("name", F.lit(None).cast("string").alias("session_id"), "text"))


def render_project(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """name, project, text: each project's sessions, topics and first evidence."""
    ids = summary.evidence_ids(events, 5).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("event_id").cast("string").alias("id")))), lambda x: x["id"]), ", ").alias("ids"))
    some = summary.session_topics(sessions, events).join(sessions.select("session_id", F.col("cwd").alias("project")), "session_id").join(ids, "session_id", "left")
    line = F.concat(F.lit("- "), F.col("session_id"), F.lit(": "), F.col("topic"), F.lit(" (evidence: "), F.coalesce("ids", F.lit("none")), F.lit(")"))
    return _paged(some.select("project", "session_id", line.alias("line")), "projects", "# Project ")


def export_plan(docs: DataFrame, mode: str) -> DataFrame:
    """name, session_id, findings, high_risk, written: what an export would write. docs: name, session_id, text."""
    found = privacy.scan(docs, "name", "text")
    counts = found.groupBy("name").agg(F.count("*").alias("findings"), F.bool_or(F.col("severity").isin(privacy.HIGH)).alias("high_risk"))
    return docs.join(counts, "name", "left").fillna(0, ["findings"]).fillna(False, ["high_risk"]).select("name", "session_id", "findings", "high_risk", (F.lit(mode != "fail") | ~F.col("high_risk")).alias("written"))


def write_documents(docs: DataFrame, path: str) -> None:
    """One JSON line for each document, name and text, by folder."""
    docs.withColumn("folder", F.regexp_extract("name", "^([^/]*)/", 1)).write.mode("overwrite").partitionBy("folder").json(path)


def manifest(docs: DataFrame) -> DataFrame:
    """One row on documents (session_id, text, evidence_event_ids): counts and distinct evidence."""
    evidence = docs.select(F.explode("evidence_event_ids").alias("id"))
    totals = docs.agg(F.count("*").alias("documents"), F.count_distinct("session_id").alias("sessions"), F.sum(F.length("text")).alias("chars"))
    return totals.join(F.broadcast(evidence.agg(F.count_distinct("id").alias("evidence_events"))))


def events_by_id(events: DataFrame, ids: list[int]) -> DataFrame:
    """Events of an explicit list, with their place in it."""
    wanted = events.sparkSession.createDataFrame([(k, i) for k, i in enumerate(ids)], "place int, event_id long")
    return F.broadcast(wanted).join(events, "event_id")
