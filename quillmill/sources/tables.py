"""Archive frames from plain tables: conversations, documents and event logs play the part of transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chat_events(conversations: DataFrame) -> DataFrame:
    """One event for each turn of a conversation; turns are assigned by the operator of that name."""
    role = F.col("role")
    return conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"),
        F.concat(F.lit("conv-"), F.col("conv_id")).alias("session_id"),
        F.when(role == "user", "event_msg").when(role == "assistant", "response_item").otherwise("turn_context").alias("top_type"),
        F.when(role == "user", "user_message").when(role == "assistant", "message").alias("sub_type"),
        role.alias("role"),
        F.lit(None).cast("string").alias("tool_name"),
        F.lit(None).cast("string").alias("file_path"),
        F.col("text").alias("text_content"),
        (F.col("turn") + 1).alias("line_no"),
    )


def chat_sessions(conversations: DataFrame) -> DataFrame:
    """One session for each conversation; its first and last lines stand for the times when it was seen."""
    line = lambda f: F.lpad(f("turn").cast("string"), 6, "0")
    return conversations.groupBy("conv_id").agg(line(F.min).alias("first_seen_at"), line(F.max).alias("updated_at")).select(F.concat(F.lit("conv-"), F.col("conv_id")).alias("session_id"), F.concat(F.lit("proj-"), F.col("conv_id") % 7).alias("cwd"), "first_seen_at", "updated_at")


def document_events(documents: DataFrame) -> DataFrame:
    """One event for each document; its id decides the type, its language the session."""
    k = F.col("doc_id") % 4
    return documents.select(
        F.col("doc_id").alias("event_id"),
        F.col("lang").alias("session_id"),
        F.when(k < 2, "response_item").otherwise("event_msg").alias("top_type"),
        F.when(k == 0, "function_call_output").when(k == 1, "message").when(k == 2, "agent_message").otherwise("user_message").alias("sub_type"),
        F.when(k == 1, "assistant").alias("role"),
        F.lit(None).cast("string").alias("tool_name"),
        F.lit(None).cast("string").alias("file_path"),
        F.col("text").alias("text_content"),
    )


def page_events(pages: DataFrame, prefix: str = "Failed to read out/p", suffix: str = ".json; see notes") -> DataFrame:
    """One tool output for each page, as of a crawl that could not store it: its text names files, its site is the session."""
    page = F.col("page_id").cast("string")
    return pages.select(
        F.col("page_id").alias("event_id"),
        F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("session_id"),
        F.lit("response_item").alias("top_type"),
        F.lit("function_call_output").alias("sub_type"),
        F.lit(None).cast("string").alias("role"),
        F.lit("fetch").alias("tool_name"),
        F.col("url").alias("file_path"),
        F.concat(F.lit(prefix), page, F.lit(suffix), F.lit("-"), page, F.lit(".md")).alias("text_content"),
    )


def call_events(events: DataFrame) -> DataFrame:
    """Clicks as calls and purchases as outputs, in the order of each user's events."""
    line = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return (
        events.withColumn("line_no", line)
        .where(F.col("event_type").isin("click", "purchase"))
        .select(F.col("user_id").cast("string").alias("path"), "line_no", F.when(F.col("event_type") == "click", "call").otherwise("output").alias("kind"), F.concat_ws(":", F.col("user_id"), F.get_json_object("props", "$.k")).alias("call_id"))
    )
