"""Content policy: what is indexed, where payloads are stored, which bodies repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import constants as C
from quillmill.functions.text import head_tail, is_any, is_blank


def binary_placeholder() -> Column:
    """What stands for an inline image in the index: its type, tool and file."""
    part = lambda name, key: F.when(F.coalesce(F.col(name), F.lit("")) != "", F.concat(F.lit(f"{key}="), F.col(name)))
    kind = F.when(F.col("top_type").isNotNull() | F.col("sub_type").isNotNull(), F.concat(F.lit("type="), F.coalesce("top_type", F.lit("")), F.lit("/"), F.coalesce("sub_type", F.lit(""))))
    return F.concat_ws(" ", F.lit("[binary or image evidence omitted from search index]"), kind, part("tool_name", "tool"), part("file_path", "file"))


def classify_index(events: DataFrame) -> DataFrame:
    """events with indexed_text, index_policy and value_level."""
    top, sub, text = F.col("top_type"), F.col("sub_type"), F.coalesce("text_content", F.lit(""))
    low, binary, tool = is_any(top, sub, C.LOW_VALUE_TYPES), text.contains("data:image/") | text.contains(";base64,"), F.coalesce(sub.isin(C.TOOL_OUTPUTS), F.lit(False))
    long_tool, long = F.length(text) > C.TOOL_HEAD_CHARS + C.TOOL_TAIL_CHARS, F.length(text) > C.FULL_CHARS
    policy = F.when(is_blank(text), "skip_empty").when(low, "skip_low_value").when(binary, "metadata_only").when((tool & long_tool) | (~tool & long), "truncated").otherwise("full")
    done = events.withColumn("index_policy", policy)
    skipped = F.col("index_policy").isin("skip_empty", "skip_low_value")
    return done.withColumn("value_level", F.when(skipped, "noise").when(binary | tool, "evidence").otherwise("core")).withColumn(
        "indexed_text",
        F.when(skipped, F.lit(None)).when(F.col("index_policy") == "metadata_only", binary_placeholder()).when(tool & long_tool, head_tail(text, C.TOOL_HEAD_CHARS, C.TOOL_TAIL_CHARS)).when(~tool & long, head_tail(text, C.HEAD_CHARS, C.TAIL_CHARS)).otherwise(text),
    )


def classify_storage(events: DataFrame, payload: str = "payload") -> DataFrame:
    """events with storage_class; payload is the column whose size counts."""
    top, sub = F.col("top_type"), F.col("sub_type")
    kind = (
        F.when(is_any(top, sub, C.NOISE_TYPES), "noise")
        .when(top == "compacted", "core")
        .when((top == "response_item") & sub.eqNullSafe(F.lit("message")), "core")
        .when(is_any(top, sub, C.EVIDENCE_TYPES), "evidence")
        .when((top == "response_item") & F.coalesce(sub.isin("function_call", "custom_tool_call"), F.lit(False)), "core")
        .when(top.isin(C.METADATA_TYPES), "evidence")
        .when(~top.isin(C.KNOWN_TYPES) | top.isNull(), "quarantine")
        .when(F.octet_length(F.coalesce(payload, F.lit(""))) > C.LARGE_PAYLOAD_BYTES, "evidence")
        .otherwise("core")
    )
    return events.withColumn("storage_class", kind)


def stored_text(text: Column) -> Column:
    """A tool output as the hot store keeps it."""
    return F.when(F.length(text) > C.TOOL_HEAD_CHARS + C.TOOL_TAIL_CHARS, head_tail(text, C.TOOL_HEAD_CHARS, C.TOOL_TAIL_CHARS, "stored in cold evidence")).otherwise(text)


def drop_stub(payload: Column, reason: str) -> Column:
    """JSON that stands for a payload that is not kept."""
    return F.to_json(F.struct(F.octet_length(payload).alias("original_bytes"), F.sha2(payload, 256).alias("original_sha256"), F.lit(reason).alias("reason"), F.lit("dropped").alias("storage")))


def dedupe_bodies(events: DataFrame) -> DataFrame:
    """events with duplicate: an agent message whose text a message of the assistant in the same session has too.

    Bodies meet as hashes; the side that is looked up holds each hash of a session once. A row that is no candidate has
    a hash of its own columns in place of a body, which equals none: such rows are most of a session, and a null would
    bring all of them to one task.
    """
    body = F.sha2("text_content", 256)
    canonical = events.where((F.col("top_type") == "response_item") & (F.col("sub_type") == "message") & F.col("role").isin("assistant", "developer") & F.col("text_content").isNotNull()).select("session_id", body.alias("body")).distinct().withColumn("known", F.lit(True))
    candidate = (F.col("top_type") == "event_msg") & F.col("sub_type").eqNullSafe(F.lit("agent_message")) & F.col("text_content").isNotNull()
    plain = [c for c, kind in events.dtypes if kind in ("string", "bigint", "int")]
    keyed = events.withColumn("body", F.when(candidate, body).otherwise(F.concat(F.lit("-"), F.xxhash64(*plain).cast("string"))))
    return keyed.join(canonical, ["session_id", "body"], "left").withColumn("duplicate", F.coalesce("known", F.lit(False))).drop("known", "body")


def without_bodies(marked: DataFrame) -> DataFrame:
    """Duplicates lose their text: a stub with its hash stays, as noise that is not indexed."""
    dup = F.col("duplicate")
    return marked.withColumn("payload_stub", F.when(dup, drop_stub(F.col("text_content"), "duplicate_body"))).withColumn("text_content", F.when(~dup, F.col("text_content"))).withColumn("index_policy", F.when(dup, "skip_duplicate").otherwise(F.col("index_policy"))).withColumn("value_level", F.when(dup, "noise").otherwise(F.col("value_level")))
