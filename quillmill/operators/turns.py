"""Turns: sessions cut at user messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def assign_turns(events: DataFrame) -> DataFrame:
    """events with turn_index: a user message opens a turn if the one before it had a text; the first event opens 0."""
    is_user = F.col("sub_type").eqNullSafe(F.lit("user_message"))
    order = W.partitionBy("session_id").orderBy("event_id")
    before = F.last(F.when(is_user, F.coalesce("text_content", F.lit(""))), True).over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(is_user & (F.coalesce(before, F.lit("")) != ""), 1).otherwise(0)
    return events.withColumn("opens", opens).withColumn("turn_index", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("opens")


SETTINGS = ("model", "effort", "approval_policy")


def with_settings(events: DataFrame, payload: str = "payload") -> DataFrame:
    """events with the settings that a turn_context's payload names."""
    context = F.col("top_type") == "turn_context"
    return events.withColumns({name: F.when(context, F.get_json_object(payload, f"$.{name}")) for name in SETTINGS})


def roll_up_turns(events: DataFrame, settings: tuple[str, ...] = ()) -> DataFrame:
    """One row for each turn: events, and of turn_context events the last non-empty value of each setting."""
    context = F.col("top_type") == "turn_context"
    last = [F.max_by(name, F.when(context & (F.coalesce(F.col(name), F.lit("")) != ""), F.col("event_id"))).alias(name) for name in settings]
    more = [F.min_by("timestamp", "event_id").alias("timestamp")] if "timestamp" in events.columns else []
    return events.groupBy("session_id", "turn_index").agg(F.count("*").alias("event_count"), F.min("event_id").alias("first_event_id"), F.max("event_id").alias("last_event_id"), *more, *last)
