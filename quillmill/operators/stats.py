"""Counts, health and audits of archives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _beside(frames: list[DataFrame]) -> DataFrame:
    """One-row frames as one row."""
    return reduce(lambda a, b: a.join(F.broadcast(b)), frames)


def archive_stats(sessions: DataFrame, events: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row: each table is read once and only its own aggregates meet."""
    s = sessions.agg(F.count("*").alias("sessions"), F.count_distinct("cwd").alias("projects"), F.min("first_seen_at").alias("first_seen_at"), F.max("updated_at").alias("updated_at"))
    e = events.agg(F.count("*").alias("events"), F.count_distinct("session_id", "turn_index").alias("turns"), F.count_if(F.col("sub_type") == "function_call").alias("tool_calls"), F.count_distinct("file_path").alias("files"))
    return _beside([s, e, warnings.agg(F.count("*").alias("warnings"))])


def index_stats(events: DataFrame) -> DataFrame:
    """One row on classified events: how many are searchable, skipped, cut, and the characters before and after."""
    p = F.col("index_policy")
    raw, indexed = F.coalesce(F.sum(F.length("text_content")), F.lit(0)), F.coalesce(F.sum(F.length("indexed_text")), F.lit(0))
    return events.agg(F.count("*").alias("events"), F.count_if(F.col("indexed_text").isNotNull()).alias("searchable"), F.count_if(p.startswith("skip_")).alias("skipped"), F.count_if(p == "truncated").alias("truncated"), F.count_if(p == "metadata_only").alias("metadata_only"), raw.alias("raw_chars"), indexed.alias("indexed_chars")).withColumn("ratio", F.round(F.when(F.col("raw_chars") > 0, F.col("indexed_chars") / F.col("raw_chars")).otherwise(0.0), 6))


def index_groups(events: DataFrame) -> DataFrame:
    """Counts by policy and by value level, in one pass: the other column is null."""
    return events.groupingSets([["index_policy"], ["value_level"]], "index_policy", "value_level").agg(F.count("*").alias("count"))


def storage_audit(events: DataFrame, payload: str, top: int = 40) -> DataFrame:
    """The types with the largest payloads."""
    return events.groupBy("top_type", F.coalesce("sub_type", F.lit("<null>")).alias("sub_type")).agg(F.count("*").alias("events"), F.sum(F.length(payload)).alias("payload_chars")).orderBy(F.desc("payload_chars"), "top_type", "sub_type").limit(top)


def storage_classes(events: DataFrame, payload: str) -> DataFrame:
    return events.groupBy("storage_class").agg(F.count("*").alias("events"), F.sum(F.length(payload)).alias("payload_chars"))


def parse_health(events: DataFrame, warnings: DataFrame, high: float = 0.05, top: int = 10) -> DataFrame:
    """The most frequent codes, each with the archive's ratio of warnings to events."""
    ratio = _beside([events.agg(F.count("*").alias("events")), warnings.agg(F.count("*").alias("warnings"))]).withColumn("ratio", F.round(F.when(F.col("events") > 0, F.col("warnings") / F.col("events")).otherwise(0.0), 6))
    codes = warnings.groupBy("code").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "code").limit(top)
    return codes.join(F.broadcast(ratio)).withColumn("high_ratio", F.col("ratio") > high)


def index_status(events: DataFrame, index: DataFrame) -> DataFrame:
    """One row: searchable events, indexed ones, and those that are not indexed. index: postings, of any layout."""
    there = index.select("event_id").distinct()
    wanted = events.where("indexed_text is not null").select("event_id")
    return _beside([wanted.agg(F.count("*").alias("searchable")), there.agg(F.count("*").alias("indexed")), wanted.join(there, "event_id", "left_anti").agg(F.count("*").alias("not_indexed"))])


def diagnostics(spark, engine: str, strategy: str, filters: dict, results: DataFrame) -> DataFrame:
    """One row on how a search was answered."""
    return results.agg(F.count("*").alias("result_count")).select(F.lit(engine).alias("engine"), F.lit(strategy).alias("rank_strategy"), F.lit(",".join(sorted(k for k, v in filters.items() if v is not None))).alias("filters"), "result_count")


def corpus_audit(samples: DataFrame) -> DataFrame:
    """One row on files (path, events, warnings, classifications, warning_codes): totals and merged counters."""
    totals = samples.agg(F.count("*").alias("files"), F.count_if(F.col("events") > 0).alias("parseable_files"), F.sum("events").alias("events"), F.sum("warnings").alias("warnings")).withColumn("parseable_ratio", F.round(F.when(F.col("files") > 0, F.col("parseable_files") / F.col("files")).otherwise(0.0), 6))
    merged = lambda name: samples.select(F.explode(name)).groupBy("key").agg(F.sum("value").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias(name))
    return _beside([totals, merged("classifications"), merged("warning_codes")])


def audit_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, before, after, delta, is_new of counters (key, count); what one side lacks counts 0."""
    b, a = before.select("key", F.col("count").alias("before")), after.select("key", F.col("count").alias("after"))
    return b.join(a, "key", "full_outer").withColumn("is_new", F.col("before").isNull()).fillna(0, ["before", "after"]).withColumn("delta", F.col("after") - F.col("before"))


def audit_regressions(before: DataFrame, after: DataFrame, codes_before: DataFrame, codes_after: DataFrame) -> DataFrame:
    """One row on two audits (files, events, warnings, parseable_ratio) and their warning codes (key, count): the deltas
    of the totals, and what got worse."""
    fields = ["files", "events", "warnings", "parseable_ratio"]
    both = _beside([before.select(*[F.col(f).alias(f"b_{f}") for f in fields]), after.select(*fields)])
    new = audit_diff(codes_before, codes_after).where("is_new and delta > 0").agg(F.array_sort(F.collect_set("key")).alias("new_warning_codes"))
    deltas = [(F.col(f) - F.col(f"b_{f}")).alias(f"{f}_delta") for f in fields]
    return _beside([both, new]).select(*deltas, (F.col("warnings") > F.col("b_warnings")).alias("warnings_increased"), (F.col("parseable_ratio") < F.col("b_parseable_ratio")).alias("parseable_ratio_decreased"), "new_warning_codes")


def audit_history(reports: DataFrame, fields: tuple[str, ...] = ("files", "events", "warnings")) -> DataFrame:
    """The last report and its differences to the one before; status not_enough_reports where there is none."""
    two = reports.orderBy(F.desc("generated_at")).limit(2)
    ranked = two.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("generated_at"))))
    last, before = ranked.where("rank = 1"), ranked.where("rank = 2").select(*[F.col(f).alias(f"before_{f}") for f in fields], F.lit(True).alias("two"))
    return last.join(before, how="left").select("generated_at", *[F.col(f) for f in fields], *[(F.col(f) - F.col(f"before_{f}")).alias(f"delta_{f}") for f in fields], F.when(F.col("two"), "ok").otherwise("not_enough_reports").alias("status"))


def counts_equal(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """table, a, b, equal: row counts of two archives."""
    def one(name: str) -> DataFrame:
        return _beside([a[name].agg(F.count("*").alias("a")), b[name].agg(F.count("*").alias("b"))]).select(F.lit(name).alias("table"), "a", "b", (F.col("a") == F.col("b")).alias("equal"))

    return reduce(DataFrame.unionByName, [one(name) for name in sorted(a)])


def conversation_digest(events: DataFrame) -> DataFrame:
    """session_id, messages, digest of each session's canonical messages in order."""
    canonical = F.coalesce(F.col("sub_type") == "user_message", F.lit(False)) | (F.coalesce(F.col("sub_type") == "message", F.lit(False)) & F.col("role").isin("assistant", "developer")) | (F.col("top_type") == "compacted")
    line = F.sha2(F.concat_ws("|", F.coalesce("sub_type", "top_type"), F.coalesce("text_content", F.lit(""))), 256)
    some = events.where(canonical).groupBy("session_id").agg(F.count("*").alias("messages"), F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("lines"))
    return some.select("session_id", "messages", F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), 256).alias("digest"))


def digest_of(sessions: DataFrame) -> DataFrame:
    """One row (sessions, digest) on session_id, digest: a sum of hashes, so that neither an order nor one task is needed."""
    parts = [F.sum(F.conv(F.substring("digest", k, 15), 16, 10).cast("decimal(38,0)")).alias(f"d{k}") for k in (1, 16, 31, 46)]
    return sessions.withColumn("digest", F.sha2(F.concat_ws("|", "session_id", "digest"), 256)).agg(F.count("*").alias("sessions"), *parts).select("sessions", F.sha2(F.concat_ws("|", "sessions", "d1", "d16", "d31", "d46"), 256).alias("digest"))


def archive_digest(events: DataFrame) -> DataFrame:
    """One row: a digest that the order of sessions does not change."""
    return digest_of(conversation_digest(events))


def session_statistics(events: DataFrame) -> DataFrame:
    """A row for each session, kept beside its events in an archive: session_id, events, turns, tool_calls, searchable,
    raw_chars, indexed_chars, files (an HLL sketch of 2^12 registers), and messages and digest of its conversation."""
    counted = events.groupBy("session_id").agg(
        F.count("*").alias("events"),
        F.count_distinct("turn_index").alias("turns"),
        F.count_if(F.col("sub_type") == "function_call").alias("tool_calls"),
        F.count_if(F.col("indexed_text").isNotNull()).alias("searchable"),
        F.coalesce(F.sum(F.length("text_content")), F.lit(0)).alias("raw_chars"),
        F.coalesce(F.sum(F.length("indexed_text")), F.lit(0)).alias("indexed_chars"),
        F.hll_sketch_agg("file_path", F.lit(12)).alias("files"),
    )
    return counted.join(conversation_digest(events), "session_id", "left")


def stored_statistics(rows: DataFrame) -> DataFrame:
    """One row on an archive from its sessions' statistics, without its events: sums, files (an estimate, some 2 % off),
    and the digest, which is exactly that of the events. Sessions that come anew bring their own rows, so that an import
    costs what it brings."""
    names = ("events", "turns", "tool_calls", "searchable", "raw_chars", "indexed_chars")
    totals = rows.agg(F.count("*").alias("sessions"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names], F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("files")), F.lit(0)).alias("files"))
    return _beside([totals, digest_of(rows.where("digest is not null").select("session_id", "digest")).select("digest")])
