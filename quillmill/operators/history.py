"""Retention, coverage and due dates over histories of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillmill.functions import constants as C


def keep_latest(history: DataFrame, n: int, time: str, tie: str) -> DataFrame:
    """history with keep: whether a row is among the n latest of all. Only those n are ranked.

    Of rows that agree in time and tie, as many are kept as there is room for, whichever.
    """
    if n < 1:
        raise ValueError("keep must be 1 at least")
    latest = F.broadcast(history.orderBy(F.desc(time), F.desc(tie)).limit(n).groupBy(F.col(time).alias("k_time"), F.col(tie).alias("k_tie")).agg(F.count("*").alias("room")))
    same = F.col(time).eqNullSafe(F.col("k_time")) & F.col(tie).eqNullSafe(F.col("k_tie"))
    near = history.join(latest, same)
    placed = near.withColumn("k_place", F.row_number().over(W.partitionBy("k_time", "k_tie").orderBy(F.lit(1)))).withColumn("keep", F.col("k_place") <= F.col("room"))
    return placed.drop("k_time", "k_tie", "room", "k_place").unionByName(history.join(latest, same, "left_anti").withColumn("keep", F.lit(False)))


def keep_latest_by(history: DataFrame, key: str, time: str, tie: str, limits: dict[str, int], default: int = 1) -> DataFrame:
    """history with keep: the latest rows of each key, as many as its limit says."""
    limit = F.lit(default)
    for name, n in limits.items():
        limit = F.when(F.col(key) == name, n).otherwise(limit)
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc(time), F.desc(tie)))
    return history.withColumn("keep", place <= limit)


def latest_covering(history: DataFrame, group: str, time: str, tie: str, profile: str = "profile") -> DataFrame:
    """group, tier, and the latest row of a profile that covers the tier: its time, tie and profile."""
    tiers = F.array(*[F.struct(F.lit(tier).alias("tier"), F.col(profile).isin(names).alias("covers")) for tier, names in C.COVERED_BY.items()])
    each = history.withColumn("t", F.explode(F.filter(tiers, lambda x: x["covers"])))
    best = F.max_by(F.struct(F.col(time).alias("generated_at"), F.col(tie).alias("snapshot_id"), F.col(profile).alias("profile")), F.struct(time, tie))
    return each.groupBy(group, F.col("t.tier").alias("tier")).agg(best.alias("best")).select(group, "tier", "best.*")


def fingerprint(sessions: DataFrame, events: DataFrame, warnings: DataFrame, blobs: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """One row: what a snapshot remembers of an archive; with an inventory (bytes, mtime), of its source files too."""
    parts = [
        sessions.agg(F.count("*").alias("sessions"), F.max("updated_at").alias("updated_at")),
        events.agg(F.count("*").alias("events")),
        warnings.agg(F.count("*").alias("warnings")),
        blobs.agg(F.count("*").alias("blobs"), F.coalesce(F.sum("original_bytes"), F.lit(0)).alias("original_bytes")),
    ]
    if source is not None:
        parts.append(source.agg(F.struct(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.max("mtime").alias("latest_mtime")).alias("source")))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out


def changed(tier: str, now: str = "now", then: str = "then") -> Column:
    """Whether a state differs from an older one in what a tier covers; two struct columns."""
    fields = ["sessions", "events", "warnings", "updated_at"] + (["blobs", "original_bytes"] if tier != "core" else []) + (["source"] if tier == "forensic" else [])
    out = F.lit(False)
    for f in fields:
        out = out | ~F.col(f"{now}.{f}").eqNullSafe(F.col(f"{then}.{f}"))
    return out


def changed_since(pairs: DataFrame, tier: str) -> DataFrame:
    """pairs (now, then: structs) with changed."""
    return pairs.withColumn("changed", F.col("then").isNull() | changed(tier))


def due_tier(history: DataFrame, state: DataFrame, group: str, now: Column) -> DataFrame:
    """group, profile, reason: which snapshot each archive is due for.

    history: group, profile, generated_at, tie, state (struct); state: group, now (struct). An archive without history
    gets evidence; then forensic, evidence and core are due in this order when their days have gone by and what they
    cover has changed.
    """
    latest = latest_covering(history.withColumn("tie", F.struct("tie", "state")), group, "generated_at", "tie")
    wide = latest.groupBy(group).pivot("tier", list(C.COVERED_BY)).agg(F.first(F.struct("generated_at", F.col("snapshot_id.state").alias("state"))))
    oldest = history.groupBy(group).agg(F.min("generated_at").alias("oldest"))
    joined = state.join(wide, group, "left").join(oldest, group, "left")

    def due(tier: str) -> Column:
        old = F.col(f"{tier}.generated_at").isNull() | (F.datediff(now, F.col(f"{tier}.generated_at")) >= C.TIER_DAYS[tier])
        return old & (F.col(tier).isNull() | changed(tier, "now", f"{tier}.state"))

    forensic = (F.datediff(now, F.col("oldest")) >= C.TIER_DAYS["forensic"]) & due("forensic")
    name = F.when(F.col("oldest").isNull(), "bootstrap_evidence").when(forensic, "monthly_forensic_due").when(due("evidence"), "weekly_evidence_due").when(due("core"), "daily_core_due").otherwise("fresh_or_unchanged")
    profile = F.when(name.endswith("forensic_due"), "forensic").when(name.endswith("evidence_due") | (name == "bootstrap_evidence"), "evidence").when(name == "daily_core_due", "core")
    return joined.select(group, profile.alias("profile"), name.alias("reason"))
