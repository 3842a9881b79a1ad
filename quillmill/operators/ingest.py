"""Incremental import: what is new, what replaces what, and the queue of requests."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillmill.operators import normalize as N
from quillmill.operators import pairing
from quillmill.operators.archive import Archive
from quillmill.operators.blobs import hydrate, referenced, verify_blobs
from quillmill.operators.hot import cold_blobs, new_blobs, to_hot
from quillmill.operators.index import update_index
from quillmill.operators.policy import classify_index, dedupe_bodies, without_bodies
from quillmill.operators.stats import archive_digest, counts_equal, session_statistics
from quillmill.operators.turns import SETTINGS, assign_turns, roll_up_turns, with_settings
from quillmill.sources import transcripts as T
from quillmill.storage import Stage, written


def freshness(inventory: DataFrame, log: DataFrame, version: int, archive_there: bool = True) -> DataFrame:
    """inventory (path, archived, bytes, mtime) with reason, null where nothing is to do.

    log: raw_path, status, imported_at, parse_version. One second of difference between clocks is let pass.
    """
    last = log.where("status = 'imported'").groupBy(F.col("raw_path").alias("path")).agg(F.max("imported_at").alias("imported_at"), F.max("parse_version").alias("parse_version"))
    late = F.col("imported_at").isNull() | (F.col("mtime") > F.col("imported_at") + F.expr("interval 1 second"))
    reason = (
        F.when(F.lit(not archive_there), "archive_missing")
        .when(F.col("known").isNull(), "not_imported")
        .when(~F.col("parse_version").eqNullSafe(F.lit(version)), "parser_version_changed")
        .when(F.col("mtime").isNull(), "source_unreadable")
        .when(late, "modified_after_import")
    )
    return inventory.join(last.withColumn("known", F.lit(True)), "path", "left").withColumn("reason", reason).drop("known", "imported_at", "parse_version")


def freshness_summary(plan: DataFrame) -> DataFrame:
    """Pending files and bytes by reason."""
    return plan.where("reason is not null").groupBy("reason").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def files_to_import(files: DataFrame, log: DataFrame, version: int) -> DataFrame:
    """Files (path, raw_sha256) of which no import of the same content by the same parser is logged."""
    done = log.where((F.col("status") == "imported") & (F.col("parse_version") == version)).select(F.col("raw_path").alias("path"), "raw_sha256").distinct()
    return files.join(done, ["path", "raw_sha256"], "left_anti")


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, warnings) of lines (path, line_no, value), before sessions are known."""
    objects, broken = T.split_valid(lines)
    events, odd = N.normalize(objects)
    return events, broken.unionByName(odd)


def import_lines(lines: DataFrame, state: DataFrame | None = None, after: int = 0) -> dict[str, DataFrame]:
    """sessions, turns, events, warnings of lines (path, line_no, value): parse, name, pair, cut into turns, classify.

    Event ids come after ``after``. Where two files tell of one session, the last one has it.
    """
    return import_events(*parse_lines(lines), state, after)


def import_events(events: DataFrame, broken: DataFrame, state: DataFrame | None = None, after: int = 0, stage=lambda df, name: df) -> dict[str, DataFrame]:
    """The frames of parsed events, which several of them read. stage(df, name): what is computed once for all of them."""
    events, unnamed = N.assign_sessions(events)
    warnings = broken.unionByName(unnamed)
    pairs = pairing.pairing_warnings(pairing.calls_of(events)).select("path", "line_no", "code", F.col("call_id").alias("raw_excerpt"))
    warnings = warnings.unionByName(pairs)
    sessions = N.roll_up_sessions(events, warnings)
    if state is not None:
        sessions = N.enrich(sessions, state)
    sessions = stage(N.last_files(sessions), "sessions")
    names = sessions.select("path", F.col("session_id").alias("final"))
    events = N.assign_event_ids(events.join(names, "path").withColumn("session_id", F.col("final")).drop("final"), after)
    # a file without a single record has no session: its warnings stay under a null one
    warnings = warnings.join(names.withColumnRenamed("final", "session_id"), "path", "left")
    whole = stage(assign_turns(events), "events")
    # the storage policy acts first: the index sees the text as it is stored
    stored = stage(without_bodies(dedupe_bodies(classify_index(to_hot(whole)))), "stored")
    return {"sessions": sessions, "turns": roll_up_turns(with_settings(whole), SETTINGS), "events": stored, "warnings": warnings, "blobs": cold_blobs(whole), "statistics": session_statistics(stored)}


def replace_sessions(target: DataFrame, new: DataFrame, key: str = "session_id") -> DataFrame:
    """A table with the new rows of their sessions in place of all old ones."""
    return target.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def read_archive(spark, path: str, name: str) -> DataFrame | None:
    """A table of an archive's last version; None if it is not there."""
    return Archive(spark, path).read(name)


def write_archive(frames: dict[str, DataFrame], path: str) -> int:
    """Adds tables to an archive, where their sessions replace what it holds of them, and returns the version. A run that
    is cut off leaves the archive as it was, and can be run again. Blobs that the archive has are not stored again."""
    archive = Archive(next(iter(frames.values())).sparkSession, path)
    return archive.write(frames | ({"blobs": new_blobs(frames["blobs"], archive)} if "blobs" in frames else {}))


def dedupe_requests(requests: DataFrame) -> DataFrame:
    """The first active request of each (source, home, reason), nulls equal; requests that are over stay as they are."""
    active = F.col("status").isin("pending", "processing")
    place = F.row_number().over(W.partitionBy("source", "home", "reason", active).orderBy("created_at", "request_id"))
    return requests.withColumn("active", active).withColumn("place", place).where("not active or place = 1").drop("active", "place")


STATUSES = ["pending", "processing", "completed", "failed"]


def queue_list(requests: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    if status is not None and status not in STATUSES:
        raise ValueError(f"no such status: {status}")
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1 to 500")
    some = requests if status is None else requests.where(F.col("status") == status)
    return some.orderBy(F.desc("created_at"), F.desc("request_id")).limit(limit)


def queue_pending(requests: DataFrame, limit: int = 100) -> DataFrame:
    """The oldest pending requests, first in, first out."""
    return requests.where("status = 'pending'").orderBy("created_at", "request_id").limit(limit)


def queue_latest(requests: DataFrame) -> DataFrame:
    """The latest request of each source."""
    return requests.groupBy("source").agg(F.max_by(F.struct(*requests.columns), F.struct("created_at", "request_id")).alias("r")).select("r.*")


def queue_step(requests: DataFrame, results: DataFrame, limit: int = 100) -> DataFrame:
    """The queue after a step: of the oldest pending requests, those with a result (request_id, failed, message) are over."""
    taken = queue_pending(requests, limit).select("request_id", F.lit(True).alias("taken"))
    joined = requests.join(F.broadcast(taken), "request_id", "left").join(results.select("request_id", "failed", F.col("message").alias("new_message"), F.lit(True).alias("has_result")), "request_id", "left")
    took, over = F.col("taken").isNotNull(), F.col("has_result").isNotNull()
    status = F.when(took & over, F.when(F.col("failed") > 0, "failed").otherwise("completed")).when(took, "processing").otherwise(F.col("status"))
    return joined.withColumn("status", status).withColumn("attempts", F.col("attempts") + took.cast("long")).withColumn("message", F.when(took & over, F.col("new_message")).otherwise(F.col("message"))).drop("taken", "failed", "new_message", "has_result")


LOG = "raw_path string, raw_sha256 string, session_id string, status string, imported_at timestamp, parse_version int"
#: Files that one import reads, and commits, together: their names are constants of its plan.
SLICE = 10_000


def import_log(spark, target: str) -> DataFrame:
    """The import log of an archive."""
    log = read_archive(spark, target, "log")
    return spark.createDataFrame([], LOG) if log is None else log


def import_uris(spark, root: str, target: str, uris: list[str], version: int, state: DataFrame | None = None, log: DataFrame | None = None, index: str | None = None) -> list[tuple]:
    """Imports files into an archive and logs them there, in one version; returns the rows of the log.

    Files whose content the log (the archive's own, if none is given) has by this version are logged again, not read
    again. A file that cannot be read, or holds nothing, is logged as failed and does not stop the others. index: the
    path of a search index that takes in the same sessions; catch_up mends one that an import was cut off from.
    """
    known = import_log(spark, target) if log is None else log
    found = T.file_digests(spark, root, uris).collect()  # a row for each file of the slice
    files = spark.createDataFrame([(r.path, r.raw_sha256) for r in found], "path string, raw_sha256 string")
    todo = {r.path for r in files_to_import(files, known, version).select("path").collect()}
    now = datetime.datetime.now(datetime.timezone.utc)
    logged = lambda sessions: [(r.path, r.raw_sha256, sessions.get(r.path), "imported" if r.path not in todo or r.path in sessions else "failed", now, version) for r in found]
    if not todo:
        if found:
            write_archive({"log": spark.createDataFrame(logged({}), LOG)}, target)
        return logged({})
    with Stage(spark) as stage:
        lines = T.scan_lines(spark, root, [r.uri for r in found if r.path in todo])
        events, broken = (stage(x, name) for x, name in zip(parse_lines(lines), ("parsed", "broken")))
        frames = import_events(events, broken, state, Archive(spark, target).last_event_id, stage)
        named = N.assign_sessions(events)[0].select("path", "session_id").distinct()
        named = N.enrich(N.roll_up_sessions(N.assign_sessions(events)[0], broken), state).select("path", "session_id") if state is not None else named
        rows = logged({r.path: r.session_id for r in named.collect()})
        write_archive(frames | {"log": spark.createDataFrame(rows, LOG)}, target)
        if index is not None:
            update_index(frames["events"], index)
    return rows


def import_files(spark, root: str, target: str, log: DataFrame | None, version: int, state: DataFrame | None = None, index: str | None = None) -> DataFrame:
    """Imports the files below root that are pending into an archive; returns the new rows of the log, which the archive
    keeps too. log: the archive's own, if None.

    Only files that are new, changed since their import, or imported by another parser are read. The list of pending
    files passes through the driver, as the listing of the folder does; they are imported in slices, each a version.
    """
    known = import_log(spark, target) if log is None else log
    pending = freshness(T.inventory(spark, root), known, version).where("reason is not null").orderBy("archived", "path")
    uris = [r.uri for r in pending.select("uri").collect()]
    rows = [r for k in range(0, len(uris), SLICE) for r in import_uris(spark, root, target, uris[k : k + SLICE], version, state, log, index)]
    return spark.createDataFrame(rows, LOG)


def sync(spark, root: str, target: str, log: DataFrame | None, version: int, state: DataFrame | None = None, index: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(log with the new rows, what is still to do): imports what is pending into an archive, and plans again."""
    before = import_log(spark, target) if log is None else log
    whole = before.unionByName(import_files(spark, root, target, log, version, state, index))
    return whole, freshness(T.inventory(spark, root), whole, version).where("reason is not null")


def rebuild(events: DataFrame, stored: DataFrame, stage=lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """(events, checks): all policies applied anew to whole payloads, and whether counts and digest hold.

    The digests are of the messages of the whole payloads, and of those of the rebuilt events. A rebuilt archive is
    written beside the old one and takes its place only where every check is true. stage(df, name): what is computed
    once for events and checks.
    """
    plain = events.drop("storage_class", "index_policy", "value_level", "indexed_text", "content_flags")
    marks = [c for c in ("duplicate", "payload_stub") if c in plain.columns]
    plain = plain.withColumnsRenamed({c: f"was_{c}" for c in marks})
    sizes = [c for c in ("payload_original_bytes", "text_original_chars") if c in plain.columns]
    whole = stage(hydrate(plain.withColumnsRenamed({c: f"was_{c}" for c in sizes}), stored), "whole")
    hot = to_hot(whole.drop("payload_ref"))
    for c in sizes:  # what was cut before keeps the size that it had
        hot = hot.withColumn(c, F.coalesce(f"was_{c}", c)).drop(f"was_{c}")
    new = without_bodies(dedupe_bodies(classify_index(hot)))
    if len(marks) == 2:  # a body that went as a duplicate stays one: its text is in the message that it repeats
        for c, value in (("index_policy", F.lit("skip_duplicate")), ("value_level", F.lit("noise")), ("payload_stub", F.col("was_payload_stub")), ("duplicate", F.lit(True))):
            new = new.withColumn(c, F.when(F.coalesce("was_duplicate", F.lit(False)), value).otherwise(F.col(c)))
        new = new.drop("was_duplicate", "was_payload_stub")
    new = stage(new, "rebuilt")
    return new, rebuild_checks(events, whole, new)


def rebuild_archive(spark, source: str, target: str) -> DataFrame:
    """table, equal: the checks of an archive that is rebuilt at a new path; it is there only if all of them are true.

    The whole payloads come from the source's blobs, of which the target keeps those that the rebuilt events refer to;
    that these are all there is one of the checks.
    """
    old = Archive(spark, source)
    if Archive(spark, target).version:
        raise ValueError(f"{target} is not empty")
    frames = {name: old.read(name) for name in ("sessions", "turns", "events", "warnings", "log") if old.segments(name)}
    stored = old.read("blobs")
    with Stage(spark) as stage:
        new, checks = rebuild(frames["events"], stored, stage)
        refs = stage(referenced(new), "references")
        kept = stored.join(refs, "blob_id", "left_semi")
        own = refs.join(new.select(F.col("payload_ref").alias("blob_id")).distinct(), "blob_id", "left_semi")
        missing = verify_blobs(own, kept, deep=False).agg(F.lit("blobs").alias("table"), (F.count("*") == 0).alias("equal"))
        checks = written(checks.unionByName(missing), "checks")
        if checks.where("not equal").isEmpty():
            Archive(spark, target).write(frames | {"events": new, "blobs": kept, "statistics": session_statistics(new)})
    return checks


def rebuild_checks(events: DataFrame, whole: DataFrame, new: DataFrame) -> DataFrame:
    """table, equal: whether rebuilt events are as many as before, and say in their messages what the whole ones say."""
    before, after = archive_digest(whole), archive_digest(new)
    same = before.select("digest").join(after.select(F.col("digest").alias("other"))).select(F.lit("digest").alias("table"), (F.col("digest") == F.col("other")).alias("equal"))
    return counts_equal({"events": events}, {"events": new}).select("table", "equal").unionByName(same)
