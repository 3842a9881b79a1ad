"""Continuous import and live pairing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillmill.operators.ingest import import_uris
from quillmill.sources import transcripts as T


def stream_import(spark: SparkSession, root: str, target: str, checkpoint: str, files_per_batch: int = 1000, version: int = 1):
    """Imports new transcript files as they come, whole files at a time; runs over what is there and stops.

    Each batch is a set of files, which alone are read, as a batch job, and makes one version of the archive: a file's
    sessions replace what the archive holds of them, all others stay. Files whose content the archive's log has by this
    parser version are logged again and not read, so that a batch that is run again adds nothing.
    """
    files = spark.readStream.format("binaryFile").options(**T.JSONL).option("maxFilesPerTrigger", files_per_batch).schema("path string, modificationTime timestamp, length long, content binary").load(root)

    def apply(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        uris = [r.uri for r in batch.select("uri").distinct().collect()]  # files_per_batch at most
        if uris:
            import_uris(spark, root, target, uris, version)

    return files.select(F.col(T.URI).alias("uri")).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "calls int, outputs int, last_call int"
OUT = "path string, call_id string, line_no int, code string"


def stream_pairing(calls: DataFrame, delay: str = "10 minutes", wait_ms: int = 600_000) -> DataFrame:
    """Pairing warnings of a stream of calls (path, call_id, line_no, kind, ts), each as it is known.

    Orphans and duplicates come with their batch. A call without an output is reported when the watermark has passed its
    time by ``wait_ms``; its state is dropped then.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        path, call_id = key
        n_calls, n_outputs, last = state.get if state.exists else (0, 0, 0)
        if state.hasTimedOut:
            state.remove()
            if n_calls and not n_outputs:
                yield pd.DataFrame([(path, call_id, last, "missing_function_call_output")], columns=["path", "call_id", "line_no", "code"])
            return
        out, latest = [], 0
        rows = pd.concat(list(batches)).sort_values("line_no")
        for line_no, kind, ts in zip(rows["line_no"], rows["kind"], rows["ts"]):
            latest = max(latest, int(ts.timestamp() * 1000))
            if kind == "call":
                n_calls, last = n_calls + 1, int(line_no)
                continue
            if not n_calls:
                out.append((path, call_id, int(line_no), "orphan_function_call_output"))
            elif n_outputs:
                out.append((path, call_id, int(line_no), "duplicate_function_call_output"))
            n_outputs += 1
        state.update((n_calls, n_outputs, last))
        state.setTimeoutTimestamp(max(latest + wait_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["path", "call_id", "line_no", "code"])

    return calls.withWatermark("ts", delay).groupBy("path", "call_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


ACTIVE = ("pending", "processing")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _ActiveRequest(StatefulProcessor):
    """Of each (source, home, reason) the active request, until a record says that it is over, or its time has passed."""

    def __init__(self, wait_ms: int, columns: list[str]):
        self.wait_ms, self.columns = wait_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getValueState("active", "request_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        some = pd.concat(list(rows)).sort_values(["created_at", "request_id"], kind="stable")
        now = self.active.get()[0] if self.active.exists() else None
        before, kept, latest = now, [], None
        for place, (request_id, status, created_at) in enumerate(zip(some["request_id"], some["status"], some["created_at"])):
            if status not in ACTIVE:
                now = None if now == request_id else now
            elif now is None:
                now, latest = int(request_id), created_at
                kept.append(place)
        if now != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if now is None:
                self.active.clear()
            else:
                self.active.update((now,))
                self.handle.registerTimer(max(int(latest.timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.wait_ms)
        if kept:
            yield some.iloc[kept][self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.active.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_requests(requests: DataFrame, delay: str = "1 hour", wait_ms: int = 86_400_000) -> DataFrame:
    """Of a stream of requests (request_id, source, home, reason, status, created_at), those that become active: a pending
    (or, without a status, any) or processing one, if no other of its source, home and reason is active; a null home equals a null home.

    Records of status completed or failed with the active request's id end it, so that the next one passes; a request of
    which no end is heard is over when the watermark has passed its time by ``wait_ms``. Within a batch records count in
    the order of created_at and request_id. State is a number for each active request, in RocksDB, which this sets as the
    session's state store.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    columns = ["request_id", "source", "home", "reason", "status", "created_at"]
    requests = requests if "status" in requests.columns else requests.withColumn("status", F.lit("pending"))
    keyed = requests.select(*columns, F.coalesce("home", F.lit("")).alias("home_key")).withWatermark("created_at", delay)
    grouped = keyed.groupBy("source", "home_key", "reason")
    schema = requests.select(*columns).schema
    return grouped.transformWithStateInPandas(_ActiveRequest(wait_ms, columns), schema, "Append", "EventTime")
