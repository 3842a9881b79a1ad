"""The versioned archive, its hot and cold store, and scans of files in many splits."""

from __future__ import annotations

import base64
import json

import pytest
from pyspark.sql import functions as F

from quillmill.operators import archive as A
from quillmill.operators import blobs, ingest
from quillmill.sources import transcripts as T

EVENTS = "session_id string, event_id long, text string"


def frames(spark, names, first, text="t", lines=3):
    events = [(f"s{n}", first + k * lines + j, f"{text}{j}") for k, n in enumerate(names) for j in range(lines)]
    return {"sessions": spark.createDataFrame([(f"s{n}", text) for n in names], "session_id string, note string"), "events": spark.createDataFrame(events, EVENTS)}


def held(spark, path, version=None):
    rows = A.Archive(spark, path, version).read("events")
    out: dict = {}
    for r in sorted(rows.collect() if rows is not None else [], key=lambda r: (r.session_id, r.text)):
        out.setdefault(r.session_id, []).append(r.text)
    return out


def whole(names, text="t", lines=3):
    return {f"s{n}": [f"{text}{j}" for j in range(lines)] for n in names}


@pytest.mark.parametrize("step", ["sessions", "events", "_owners", "_dead", "before commit", "after commit"])
def test_a_write_that_is_cut_off_loses_nothing(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "a")
    A.Archive(spark, path).write(frames(spark, range(6), 1))
    new = frames(spark, [2, 6], 100, "new")

    class Killed(Exception):
        pass

    with monkeypatch.context() as m:
        put_table, put_dead, put = A.Archive._put_table, A.Archive._put_dead, A.Files.put

        def dies(self, df, name, seg):
            if name == step:
                df.limit(1).write.parquet(f"{self.path}/{name}/seg={seg}")  # half of it is there
                raise Killed
            return put_table(self, df, name, seg)

        def dies_dead(self, rows):
            out = put_dead(self, rows)
            if step == "_dead":
                raise Killed
            return out

        def dies_put(self, at, text):
            if step == "before commit":
                raise Killed
            out = put(self, at, text)
            if step == "after commit":
                raise Killed
            return out

        m.setattr(A.Archive, "_put_table", dies)
        m.setattr(A.Archive, "_put_dead", dies_dead)
        m.setattr(A.Files, "put", dies_put)
        with pytest.raises(Killed):
            A.Archive(spark, path).write(new)
    after = whole(range(6)) if step != "after commit" else whole(range(6)) | whole([2, 6], "new")
    assert held(spark, path) == after
    A.Archive(spark, path).write(frames(spark, [2, 6], 200, "new"))
    assert held(spark, path) == whole(range(6)) | whole([2, 6], "new")
    gone = A.Archive(spark, path).vacuum(keep=1, seconds=0)
    assert gone and not A.Archive(spark, path).vacuum(keep=1, seconds=0)
    assert held(spark, path) == whole(range(6)) | whole([2, 6], "new")


def test_an_import_writes_in_proportion_to_itself(spark, tmp_path):
    path = str(tmp_path / "a")
    first = A.Archive(spark, path)
    text = F.sha2(F.col("id").cast("string"), 512)
    first.write({"sessions": spark.range(100).select(F.concat(F.lit("s"), "id").alias("session_id"), F.lit("x").alias("note")), "events": spark.range(20_000).select(F.concat(F.lit("s"), F.col("id") % 100).alias("session_id"), (F.col("id") + 1).alias("event_id"), text.alias("text"))})
    before = first.files.size(path)
    A.Archive(spark, path).write(frames(spark, [7], 90_000, "new"))
    assert first.files.size(path) - before < before / 50
    assert first.version == 1 and first.read("events").where("session_id = 's7'").count() == 200
    assert held(spark, path)["s7"] == whole([7], "new")["s7"] and len(held(spark, path)["s8"]) == len(held(spark, path, 1)["s7"]) == 200


def test_segments_of_one_size_are_merged(spark, tmp_path):
    path, want = str(tmp_path / "a"), {}
    for k in range(A.FAN + 2):
        A.Archive(spark, path).write(frames(spark, [k, k + 1], 10 * k + 1, f"v{k}-"))
        want |= whole([k, k + 1], f"v{k}-")
    now = A.Archive(spark, path)
    assert held(spark, path) == want and len(now.manifest["segments"]) == 3 and now.last_event_id == 10 * (A.FAN + 1) + 6
    now.compact()
    assert held(spark, path) == want and len(now.manifest["segments"]) == 1 and not now.manifest["dead"]
    assert now.read("events").count() == 3 * len(want)
    files = now.files
    now.vacuum(keep=1, seconds=0)
    assert len(files.names(f"{path}/events")) == 1 and held(spark, path) == want
    with pytest.raises(ValueError):
        A.Archive(spark, path, 1)


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "a")
    one, two = A.Archive(spark, path), A.Archive(spark, path)
    one.write(frames(spark, [1, 2], 1))
    two.write({"sessions": spark.createDataFrame([("s2", "z")], "session_id string, note string"), "events": spark.createDataFrame([("s2", 50, "other")], EVENTS)})
    assert held(spark, path) == whole([1]) | {"s2": ["other"]}
    three, four = A.Archive(spark, path), A.Archive(spark, path)
    three.write(frames(spark, [3], 51))
    with pytest.raises(A.Conflict):
        four.write(frames(spark, [4], 51))  # the same event ids
    assert held(spark, path) == whole([1, 3]) | {"s2": ["other"]}
    A.Archive(spark, path).write({"events": spark.createDataFrame([("s9", 90, "a", 1)], EVENTS + ", more int")})
    assert {(r.session_id, r.more) for r in A.Archive(spark, path).read("events").where("event_id > 53 or event_id = 50").collect()} == {("s2", None), ("s9", 1)}


def record(kind, at, **payload):
    return {"type": kind, "timestamp": at, "payload": payload}


IMAGE = base64.b64encode(b"\x89PNG" + bytes(range(200)) * 20).decode()
OUTPUT = "line of output " * 400


def put(root, name, **more):
    lines = [
        record("session_meta", "2026-02-01T10:00:00Z", id=f"id-{name}", cwd="/w", instructions="y" * 900),
        record("event_msg", "2026-02-01T10:00:01Z", type="user_message", message=f"hello {name}"),
        record("response_item", "2026-02-01T10:00:02Z", type="function_call", name="shell", call_id="c1", arguments="z" * 700),
        record("response_item", "2026-02-01T10:00:03Z", type="function_call_output", call_id="c1", output=OUTPUT),
        record("response_item", "2026-02-01T10:00:04Z", type="message", role="user", content=[{"type": "input_text", "text": "see"}, {"type": "input_image", "image_url": f"data:image/png;base64,{IMAGE}"}]),
        record("response_item", "2026-02-01T10:00:05Z", type="message", role="assistant", content=[{"type": "output_text", "text": "done"}]),
        record("event_msg", "2026-02-01T10:00:06Z", type="agent_message", message="done"),
        record("event_msg", "2026-02-01T10:00:07Z", type="token_count", info={"n": 1}),
        record("compacted", "2026-02-01T10:00:08Z", message="so far", replacement_history=[{"a": 1}, {"b": 2}]),
        record("event_msg", "2026-02-01T10:00:09Z", type="big", blob="w" * 20_000),
    ]
    path = root / "sessions" / f"{name}.jsonl"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(map(json.dumps, lines)) + "\n", encoding="utf-8")


def test_import_fills_hot_and_cold_store(spark, tmp_path):
    root, target = tmp_path / "home", str(tmp_path / "archive")
    put(root, "a")
    ingest.sync(spark, str(root), target, None, 3)
    now = A.Archive(spark, target)
    events = {(r.top_type, r.sub_type): r for r in now.read("events").collect()}
    output = events["response_item", "function_call_output"]
    assert "stored in cold evidence" in output.text_content and len(output.text_content) < 2100 and output.text_original_chars == len(OUTPUT)
    assert output.content_flags == ["payload_cold", "payload_slimmed", "text_truncated"] and len(output.payload) < 400
    assert json.loads(output.payload)["cold_ref"] == output.payload_ref == json.loads(output.payload)["original_sha256"]
    compacted = events["compacted", None]
    assert {k: json.loads(compacted.payload)[k] for k in ("message_chars", "replacement_history_count", "cold_ref")} == {"message_chars": 6, "replacement_history_count": 2, "cold_ref": compacted.payload_ref}
    assert "replacement_history_externalized" in compacted.content_flags and compacted.text_content == "so far"
    noise = events["event_msg", "token_count"]
    assert noise.text_content is None and json.loads(noise.payload)["storage"] == "dropped" and noise.content_flags == ["payload_dropped", "text_dropped"]
    call = json.loads(events["response_item", "function_call"].payload)
    assert call["arguments_chars"] == 700 and "arguments" not in call
    assert events["event_msg", "big"].storage_class == "evidence" and events["event_msg", "user_message"].payload_ref is None
    assert events["event_msg", "agent_message"].index_policy == "skip_duplicate"
    kinds = sorted(r.kind for r in now.read("blobs").collect())
    assert kinds == ["asset:image/png", "compacted_history", "event_msg:big", "response_item:function_call_output", "session_meta"]
    assert blobs.verify_blobs(blobs.referenced(now.read("events")), now.read("blobs")).count() == 0
    detail = blobs.event_detail(now.read("events"), now.read("blobs"), output.event_id).first()
    assert detail.text_content == OUTPUT and json.loads(detail.payload)["output"] == OUTPUT


def test_known_blobs_are_not_stored_again_and_a_rebuild_holds(spark, tmp_path):
    root, target = tmp_path / "home", str(tmp_path / "archive")
    put(root, "a")
    ingest.sync(spark, str(root), target, None, 3)
    put(root, "b")
    log, pending = ingest.sync(spark, str(root), target, None, 3)
    assert log.count() == 2 and pending.count() == 0
    now = A.Archive(spark, target)
    sizes = {s: x["blobs"]["bytes"] for s, x in ((s, x["tables"]) for s, x in now.manifest["segments"].items())}
    added = [now.read("blobs", [s]).count() for s in sizes]
    assert sorted(added) == [1, 5]  # the second file's own session_meta alone
    checks = ingest.rebuild_archive(spark, target, str(tmp_path / "new"))
    assert {r.table: r.equal for r in checks.collect()} == {"events": True, "digest": True, "blobs": True}
    columns = ("session_id", "line_no", "payload", "text_content", "payload_ref", "index_policy", "payload_original_bytes", "text_original_chars")
    old, new = (sorted(map(tuple, A.Archive(spark, p).read("events").select(*columns).collect()), key=repr) for p in (target, str(tmp_path / "new")))
    assert old == new and A.Archive(spark, str(tmp_path / "new")).read("blobs").count() == 6
    with pytest.raises(ValueError):
        ingest.rebuild_archive(spark, target, str(tmp_path / "new"))
    lost = now.read("blobs").where("kind <> 'compacted_history'")
    assert [r.error for r in blobs.verify_blobs(blobs.referenced(now.read("events")), lost).collect()] == ["missing_blob"]


def test_a_rebuild_computes_its_events_once(spark, tmp_path, monkeypatch):
    """The checks are those of the events that are written, without the policies again; no scratch table stays."""
    from quillmill.storage import shared_folder, written

    root, target, plans = tmp_path / "home", str(tmp_path / "archive"), {}
    put(root, "a")
    ingest.sync(spark, str(root), target, None, 3)

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return written(df, name)

    monkeypatch.setattr(ingest, "written", noted)
    files = A.Files(spark, shared_folder(spark))
    before = set(files.names(shared_folder(spark)))
    assert all(r.equal for r in ingest.rebuild_archive(spark, target, str(tmp_path / "new")).collect())
    assert list(plans) == ["checks"] and "json" not in plans["checks"]
    assert {x.partition("-")[0] for x in set(files.names(shared_folder(spark))) - before} == {"checks"}


def test_statistics_follow_the_imports(spark, tmp_path):
    """Sums, digests and sketches of the sessions' rows are those of the events, also where sessions came anew."""
    from quillmill.operators import stats

    root, target = tmp_path / "home", str(tmp_path / "archive")
    put(root, "a")
    put(root, "b")
    ingest.sync(spark, str(root), target, None, 3)
    path = root / "sessions" / "a.jsonl"
    path.write_text(path.read_text() + json.dumps(record("event_msg", "2026-02-01T10:01:00Z", type="user_message", message="more")) + "\n")
    ingest.import_uris(spark, str(root), target, [r.uri for r in T.inventory(spark, str(root)).where("path like '%/a.jsonl'").collect()], 3)
    now = A.Archive(spark, target)
    got, events = stats.stored_statistics(now.read("statistics")).first(), now.read("events")
    want = stats.archive_stats(now.read("sessions"), events, now.read("warnings")).first()
    assert (got.sessions, got.events, got.turns, got.tool_calls, got.files) == (want.sessions, want.events, want.turns, want.tool_calls, want.files) == (2, 21, got.turns, 2, 1)
    assert got.digest == stats.archive_digest(events).first().digest


def test_lines_of_files_in_many_splits(spark, tmp_path):
    """The same numbers whatever the splits, and no exchange of texts."""
    sizes = [0, 1, 700, 3]
    for k, n in enumerate(sizes):
        path = tmp_path / "sessions" / f"f {k}.jsonl"
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"".join(b"" + (b"" if j % 7 == 3 else b"line %d of %d" % (j, k)) + (b"\r\n" if j % 5 else b"\n") for j in range(n)))
    want = sorted((f"f {k}.jsonl", j + 1, f"line {j} of {k}") for k, n in enumerate(sizes) for j in range(n) if j % 7 != 3)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for size in ("128m", "1k"):
            spark.conf.set(names[0], size)
            spark.conf.set(names[1], "100")
            lines = T.scan_lines(spark, str(tmp_path))
            assert sorted((r.path.rpartition("/")[2], r.line_no, r.value) for r in lines.collect()) == want
            plan = lines._jdf.queryExecution().executedPlan().toString()
            assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "value" in x]
        assert lines.select(F.spark_partition_id().alias("p")).distinct().count() > 5
        a, b = (sorted((r.path, r.raw_sha256) for r in T.file_digests(spark, str(tmp_path), large=1000).collect()) for _ in range(2))
        assert a == b and [x[1][:6] == "lines:" for x in a] == [False, True, False]
        spark.conf.set(names[0], "128m")
        assert sorted((r.path, r.raw_sha256) for r in T.file_digests(spark, str(tmp_path), large=1000).collect()) == a
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
