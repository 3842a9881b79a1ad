"""Transcript files: lines, shapes, sessions, warnings, turns, import, stream."""

import json
import time

import pytest
from pyspark.sql import functions as F

from quillmill.operators import ingest, pairing, summary
from quillmill.operators import normalize as N
from quillmill.operators.turns import assign_turns
from quillmill.sources import transcripts as T
from quillmill.streaming.ingest import stream_import


def record(kind, ts, **payload):
    return {"timestamp": ts, "type": kind, "payload": payload}


CURRENT = [
    record("session_meta", "2026-01-01T10:00:00Z", id="s-cur", session_id="s-parent-thread", cwd="/work/app", source="cli", model_provider="p", forked_from_id="s-parent"),
    record("turn_context", "2026-01-01T10:00:01Z", model="m", effort="high"),
    record("event_msg", "2026-01-01T10:00:02Z", type="user_message", message="run pytest please"),
    record("response_item", "2026-01-01T10:00:03Z", type="reasoning", summary=[{"type": "t", "text": "think"}]),
    record("response_item", "2026-01-01T10:00:04Z", type="function_call", name="shell", arguments='{"cmd":"pytest"}', call_id="c1"),
    record("response_item", "2026-01-01T10:00:05Z", type="function_call_output", call_id="c1", output="2 failed"),
    record("response_item", "2026-01-01T10:00:06Z", type="message", role="assistant", content=[{"type": "o", "text": "one"}, "two", {"type": "x"}]),
    record("brand_new", "2026-01-01T10:00:07Z", type="x"),
]
PAIRS = [
    record("session_meta", "2026-01-02T10:00:00Z", session_id="s-pair"),
    record("event_msg", "2026-01-02T10:00:01Z", type="user_message", message="first"),
    record("response_item", "2026-01-02T10:00:02Z", type="function_call", name="a", arguments="{}", call_id="m1"),
    record("response_item", "2026-01-02T10:00:03Z", type="function_call_output", call_id="o1", output="x"),
    record("response_item", "2026-01-02T10:00:04Z", type="function_call", name="a", arguments="{}", call_id="d1"),
    record("response_item", "2026-01-02T10:00:05Z", type="function_call_output", call_id="d1", output="x"),
    record("response_item", "2026-01-02T10:00:06Z", type="function_call_output", call_id="d1", output="x"),
    record("event_msg", "2026-01-02T10:00:07Z", type="user_message", message="second"),
    record("compacted", "2026-01-02T10:00:08Z", message="short of it", replacement_history=[]),
]
LEGACY = [
    {"id": "s-old", "timestamp": "2025-01-01T00:00:00Z", "instructions": "x"},
    {"record_type": "state", "timestamp": "2025-01-01T00:00:01Z"},
    {"type": "message", "role": "user", "timestamp": "2025-01-01T00:00:02Z", "content": [{"type": "t", "text": "old words"}]},
    {"type": "function_call", "name": "shell", "arguments": "{}", "call_id": "l1", "timestamp": "2025-01-01T00:00:03Z"},
]


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    root = tmp_path_factory.mktemp("home")

    def put(name, lines):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n", encoding="utf-8")

    put("sessions/current.jsonl", [*CURRENT[:2], "", *CURRENT[2:], '{"broken": ', "[1, 2]"])
    put("sessions/pairs.jsonl", PAIRS)
    put("archived_sessions/legacy.jsonl", LEGACY)
    put("sessions/nameless.jsonl", [record("event_msg", "2026-01-03T00:00:00Z", type="user_message", message="who am I")])
    return str(root)


@pytest.fixture(scope="module")
def frames(spark, home, tmp_path_factory):
    """Written and read again, as an archive is."""
    root, out = tmp_path_factory.mktemp("frames"), {}
    for name, df in ingest.import_lines(T.scan_lines(spark, home)).items():
        df.write.parquet(str(root / name))
        out[name] = spark.read.parquet(str(root / name))
    return out


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_inventory_and_lines(spark, home):
    files = T.inventory(spark, home)
    assert sorted(r.archived for r in files.collect()) == [False, False, False, True]
    lines = T.scan_lines(spark, home).where(F.col("path").contains("current"))
    assert [r.line_no for r in lines.orderBy("line_no").collect()] == [1, 2, 4, 5, 6, 7, 8, 9, 10, 11]
    assert T.file_digests(spark, home).count() == 4


def test_validity(spark, home):
    _, warnings = T.split_valid(T.scan_lines(spark, home))
    assert rows(warnings, "line_no", "code") == [(10, "invalid_json"), (11, "non_object_record")]


def test_sessions(frames):
    got = {r.session_id: r for r in frames["sessions"].collect()}
    assert set(got) == {"s-cur", "s-pair", "s-old", "nameless"}
    cur = got["s-cur"]
    assert (cur.cwd, cur.parent_session_id, cur.source_kind, cur.first_seen_at, cur.updated_at) == ("/work/app", "s-parent", "cli", "2026-01-01T10:00:00Z", "2026-01-01T10:00:07Z")
    assert cur.classifications == {"current": 7, "unknown": 1, "invalid_json": 1, "non_object_record": 1}
    assert got["s-old"].archived and got["s-old"].legacy and got["s-old"].source_kind == "unknown"


def test_events(frames):
    ev = {(r.session_id, r.line_no): r for r in frames["events"].collect()}
    assert len(ev) == 22
    assert ev["s-cur", 6].tool_name == "shell" and ev["s-cur", 6].text_content == 'shell {"cmd":"pytest"}'
    assert ev["s-cur", 8].text_content == "one\ntwo" and ev["s-cur", 8].role == "assistant"
    assert ev["s-cur", 5].storage_class == "noise" and ev["s-cur", 5].index_policy == "skip_empty"
    assert ev["s-cur", 9].top_type == "unknown" and ev["s-cur", 9].storage_class == "quarantine"
    assert ev["s-pair", 9].role == "assistant" and ev["s-pair", 9].text_content == "short of it"
    assert ev["s-old", 3].text_content == "old words"
    assert [ev["s-pair", k].turn_index for k in range(1, 10)] == [0] * 7 + [1, 1]
    ids = sorted(r.event_id for r in ev.values())
    assert ids == list(range(1, 23)) and max(r.event_id for r in ev.values() if r.session_id != "s-old") == 18


def test_warnings(frames):
    got = rows(frames["warnings"], "session_id", "line_no", "code")
    assert ("s-cur", 9, "unknown_current_type") in got and ("nameless", 0, "missing_session_id") in got
    assert [x for x in got if "function_call_output" in x[2]] == [("s-old", 4, "missing_function_call_output"), ("s-pair", 3, "missing_function_call_output"), ("s-pair", 4, "orphan_function_call_output"), ("s-pair", 7, "duplicate_function_call_output")]


def test_state_table_names_and_fills(spark, frames):
    path = frames["sessions"].where("session_id = 's-pair'").first().path
    state = T.thread_state(spark.createDataFrame([("s-new", path, "from state", "named")], "id string, rollout_path string, cwd string, title string"))
    got = N.enrich(frames["sessions"], state).where(F.col("path") == path).first()
    assert (got.session_id, got.cwd, got.state.title) == ("s-new", "from state", "named")


def test_repair(spark):
    ev = spark.createDataFrame([("s", 1, "unknown", None), ("s", 2, "unknown", None)], "session_id string, line_no int, top_type string, role string")
    wa = spark.createDataFrame([("s", 1, "unknown_current_type", "Unknown type: compacted"), ("s", 2, "unknown_current_type", "Unknown type: other")], "session_id string, line_no int, code string, message string")
    events, left = N.repair_types(ev, wa)
    assert rows(events, "line_no", "top_type", "role") == [(1, "compacted", "assistant"), (2, "unknown", None)]
    assert rows(left, "line_no") == [(2,)]


def test_pairing_against_a_loop(spark):
    import random

    rng, data, want = random.Random(3), [], []
    for path in range(40):
        calls, outputs = {}, {}
        for line in range(30):
            kind, cid = rng.choice(["call", "output"]), f"c{rng.randrange(6)}"
            data.append((str(path), line, kind, cid))
            if kind == "call":
                calls[cid] = line
            else:
                outputs[cid] = outputs.get(cid, 0) + 1
                if cid not in calls:
                    want.append((str(path), line, "orphan_function_call_output"))
                elif outputs[cid] > 1:
                    want.append((str(path), line, "duplicate_function_call_output"))
        want += [(str(path), line, "missing_function_call_output") for cid, line in calls.items() if cid not in outputs]
    calls = spark.createDataFrame(data, "path string, line_no int, kind string, call_id string")
    assert rows(pairing.pairing_warnings(calls), "path", "line_no", "code") == sorted(want, key=repr)


def test_turns_against_a_loop(spark):
    import random

    rng, data, want = random.Random(4), [], []
    for s in range(60):
        turn, last = 0, None
        for k in range(20):
            sub, text = rng.choice([("user_message", "hi"), ("user_message", ""), ("user_message", None), ("message", "x")])
            if sub == "user_message":
                turn += bool(last)
                last = text
            data.append((s * 100 + k, f"s{s}", "event_msg", sub, text))
            want.append((s * 100 + k, turn))
    events = spark.createDataFrame(data, "event_id long, session_id string, top_type string, sub_type string, text_content string")
    assert rows(assign_turns(events), "event_id", "turn_index") == sorted(want, key=repr)


def test_chunks(frames):
    se, ev = frames["sessions"], frames["events"]
    chunks = [c for c in summary.build_chunks(se, ev).collect() if c.session_id == "s-cur"]
    assert {c.chunk_type for c in chunks} == {"session_summary", "turn_summary", "evidence"}
    context = ev.where("top_type = 'turn_context'").first().event_id
    assert all(context not in c.evidence_event_ids for c in chunks)
    short = summary.build_chunks(se, ev, 2, 300).groupBy("session_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("m")).collect()
    assert all(r.n <= 2 and r.m <= 315 for r in short)
    with pytest.raises(ValueError):
        summary.build_chunks(se, ev, 0)


def test_replacement(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "session_id string, event_id int")
    new = spark.createDataFrame([("a", 9)], "session_id string, event_id int")
    assert rows(ingest.replace_sessions(old, new), "session_id", "event_id") == [("a", 9), ("b", 3)]


def test_stream_import_equals_batch(spark, home, tmp_path, frames):
    target = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        stream_import(spark, home, target, str(tmp_path / "check")).awaitTermination()
    columns = ("session_id", "line_no", "top_type", "text_content", "turn_index")
    assert rows(ingest.read_archive(spark, target, "events"), *columns) == rows(frames["events"], *columns)


LOG = "raw_path string, raw_sha256 string, session_id string, status string, imported_at timestamp, parse_version int"


def test_sync_imports_once(spark, home, tmp_path):
    log, pending = ingest.sync(spark, home, str(tmp_path / "archive"), spark.createDataFrame([], LOG), 8)
    assert rows(log, "status") == [("imported",)] * 4 and pending.count() == 0
    assert ingest.files_to_import(T.file_digests(spark, home), log, 8).count() == 0
    assert ingest.files_to_import(T.file_digests(spark, home), log, 9).count() == 4


def put_sessions(root, names, text="hello", folder="sessions"):
    for name in names:
        path = root / folder / f"{name}.jsonl"
        path.parent.mkdir(parents=True, exist_ok=True)
        lines = [record("session_meta", "2026-02-01T10:00:00Z", id=f"id-{name}"), record("turn_context", "2026-02-01T10:00:01Z", model=f"m-{name}", effort="low"), record("event_msg", "2026-02-01T10:00:02Z", type="user_message", message=f"{text} {name}")]
        path.write_text("\n".join(map(json.dumps, lines)) + "\n", encoding="utf-8")


CONTENT = {"sessions": ("session_id", "event_count", "first_seen_at"), "turns": ("session_id", "turn_index", "event_count", "model", "effort", "approval_policy"), "events": ("session_id", "line_no", "top_type", "text_content", "index_policy"), "warnings": ("session_id", "line_no", "code")}


def content(spark, target):
    return {name: rows(ingest.read_archive(spark, target, name), *columns) for name, columns in CONTENT.items()}


@pytest.mark.parametrize("stream", [False, True])
def test_imports_one_after_the_other_equal_one_of_all(spark, tmp_path, stream):
    root, target = tmp_path / "home", str(tmp_path / "archive")
    log = spark.createDataFrame([], LOG)
    for names in (["a b", "c+d", "e%20f", *range(6)], range(6, 10)):
        put_sessions(root, names)
        (root / "sessions" / "broken.jsonl").write_text("{not json\n")
        if stream:
            stream_import(spark, str(root), target, str(tmp_path / "check"), 50).awaitTermination()
        else:
            log, pending = ingest.sync(spark, str(root), target, log, 8)
            log = spark.createDataFrame(log.collect(), LOG)
            assert [r.path.rpartition("/")[2] for r in pending.collect()] == ["broken.jsonl"]
    if not stream:
        assert {(r.raw_path.rpartition("/")[2], r.status) for r in log.collect() if "broken" in r.raw_path or " " in r.raw_path or "%" in r.raw_path} == {("broken.jsonl", "failed"), ("a b.jsonl", "imported"), ("e%20f.jsonl", "imported")}
        put_sessions(root, [3], "changed")  # read again, in place of what there was
        time.sleep(1.1)
        put_sessions(root, [3], "changed")
        log, pending = ingest.sync(spark, str(root), target, log, 8)
        assert pending.count() == 1 and log.where("raw_path like '%/3.jsonl'").count() == 2
    one = str(tmp_path / "one")
    ingest.sync(spark, str(root), one, spark.createDataFrame([], LOG), 8)
    got = content(spark, target)
    assert got == content(spark, one)
    assert len(got["events"]) == 13 * 3 and ("id-a b", 0, 3, "m-a b", "low", None) in got["turns"]
    ids = [r.event_id for r in ingest.read_archive(spark, target, "events").collect()]
    assert len(set(ids)) == len(ids) == 39


def test_only_pending_files_are_read(spark, tmp_path):
    put_sessions(tmp_path, ["a b", "c", "d"])
    uris = [r.uri for r in T.inventory(spark, str(tmp_path)).where("path like '%a b.jsonl'").collect()]
    lines = T.scan_lines(spark, str(tmp_path), uris)
    assert {r.path.rpartition("/")[2] for r in lines.collect()} == {"a b.jsonl"}
    scan = lines._jdf.queryExecution().executedPlan().toString()
    assert "file_path" in scan and uris[0] in scan


def test_the_last_file_of_a_session_has_it(spark, tmp_path):
    put_sessions(tmp_path, ["x"], "old")
    put_sessions(tmp_path, ["x"], "new", "archived_sessions")
    frames = ingest.import_lines(T.scan_lines(spark, str(tmp_path)))
    assert rows(frames["sessions"], "session_id", "archived") == [("id-x", True)]
    assert [r.text_content for r in frames["events"].where("sub_type = 'user_message'").collect()] == ["new x"]


def test_settings_of_the_session_stay_as_they_were(spark, home):
    name = "spark.sql.variant.allowDuplicateKeys"
    before = [spark.conf.get(n) for n in (name, "spark.sql.files.ignoreCorruptFiles")]
    objects, _ = T.split_valid(spark.createDataFrame([("p", 1, '{"a": 1, "a": 2}')], "path string, line_no int, value string"))
    assert objects.select(F.expr("variant_get(rec, '$.a', 'int') a")).first().a == 2
    T.scan_lines(spark, home).count()
    assert [spark.conf.get(n) for n in (name, "spark.sql.files.ignoreCorruptFiles")] == before


def test_rebuild_takes_whole_payloads(spark):
    from quillmill.operators import blobs

    payload = json.dumps({"type": "function_call_output", "output": "y" * 3000})
    stored = blobs.blobs(spark.createDataFrame([(payload,)], "p string"), "p")
    ref = stored.first().blob_id
    ev = spark.createDataFrame([(1, "s", "response_item", "function_call_output", None, None, None, "cut", "{}", ref), (2, "s", "event_msg", "user_message", None, None, None, "hi", "{}", None)], "event_id long, session_id string, top_type string, sub_type string, role string, tool_name string, file_path string, text_content string, payload string, payload_ref string")
    new, checks = ingest.rebuild(ev, stored)
    assert {r.event_id: (r.index_policy, len(r.text_content)) for r in new.collect()} == {1: ("truncated", 2046), 2: ("full", 2)}
    assert all(r.equal for r in checks.collect())
    lost = new.withColumn("text_content", F.when(F.col("event_id") == 2, "ho").otherwise(F.col("text_content")))
    assert {r.table: r.equal for r in ingest.rebuild_checks(ev, ev, lost).collect()} == {"events": True, "digest": False}
    assert {r.table: r.equal for r in ingest.rebuild_checks(ev, ev, new.where("event_id = 1")).collect()} == {"events": False, "digest": False}


def test_lines_of_a_file_stay_in_one_part(spark, tmp_path):
    """Of a union, Spark 4.1 may leave out the shuffle by file and yet write a file's lines from several tasks."""
    from quillmill.plans.transcripts import FILES, _lines

    talk = spark.range(400).select(F.col("id").alias("conv_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("turn"), F.lit("user").alias("role"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    talk.repartition(6).write.parquet(f"{tmp_path}/conversations.parquet")
    small = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4k"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        lines = _lines(spark, str(tmp_path))
        lines.repartition("f").sortWithinPartitions("f", "line_no").select("f", "value").write.partitionBy("f").text(f"{tmp_path}/out")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    parts = {x.name: sorted(x.glob("part-*")) for x in (tmp_path / "out").glob("f=*")}
    assert len(parts) == FILES and all(len(x) == 1 for x in parts.values())
    assert all(x[0].read_text().startswith('{"type":"session_meta"') and len(x[0].read_text().splitlines()) == 31 for x in parts.values())
    # number, type and value of the lines are those of the SQL
    assert lines.dtypes == [("f", "bigint"), ("line_no", "int"), ("value", "string")]
    assert {(r.n, r.low, r.high) for r in lines.groupBy("f").agg(F.count("*").alias("n"), F.min("line_no").alias("low"), F.max("line_no").alias("high")).collect()} == {(31, 1, 31)}
