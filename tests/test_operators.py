"""Operators on small literal tables."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.operators import blobs, browse, export, history, ingest, policy, privacy, search, stats, vectors


def rows(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


def events(spark, data):
    return spark.createDataFrame(data, "event_id long, session_id string, top_type string, sub_type string, role string, tool_name string, file_path string, text_content string")


def test_index_policy(spark):
    got = policy.classify_index(events(spark, [(1, "s", "event_msg", "token_count", None, None, None, "x"), (2, "s", "response_item", "message", None, "shell", "a/b", "see data:image/png"), (3, "s", "response_item", "function_call_output", None, None, None, "y" * 2001), (4, "s", "event_msg", "user_message", None, None, None, "z" * 5001), (5, "s", "session_meta", None, None, None, None, "m"), (6, "s", "event_msg", "user_message", None, None, None, " \n ")]))
    r = {x.event_id: x for x in got.collect()}
    assert [r[k].index_policy for k in range(1, 7)] == ["skip_low_value", "metadata_only", "truncated", "truncated", "skip_low_value", "skip_empty"]
    assert r[2].indexed_text == "[binary or image evidence omitted from search index] type=response_item/message tool=shell file=a/b"
    assert "[... 1 chars omitted" in r[3].indexed_text and "[... 1001 chars omitted" in r[4].indexed_text


def test_dedupe_stays_within_a_session(spark):
    ev = events(spark, [(1, "a", "response_item", "message", "assistant", None, None, "same"), (2, "a", "event_msg", "agent_message", None, None, None, "same"), (3, "b", "event_msg", "agent_message", None, None, None, "same")])
    assert rows(policy.dedupe_bodies(ev), "event_id", "duplicate") == [(1, False), (2, True), (3, False)]


def test_queries_are_parsed():
    assert search.parse_query(" ")[0] == "blank"
    assert search.parse_query("alpha:beta") == ("phrase", ["alpha", "beta"], [])
    assert search.parse_query("parser.py)")[:2] == ("phrase", ["parser", "py"])
    assert search.parse_query("a OR b NOT c") == ("any", ["a", "b"], ["c"])


def test_search(spark):
    ev = events(spark, [(1, "s", "event_msg", "user_message", None, None, None, "alpha beta"), (2, "s", "event_msg", "user_message", None, None, None, "beta alpha alpha"), (3, "t", "event_msg", "user_message", None, "alpha", "alpha/beta.py", None)])
    ev = ev.withColumn("indexed_text", F.col("text_content"))
    index = search.postings(ev)
    assert rows(search.match_phrase(index, ["alpha", "beta"])) == [(1,), (3,)]
    assert rows(search.match_terms(index, ["alpha", "beta"], True, ["py"])) == [(1,), (2,)]
    se = spark.createDataFrame([("s", "p"), ("t", "q")], "session_id string, cwd string")
    assert [r.event_id for r in search.search(ev, index, se, "alpha:beta", cwd="q").collect()] == [3]
    hits = search.search(ev, index, se, "alpha", session_id="s")
    assert {r.event_id: r.snippet for r in search.snippets(hits, ev, ["alpha"]).collect()} == {1: "[alpha] beta", 2: "beta [alpha] [alpha]"}


def test_embedding_equals_the_loop(spark):
    text = "Fix src/app.py in Zürich, twice: Fix it"
    v = [0.0] * 64
    for token in re.findall(r"[\w.\-:/\\]+", text.lower()):
        h = hashlib.sha256(token.encode()).digest()
        v[int.from_bytes(h[:4], "big") % 64] += 1 if h[4] % 2 == 0 else -1
    norm = math.sqrt(sum(x * x for x in v))
    got = {r.id: r.vector for r in vectors.embed(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string"), "id", "text").collect()}
    assert got[1] == pytest.approx([x / norm for x in v]) and got[2] == got[3] == [0.0] * 64


def test_vector_table(spark):
    schema = "chunk_id string, session_id string, adapter string, dimensions int"
    old = spark.createDataFrame([("1", "a", "h", 64), ("2", "b", "h", 64), ("3", "a", "h", 32)], schema)
    new = spark.createDataFrame([("9", "a", "h", 64)], schema)
    assert rows(vectors.replace_chunks(old, new), "chunk_id") == [("2",), ("3",), ("9",)]


def test_hybrid_orders_and_degrades(spark):
    text = spark.createDataFrame([(1, -3.0, "see a.py", "p"), (2, -1.0, "other", "q")], "id int, rank double, text string, project string")
    alone = vectors.hybrid_rank(text, None, "a.py", "p").collect()
    assert [r.id for r in alone] == ["fts:2", "fts:1"] and alone[1].exact_hint == alone[1].same_project == 1.0
    assert [r.id for r in vectors.hybrid_rank(text, None, "a.py", "p", text_score="monotone").collect()] == ["fts:1", "fts:2"]
    near = spark.createDataFrame([("c", 0.9, "t", None)], "id string, score double, text string, project string")
    assert vectors.hybrid_rank(text, near, "x").count() == 3


def test_stored_index_answers_as_postings_do(spark, tmp_path):
    import random

    rng = random.Random(2)
    ev = events(spark, [(k, "s", "event_msg", "user_message", None, rng.choice([None, "tool one"]), "a/b.py" if k % 7 == 0 else None, " ".join(rng.choices(["alpha", "beta", "gamma", "Zürich", "x1"], k=rng.randrange(0, 30)))) for k in range(200)])
    ev = ev.withColumn("indexed_text", F.col("text_content")).repartition(3)
    index = search.postings(ev)
    by = {}
    for r in ev.collect():
        for field in ("tool_name", "file_path", "indexed_text"):
            for pos, w in enumerate(re.findall(r"[^\W_]+", (r[field] or "").lower())):
                by.setdefault((w, r.event_id, field), []).append(pos)
    lengths = {}
    for (_, i, _), at in by.items():
        lengths[i] = lengths.get(i, 0) + len(at)
    assert rows(index) == sorted(((*k, len(at), at, lengths[k[1]]) for k, at in by.items()), key=repr)
    search.write_index(ev, str(tmp_path / "index"), buckets=16)
    stored = search.StoredIndex(spark, str(tmp_path / "index"))
    for ask in (lambda i: search.match_terms(i, ["alpha", "tool"]), lambda i: search.match_terms(i, ["beta"], False, ["py"]), lambda i: search.match_phrase(i, ["alpha", "beta"]), lambda i: search.bm25(i, ["gamma", "zürich"])):
        assert rows(ask(index)) == rows(ask(stored)) != []
    plan = stored.of(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "In(term" in plan or "EqualTo(term" in plan
    read = stored.of(["alpha"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert all("bucket=" in r.f for r in read) and len({r.f.split("bucket=")[1].split("/")[0] for r in read}) == 1
    se = spark.createDataFrame([("s", "p")], "session_id string, cwd string")
    hits = browse.overview_hits(se, ev, stored, "alpha beta", 5, cwd="p").collect()
    assert [r.event_id for r in hits] == [r.event_id for r in search.search(ev, index, se, "alpha beta", 5).collect()] and {r.cwd for r in hits} == {"p"}
    assert stats.index_status(ev, stored.postings).first().indexed == len(lengths)
    assert stats.diagnostics(spark, "postings", "bm25", {"cwd": "p", "tool": None}, search.bm25(stored, ["alpha"])).first().filters == "cwd"


def test_agent_modes(spark):
    near = spark.createDataFrame([("c1", 0.5), ("c2", 0.9)], "chunk_id string, score double")
    assert [tuple(r) for r in vectors.agent_rank(near, 1, "vector").collect()] == [("vector:chunk:c2", None, 0.9)]
    both = spark.createDataFrame([("fts:7", "fts", 0.8), ("vector:c1", "vector", 0.9)], "id string, source string, score double")
    assert [tuple(r) for r in vectors.agent_rank(both, 5, "hybrid").collect()] == [("vector:chunk:c1", None, 0.9), ("fts:event:7", 7, 0.8)]
    text = spark.createDataFrame([(k, float(k)) for k in range(30)], "event_id long, score double")
    assert [r.event_id for r in vectors.agent_rank(text, 3).collect()] == [29, 28, 27]
    with pytest.raises(ValueError):
        vectors.agent_rank(text, mode="none")


TEXT = 'key sk_ABCDEFGHIJKLMNOP1234 and token = "sk_ABCDEFGHIJKLMNOP1234" mail a.b@example.org in /home/me/x and C:\\Users\\me -----BEGIN RSA PRIVATE KEY-----'


def test_privacy(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "nothing"), (3, None)], "id int, text string")
    found = privacy.scan(docs, "id", "text")
    assert rows(found, "kind") == sorted([("private_key",), ("api_key",), ("api_key",), ("token_assignment",), ("email",), ("windows_abs_path",), ("posix_abs_path",)], key=repr)
    spans = privacy.match_offsets(docs, "id", "text")
    assert {TEXT[r.start : r.end] for r in spans.collect()} == {r.match for r in found.collect()}
    redacted = docs.select(privacy.redacted(F.col("text")).alias("t")).first().t
    assert "sk_ABC" not in redacted and "example.org" not in redacted and "[REDACTED:api_key]" in redacted
    by_span = {r.id: r.text for r in privacy.redact_spans(docs, spans, "id", "text").collect()}
    assert "sk_ABC" not in by_span[1] and "example.org" not in by_span[1] and by_span[1].startswith("key [REDACTED:api_key] and [REDACTED:")
    assert by_span[2] == "nothing" and by_span[3] is None


HARD = ["password\u00a0= hunter2hunter2", "token\x0b=abcdefgh12", "secret\u3000:\u2003'x\u00e9yzabcd1'", "é.a@b.co and xé@b.co a.b+c@d-e.org.", ".x@y.zz", "apiſecret: 12345678", "PASSWORD=12345678 toKen=\u212aeyvalue99", "ésk_ABCDEFGHIJKLMNOP1 sk_ABCDEFGHIJKLMNOPé sk_ABCDEFGHIJKLMNOP12-é", "é/home/a /home/b\u00a0c x/tmp/d", "éC:\\a\\b C:\\Users\\mé\\x", "a\x1cpassword\x1f:\x1epppppppp\x1cq"]


def test_detectors_equal_python(spark):
    """Spark's spelling of the patterns finds what Python's re finds, beyond ASCII too."""
    import random

    from quillmill.functions import constants as C

    rng = random.Random(5)
    parts = ["sk_", "A" * 16, "é", "_", "-", "\u00a0", "\x0b", "\x1f", " ", "token", "Password", "=", ":", "'", '"', "a@b.co", ".", "@", "x.y", "/home/", "/tmp/", "C:\\", "\\", "-----BEGIN RSA PRIVATE KEY-----", "12345678", "\u2028", "ſecret", "\u212a", "日本"]
    texts = HARD + ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = sorted((i, kind, n, m[0]) for i, t in enumerate(texts) for kind, _, p in C.DETECTORS for n, m in enumerate(re.finditer(p, t)))
    assert rows(privacy.scan(docs, "id", "text"), "id", "kind", "n", "match") == sorted(want, key=repr)
    assert rows(privacy.match_offsets(docs, "id", "text"), "id", "kind", "n", "match") == sorted(want, key=repr)
    assert {r.id for r in privacy.scan(docs.where("id < 2"), "id", "text").collect()} == {0, 1}


def test_rules_keep_matches_from_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a@ok.org and b@no.org"), (2, "token = abcdefghij"), (3, None)], "id int, text string")
    rules = spark.createDataFrame([("email", None, "@ok"), (None, "token = abcdefghij", None)], "kind string, text string, pattern string")
    want = {1: "mail a@ok.org and [REDACTED:email]", 2: "token = abcdefghij", 3: None}
    assert {r.id: r.text for r in privacy.redact(docs, "id", "text", rules).collect()} == want
    found = privacy.allowlisted(privacy.scan(docs, "id", "text"), rules)
    assert {r.id: r.text for r in privacy.gate(docs, found, "id", "text", "redact")[0].collect()} == want
    assert {r.id: r.text for r in privacy.redact(docs, "id", "text").collect()} == {1: "mail [REDACTED:email] and [REDACTED:email]", 2: "[REDACTED:token_assignment]", 3: None}
    total = {(r.severity, r.kind): (r["count"], r.allowlisted_count) for r in privacy.privacy_summary(found).collect()}
    assert total[None, None] == (1, 2) and total["medium", "email"] == (1, 1) and total["high", None] == (0, 1)


def test_redaction_equals_a_plain_version_where_matches_overlap(spark):
    """Both ways, and every pair of detectors, against marked characters."""
    import random

    from quillmill.functions import constants as C

    rng = random.Random(6)
    parts = ["sk_" + "A" * 16, "token=", "secret: ", "x@y.com", "@y.org", "/home/", "/tmp/a", "C:\\", "\\b", "-----BEGIN RSA PRIVATE KEY-----", "12345678", " ", ".", "'", "é", "plan"]
    texts = ["C:\\Users\\x@y.com\\secret\\plan", "/home/x@y.com/secret", "api_key=sk_ABCDEFGHIJKLMNOP12", *("".join(rng.choices(parts, k=rng.randrange(2, 12))) for _ in range(800))]

    def plain(text):
        rank = {"critical": 0, "high": 1, "medium": 2, "low": 3}
        found = [(m.start(), m.end(), rank[sev], kind) for kind, sev, p in C.DETECTORS for m in re.finditer(p, text)]
        joint = [[x] for x in sorted(found)]
        merged = []
        for x in joint:
            if merged and x[0][0] < max(y[1] for y in merged[-1]):
                merged[-1] += x
            else:
                merged.append(x)
        for group in reversed(merged):
            name = min((r, a - b, kind) for a, b, r, kind in group)[2]
            text = f"{text[: group[0][0]]}[REDACTED:{name}]{text[max(y[1] for y in group) :]}"
        return text

    pairs = {tuple(sorted({k for k, s, e in f if s < e2 and s2 < e} | {k2})) for t in texts for f in [[(kind, *m.span()) for kind, _, p in C.DETECTORS for m in re.finditer(p, t)]] for k2, s2, e2 in f}
    assert sum(len(p) > 1 for p in pairs) >= 8
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {i: plain(t) for i, t in enumerate(texts)}
    assert want[0] == "[REDACTED:email]" and want[1] == "[REDACTED:email]" and want[2].startswith("[REDACTED:api_key]")
    no_rules = spark.createDataFrame([], "kind string, text string, pattern string")
    found = privacy.scan(docs, "id", "text")
    for got in (privacy.redact(docs, "id", "text"), privacy.redact(docs, "id", "text", no_rules), privacy.redact_spans(docs, privacy.match_offsets(docs, "id", "text"), "id", "text"), privacy.gate(docs, found, "id", "text", "redact")[0], privacy.gate(docs, privacy.allowlisted(found, no_rules), "id", "text", "redact")[0]):
        assert {r.id: r.text for r in got.collect()} == want
    plan = privacy.redact(docs, "id", "text", no_rules)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_gate_and_allowlist(spark):
    docs = spark.createDataFrame([(1, 'password = "longsecret"'), (2, "ok a@b.org")], "id int, text string")
    found = privacy.scan(docs, "id", "text")
    assert rows(privacy.gate(docs, found, "id", "text", "fail")[1]) == [(1,)]
    rules = spark.createDataFrame([("token_assignment", None, "longsecret")], "kind string, text string, pattern string")
    assert privacy.gate(docs, privacy.allowlisted(found, rules), "id", "text", "fail")[0].count() == 2
    assert privacy.gate(docs, found, "id", "text", "redact")[0].where("text like '%REDACTED%'").count() == 2


def test_blobs(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "content string")
    stored = blobs.blobs(df, "content")
    assert stored.count() == 2 and blobs.blobs(df, "content", stored).count() == 0
    ref = hashlib.sha256(b"x").hexdigest()
    refs = blobs.referenced(spark.createDataFrame([(None, '{"image_ref":"%s"}' % ref), ("0" * 64, "{}")], "payload_ref string, payload string"))
    assert rows(refs) == sorted([(ref,), ("0" * 64,)])
    assert rows(blobs.verify_blobs(refs, stored)) == [("0" * 64, "missing_blob")]
    broken = stored.withColumn("content", F.when(F.col("content") == "x", "z").otherwise(F.col("content")))
    assert rows(blobs.verify_blobs(refs.where(F.col("blob_id") == ref), broken)) == [(ref, "hash_mismatch")]
    assert rows(blobs.unreferenced_blobs(stored, refs), "content") == [("y",)]


def test_slim_and_assets(spark):
    import base64
    import json

    image = base64.b64encode(b"png bytes").decode()
    payload = json.dumps({"type": "message", "short": "s", "long": "l" * 300, "content": [{"type": "input_image", "image_url": f"data:image/png;base64,{image}"}, {"type": "input_image", "image_url": "data:image/png;base64,***"}]})
    ev = spark.createDataFrame([(1, payload)], "event_id long, payload string")
    slim = json.loads(blobs.slim_payload(ev).first().slim)
    assert slim["short"] == "s" and "long" not in slim
    ref = hashlib.sha256(b"png bytes").hexdigest()
    assert slim["content"][0] == {"type": "input_image", "asset_ref": ref, "media_type": "image/png", "bytes": 9}
    assert slim["content"][1] == {"type": "input_image", "image_url": "data:image/png;base64,***"}
    assets = blobs.extract_assets(ev).collect()
    assert [(a.part, a.media_type, bytes(a.content)) for a in assets] == [(0, "image/png", b"png bytes")]


def test_slim_calls_and_messages(spark):
    import json

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    call = {"type": "function_call", "name": "n" * 300, "call_id": "c", "status": "done", "arguments": "a" * 300, "note": "x" * 257, "n": 1, "f": 1.5, "ok": True, "none": None, "deep": {"a": 1}}
    message = {"type": "message", "role": "user", "content": [{"type": "t", "text": "héllo"}, "bare", 3, {"type": "other", "k": 1, "long": "l" * 300, "deep": [1]}, {"text": "x"}]}
    ev = spark.createDataFrame([(1, json.dumps(call)), (2, json.dumps(message)), (3, "[1]"), (4, None), (5, json.dumps({"type": "function_call", "arguments": "short"}))], "event_id long, payload string")
    got = {r.event_id: json.loads(r.slim) if r.slim else None for r in blobs.slim_payload(ev).collect()}
    assert got[1] == {k: call[k] for k in ("type", "name", "call_id", "status", "n", "f", "ok", "none")} | {"arguments_chars": 300, "arguments_sha256": sha("a" * 300)}
    assert got[2]["role"] == "user" and got[2]["content"] == [{"type": "t", "chars": 5, "sha256": sha("héllo")}, {"type": "str"}, {"type": "int"}, {"type": "other", "k": 1}, {"type": "unknown", "chars": 1, "sha256": sha("x")}]
    assert got[3] is None and got[4] is None and got[5] == {"type": "function_call", "arguments": "short", "arguments_chars": 5, "arguments_sha256": sha("short")}


def test_references_are_found_at_any_depth(spark):
    ids = [c * 64 for c in "abcdef"]
    payloads = ['{"image_ref": "%s"}' % ids[0], '{"x" : [{"y": {"cold_ref"  :\n "%s"}}]}' % ids[1], '{"a\\u005fref":"%s"}' % ids[2], '{"text": "\\"fake_ref\\": \\"%s\\""}' % ids[3], 'no json "b_ref": "%s"' % ids[4], '{"ref": "%s"}' % ids[5]]
    refs = blobs.referenced(spark.createDataFrame([(None, p) for p in payloads], "payload_ref string, payload string"))
    assert rows(refs) == [(i,) for i in (*ids[:3], ids[4])]


def test_references_stand_beside_long_strings(spark):
    """Strings of any length, whatever their escapes: the stack holds, and the work is in proportion to them."""
    import json

    ids = [c * 64 for c in "abcde"]
    texts = ["x" * 1_000_000, '"' * 200_000 + "\\" * 200_000, '{"fake_ref": "%s"} ' % ids[4] * 5000]
    payloads = [json.dumps({"message": text, "cold_ref": ids[k]}) for k, text in enumerate(texts)]
    payloads.append('no json "%s", "a%s\\n_ref": "%s"' % (texts[0], texts[0], ids[3]))
    refs = blobs.referenced(spark.createDataFrame([(None, p) for p in payloads], "payload_ref string, payload string"))
    assert rows(refs) == [(i,) for i in ids[:4]]


def test_orphans_and_detail(spark):
    inventory = spark.createDataFrame([("a",), ("b",)], "path string")
    assert rows(blobs.orphan_files(inventory, spark.createDataFrame([("a",)], "path string"))) == [("b",)]
    stored = blobs.blobs(spark.createDataFrame([('{"output": "whole"}',)], "p string"), "p")
    ev = spark.createDataFrame([(1, "cut", "{}", stored.first().blob_id), (2, "x", "{}", None)], "event_id long, text_content string, payload string, payload_ref string")
    got = blobs.event_detail(ev, stored, 1).collect()
    assert [(r.text_content, r.payload) for r in got] == [("whole", '{"output": "whole"}')]


def test_manifest(spark):
    man = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, "x")], "path string, bytes int, sha256 string")
    files = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 1, "y")], "path string, bytes int, sha256 string")
    assert rows(blobs.verify_manifest(man, files)) == [("b", "size_mismatch"), ("c", "hash_mismatch"), ("d", "missing")]


def test_audits(spark):
    samples = spark.createDataFrame([("a", 3, 1, {"current": 3}, {"x": 1}), ("b", 0, 0, {}, {})], "path string, events long, warnings long, classifications map<string,long>, warning_codes map<string,long>")
    audit = stats.corpus_audit(samples).first()
    assert (audit.files, audit.parseable_files, audit.parseable_ratio, audit.classifications, audit.warning_codes) == (2, 1, 0.5, {"current": 3}, {"x": 1})
    reports = spark.createDataFrame([("2026-01-01", 1, 5, 0), ("2026-01-02", 2, 9, 2)], "generated_at string, files long, events long, warnings long")
    last = stats.audit_history(reports).first()
    assert (last.delta_files, last.delta_warnings, last.status) == (1, 2, "ok")
    assert stats.audit_history(reports.limit(1)).first().status == "not_enough_reports"


def test_retention_and_due(spark):
    snaps = spark.createDataFrame([(f"2026-01-0{k}", k) for k in range(1, 6)], "t string, id int")
    assert rows(history.keep_latest(snaps, 3, "t", "id").where("keep"), "id") == [(3,), (4,), (5,)]
    with pytest.raises(ValueError):
        history.keep_latest(snaps, 0, "t", "id")
    state = "struct<sessions:int,events:int,warnings:int,updated_at:string,blobs:int,original_bytes:int,source:string>"
    base, moved = (1, 1, 0, "u", 1, 1, "s"), (1, 2, 0, "v", 1, 1, "s")
    past = spark.createDataFrame([("a", "evidence", "2026-01-01", 1, base)], f"archive string, profile string, generated_at string, tie int, state {state}")
    for days, now, want in ((2, base, "fresh_or_unchanged"), (2, moved, "daily_core_due"), (8, moved, "weekly_evidence_due"), (31, moved, "monthly_forensic_due")):
        cur = spark.createDataFrame([("a", now), ("b", now)], f"archive string, now {state}")
        got = dict(rows(history.due_tier(past, cur, "archive", F.date_add(F.lit("2026-01-01"), days)), "archive", "reason"))
        assert got == {"a": want, "b": "bootstrap_evidence"}


def test_latest_of_repeated_ids(spark):
    snaps = spark.createDataFrame([("t1", 7), ("t1", 7), ("t2", 7), ("t3", 8), (None, None), (None, None)], "t string, id int").withColumn("more", F.lit(1))
    for n in range(1, 8):
        kept = history.keep_latest(snaps, n, "t", "id")
        assert kept.count() == 6 and kept.where("keep").count() == min(n, 6)
    assert rows(history.keep_latest(snaps, 2, "t", "id").where("keep"), "t", "id") == [("t2", 7), ("t3", 8)]


def test_fingerprint_and_regressions(spark):
    one = spark.createDataFrame([("u",)], "updated_at string")
    blob = spark.createDataFrame([(5,)], "original_bytes long")
    source = spark.createDataFrame([(10, "m1"), (20, "m2")], "bytes long, mtime string")
    got = history.fingerprint(one, one, one, blob, source).first()
    assert (got.sessions, got.blobs, tuple(got.source)) == (1, 1, (2, 30, "m2"))
    audit = "files long, events long, warnings long, parseable_ratio double"
    codes = lambda x: spark.createDataFrame(x, "key string, count long")
    row = stats.audit_regressions(spark.createDataFrame([(1, 5, 1, 1.0)], audit), spark.createDataFrame([(3, 9, 4, 0.5)], audit), codes([("a", 1)]), codes([("a", 2), ("b", 1), ("c", 1)])).first()
    assert tuple(row) == (2, 4, 3, -0.5, True, True, ["b", "c"])


def test_coverage_by_group(spark):
    from quillmill.operators import summary

    items = spark.createDataFrame([("s", "files", 1), ("s", "files", None), ("s", "key_steps", 2)], "session_id string, group string, event_id long")
    got = {r.session_id: r for r in summary.coverage_by_group(spark.createDataFrame([("s",), ("t",)], "session_id string"), items).collect()}
    assert (got["s"].total, got["s"].with_evidence, got["s"].missing) == (3, 2, ["files has 1 item(s) without evidence."])
    assert [tuple(g) for g in got["s"].by_group] == [("files", 2, 1), ("key_steps", 1, 1)]
    assert (got["t"].total, got["t"].ratio, got["t"].by_group, got["t"].missing) == (0, 1.0, [], [])


def test_small_parts(spark, tmp_path):
    from quillmill.operators import normalize, summary
    from quillmill.sources import transcripts

    ev = events(spark, [(1, "s", "response_item", "function_call", None, "sh", None, "sh x"), (2, "t", "event_msg", "user_message", None, None, None, "an Error here in src/a.py")]).withColumn("storage_class", F.lit("core")).withColumn("path", F.col("session_id")).withColumn("shape", F.lit("current"))
    commands = summary.key_commands(ev.withColumn("payload", F.lit('{"name": "sh", "arguments": "ls  -l"}'))).collect()
    assert [(r.session_id, r.place, r.command, r.tool) for r in commands] == [("s", 1, "ls -l", "sh")]
    assert rows(summary.problem_events(ev), "event_id") == [(2,)]
    assert rows(summary.files_mentioned(ev), "path", "event_id") == [("an Error here in src/a.py", 2)]
    assert rows(stats.storage_classes(ev, "text_content")) == [("core", 2, 29)]
    assert rows(browse.get_events(ev, spark.createDataFrame([("t",)], "session_id string")), "event_id") == [(2,)]
    state = spark.createDataFrame([("s", " # A  title"), ("t", "")], "session_id string, title string")
    se = spark.createDataFrame([("s", "/x/p"), ("t", "/x/q/"), ("u", None)], "session_id string, cwd string")
    assert rows(browse.session_titles(se, state), "session_id", "title") == [("s", "A title"), ("t", "q"), ("u", "no project")]
    wa = spark.createDataFrame([("s", 4, "x", "p1"), ("t", 2, "y", "p2")], "session_id string, line_no int, code string, raw_path string")
    assert rows(browse.list_warnings(wa, session_id="s"), "code") == [("x",)] and rows(browse.list_warnings(wa, code="y", path="p2"), "line_no") == [(2,)]
    assert browse.list_warnings(wa, path="none").count() == 0
    samples = {r.path: r for r in normalize.sample_files(ev, wa.withColumnRenamed("raw_path", "x").withColumn("path", F.col("session_id"))).collect()}
    assert (samples["s"].events, samples["s"].warnings, samples["s"].classifications, samples["s"].warning_codes) == (1, 1, {"current": 1}, {"x": 1})
    (tmp_path / "log").write_text('{"a": 2}\nnot\n\n{"a": 1}\n')
    records, bad = transcripts.read_history(spark, str(tmp_path / "log"), "a int")
    assert rows(records) == [(1,), (2,)] and rows(bad) == [("not",)]
    chunks = spark.createDataFrame([("h", 64, "s"), ("h", 64, "t"), ("h", 32, "s")], "adapter string, dimensions int, session_id string")
    assert rows(vectors.vector_status(chunks)) == [("h", 32, 1, 1), ("h", 64, 2, 2)]
    docs = spark.createDataFrame([("a/x.md", "one"), ("b/y.md", "two")], "name string, text string")
    export.write_documents(docs, str(tmp_path / "docs"))
    assert rows(spark.read.json(str(tmp_path / "docs")), "folder", "name", "text") == [("a", "a/x.md", "one"), ("b", "b/y.md", "two")]


def test_last_turns(spark):
    ev = spark.createDataFrame([("s", k, k // 2) for k in range(10)] + [("t", 99, None), ("u", 5, 0)], "session_id string, event_id int, turn_index int")
    assert rows(browse.last_turns(ev, 2), "event_id") == [(5,), (6,), (7,), (8,), (9,)]


def test_streams(spark, tmp_path):
    """Pairs and requests live: what comes in three files, one a batch, and a late one that moves the watermark."""
    import datetime
    import json
    import os

    from quillmill.streaming import ingest as live

    def put(folder, name, records):
        path = tmp_path / folder / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("\n".join(map(json.dumps, records)))
        os.utime(path, (1_800_000_000 + int(name[0]), 1_800_000_000 + int(name[0])))  # files come in the order of their times

    at = lambda m: (datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=m)).isoformat()
    call = lambda cid, line, kind, m: {"path": "p", "call_id": cid, "line_no": line, "kind": kind, "ts": at(m)}
    put("calls", "1.json", [call("a", 1, "call", 0), call("b", 2, "call", 0), call("c", 3, "output", 0)])
    put("calls", "2.json", [call("a", 4, "output", 1), call("a", 5, "output", 1)])
    put("calls", "3.json", [call("z", 6, "call", 500)])
    put("calls", "4.json", [call("z", 7, "output", 501)])
    calls = spark.readStream.schema("path string, call_id string, line_no int, kind string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "calls"))
    live.stream_pairing(calls).writeStream.format("json").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start(str(tmp_path / "pairs")).awaitTermination()
    got = rows(spark.read.schema(live.OUT).json(str(tmp_path / "pairs")), "call_id", "line_no", "code")
    assert got == [("a", 5, "duplicate_function_call_output"), ("b", 2, "missing_function_call_output"), ("c", 3, "orphan_function_call_output")]
    ask = lambda i, home, reason: {"request_id": i, "source": "s", "home": home, "reason": reason, "created_at": at(i)}
    put("asks", "1.json", [ask(1, None, "r"), ask(2, None, "r"), ask(3, "h", "r")])
    put("asks", "2.json", [ask(4, None, "r"), ask(5, "h", "q")])
    asks = spark.readStream.schema("request_id int, source string, home string, reason string, created_at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "asks"))
    live.stream_requests(asks).writeStream.format("json").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start(str(tmp_path / "firsts")).awaitTermination()
    assert sorted(r.reason + (r.home or "") for r in spark.read.json(str(tmp_path / "firsts")).collect()) == ["qh", "r", "rh"]


def test_requests_are_active_until_they_end(spark, tmp_path):
    """In micro-batches, one a file: a repeat is dropped, one behind the end passes, an old one is over by its time."""
    import datetime
    import json
    import os

    from quillmill.streaming import ingest as live

    at = lambda m: (datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=m)).isoformat()
    row = lambda i, m, status="pending", home=None, source="s": {"request_id": i, "source": source, "home": home, "reason": "r", "status": status, "created_at": at(m)}
    batches = [
        [row(1, 0), row(2, 1), row(3, 0, home="h")],
        [row(4, 2, "processing"), row(1, 3, "completed"), row(3, 3, "failed", "h"), row(5, 4, home="h"), row(6, 5, home="h")],
        [row(7, 6), row(8, 7), row(2, 7, "completed")],  # the end of one that never was active ends nothing
        [row(9, 8), row(10, 3000, source="other")],  # moves the watermark
        [row(11, 3001), row(12, 3001, source="other")],
        [row(13, 3002), row(14, 3002, source="other")],
    ]
    (tmp_path / "asks").mkdir()
    for k, records in enumerate(batches):
        path = tmp_path / "asks" / f"{k}.json"
        path.write_text("\n".join(map(json.dumps, records)))
        os.utime(path, (1_800_000_000 + k, 1_800_000_000 + k))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    asks = spark.readStream.schema("request_id int, source string, home string, reason string, status string, created_at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "asks"))
    try:
        live.stream_requests(asks, "10 minutes", 86_400_000).writeStream.format("json").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = sorted(r.request_id for r in spark.read.json(str(tmp_path / "out")).collect())
    assert got[:4] == [1, 3, 5, 7] and 10 in got and 9 not in got and 12 not in got and 14 not in got
    assert len({11, 13} & set(got)) == 1  # request 7 is over by its time


def test_freshness(spark):
    inv = spark.createDataFrame([(p, False, 10) for p in "abcd"], "path string, archived boolean, bytes long").withColumn("mtime", F.to_timestamp(F.lit("2026-01-01 00:00:10")))
    log = spark.createDataFrame([("a", "imported", "2026-01-01 00:00:09", 8), ("b", "imported", "2026-01-01 00:00:01", 8), ("c", "imported", "2026-01-01 00:00:20", 7), ("d", "failed", "2026-01-01 00:00:20", 8)], "raw_path string, status string, t string, parse_version int").withColumn("imported_at", F.to_timestamp("t"))
    plan = ingest.freshness(inv, log, 8)
    assert rows(plan, "path", "reason") == [("a", None), ("b", "modified_after_import"), ("c", "parser_version_changed"), ("d", "not_imported")]
    assert rows(ingest.freshness_summary(plan), "reason", "bytes") == [("modified_after_import", 10), ("not_imported", 10), ("parser_version_changed", 10)]


def test_requests(spark):
    rq = spark.createDataFrame([(1, "s", None, "r", "pending", 1), (2, "s", None, "r", "pending", 2), (3, "s", None, "r", "failed", 0)], "request_id int, source string, home string, reason string, status string, created_at int")
    assert rows(ingest.dedupe_requests(rq), "request_id") == [(1,), (3,)]
    with pytest.raises(ValueError):
        ingest.queue_list(rq, "lost")
    with pytest.raises(ValueError):
        ingest.queue_list(rq, limit=501)


def test_exports(spark, tmp_path):
    ev = events(spark, [(1, "s/1", "event_msg", "user_message", "user", None, None, 'a "quoted"\nline'), (2, "s/1", "response_item", "message", "assistant", None, None, "b")])
    ev = ev.withColumn("turn_index", F.lit(0)).withColumn("timestamp", F.lit("t"))
    se = spark.createDataFrame([("s/1", "p", "f", "u")], "session_id string, cwd string, first_seen_at string, updated_at string")
    export.export_csv(ev, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == export.CSV_COLUMNS and sorted(r.text_content for r in back.collect()) == ['a "quoted"\nline', "b"]
    export.export_jsonl(ev, str(tmp_path / "jsonl"))
    assert spark.read.json(str(tmp_path / "jsonl")).count() == 2
    assert export.export_json(se, ev).count() == 1
    page = export.render_markdown(se, ev).first()
    assert page.name == "s-1.md" and page.text.index("Event 1") < page.text.index("Event 2")
    vault = {r["name"]: r.text for r in export.render_vault(se, ev).collect()}
    assert set(vault) == {"sessions/s-1.md", "evidence/s-1-evidence.md", "index/p.md"} and "[[s-1-evidence]]" in vault["sessions/s-1.md"]
    assert export.render_packet(se, ev).count() == 3
    assert rows(export.events_by_id(ev, [2, 1]), "place", "event_id") == [(0, 2), (1, 1)]


def test_large_projects_have_several_index_pages(spark):
    se = spark.createDataFrame([(f"s{k}", "p" if k else None, None, None) for k in range(1300)], "session_id string, cwd string, first_seen_at string, updated_at string")
    ev = events(spark, [(k, "s1", "event_msg", "user_message", "user", None, None, "w" * 600) for k in range(40)]).withColumn("turn_index", F.lit(0))
    vault = {r["name"]: r.text for r in export.render_vault(se, ev).collect()}
    pages = [x for x in vault if x.startswith("index/p")]
    assert sorted(pages) == ["index/p-1.md", "index/p-2.md", "index/p-3.md"] and sum(vault[x].count("[[") for x in pages) == 1299
    assert vault["index/none.md"].count("[[") == 1
    proof = vault["evidence/s1-evidence.md"].split("\n\n", 2)[2]
    assert len(proof) == 4000 and proof.startswith("- Event 0: www") and "- Event 6: w" in proof


def test_titles(spark):
    data = [("  # Fix  it # ",), ("x://threads/1",), ("01234567-89ab-cdef-0123-456789abcdef",), ("w" * 60,), (None,)]
    got = [r.t for r in spark.createDataFrame(data, "v string").select(browse.friendly_title(F.col("v")).alias("t")).collect()]
    assert got == ["Fix it", "", "", "w" * 57 + "…", ""]


def test_paths_are_hidden(spark):
    df = spark.createDataFrame([("/home/me", "posix_abs_path", "/home/me/x")], "raw_path string, kind string, excerpt string")
    assert browse.hide_paths(df).first().asDict() == {"kind": "posix_abs_path", "excerpt": None}
    assert df.select(privacy.hide_known_paths(F.lit("a C:\\x\\y b C:/x/y"), ["C:\\x", "C:\\x\\y"]).alias("t")).first().t == "a [path] b [path]"


def test_rows_that_are_no_candidates_are_not_dealt_by_session(spark):
    """Most rows of a session have no body to look up; they must not meet in one task, and lose nothing."""
    kind = F.when(F.col("id") % 4 == 0, "agent_message").when(F.col("id") % 4 == 1, "message").otherwise("user_message")
    text = F.when(F.col("id") % 8 < 2, F.lit("same")).when(F.col("id") % 8 > 5, F.lit(None)).otherwise(F.col("id").cast("string"))
    ev = spark.range(4000).select(F.col("id").alias("event_id"), F.lit("s").alias("session_id"), F.when(F.col("id") % 4 == 1, "response_item").otherwise("event_msg").alias("top_type"), kind.alias("sub_type"), F.lit("assistant").alias("role"), text.alias("text_content"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        marked = policy.dedupe_bodies(ev)
        dealt = [r["count"] for r in marked.where("sub_type = 'user_message'").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(dealt) < 1000 and sum(dealt) == 2000
    rows = marked.collect()
    assert len(rows) == 4000 and all(r.duplicate == (r.event_id % 8 == 0) for r in rows)


def test_many_queries_are_asked_in_parts(spark, monkeypatch):
    """What is compared at once is bounded, and the answers are the same with the last part a short one."""
    assert vectors.SCORED * vectors.ASKED <= 1 << 20
    monkeypatch.setattr(vectors, "ASKED", 7)
    monkeypatch.setattr(vectors, "SCORED", 11)
    rng = np.random.default_rng(3)
    table = spark.createDataFrame([(k, [float(x) for x in rng.integers(-3, 4, 4)]) for k in range(120)], "vec_id long, embedding array<double>").repartition(3)
    queries = table.select(F.col("vec_id").alias("query_id"), "embedding")
    ask = lambda: sorted(tuple(r) for r in vectors.vector_topk_many(table, queries, "vec_id", "query_id", "embedding", 7).collect())
    whole = {r.vec_id: np.array(r.embedding) for r in table.collect()}
    want = []
    for q, e in whole.items():
        best = sorted(((-round(float(e @ x), 6), k) for k, x in whole.items() if e @ x > 0))[:7]
        want += [(q, n, k, -s) for n, (s, k) in enumerate(best, 1)]
    assert ask() == sorted(want)
