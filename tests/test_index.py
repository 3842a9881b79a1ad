"""An index that is kept up to date answers as one that is built at once."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillmill.functions.batches import pieces
from quillmill.operators import ingest, search
from quillmill.operators.archive import Archive
from quillmill.operators.index import SearchIndex, catch_up, index_gap, update_index

EVENTS = "session_id string, event_id long, tool_name string, file_path string, indexed_text string"


def events(spark, rng, names, first):
    words = "alpha beta gamma delta error file build test parser".split()
    rows = [(f"s{n}", first + 10 * k + j, rng.choice([None, "shell"]), rng.choice([None, "/a/parser.py"]), rng.choice([None, " ".join(rng.choices(words, k=rng.randrange(1, 12)))])) for k, n in enumerate(names) for j in range(10)]
    return spark.createDataFrame(rows, EVENTS)


def answers(index):
    out = {}
    for query in ("alpha beta", "parser.py", "error OR build", "alpha NOT gamma"):
        kind, wanted, unwanted = search.parse_query(query)
        found = search.match_phrase(index, wanted) if kind == "phrase" else search.match_terms(index, wanted, kind == "all", unwanted)
        out[query] = sorted(map(tuple, search.bm25(index, wanted).join(found, "event_id", "left_semi").collect()))
    return out


def test_updates_equal_one_build(spark, tmp_path):
    rng, path = random.Random(1), str(tmp_path / "index")
    parts = [events(spark, rng, range(20), 1), events(spark, rng, [3, 4, 20], 1000), events(spark, rng, [4, 21], 2000)]
    sizes = []
    for part in parts:
        update_index(part, path)
        sizes.append(Archive(spark, path).files.size(path))
    now = parts[0].where("session_id not in ('s3', 's4')").union(parts[1].where("session_id <> 's4'")).union(parts[2])
    update_index(now, str(tmp_path / "one"))
    index, one = SearchIndex(spark, path), SearchIndex(spark, str(tmp_path / "one"))
    assert answers(index) == answers(one) and len(answers(one)["alpha beta"]) > 5
    search.write_index(now, str(tmp_path / "whole"))
    assert answers(search.StoredIndex(spark, str(tmp_path / "whole"))) == answers(one)
    index.archive.compact()
    assert answers(SearchIndex(spark, path)) == answers(one)
    # what the postings of an update take is its own
    written = {s: x["tables"]["postings"]["bytes"] for s, x in Archive(spark, path, 3, ).manifest["segments"].items()}
    assert len(written) == 3 and min(written.values()) < max(written.values())
    assert index_gap(now, path).count() == 0


def test_an_index_that_misses_an_import_catches_up(spark, tmp_path):
    from test_transcripts import put_sessions

    root, target, path = tmp_path / "home", str(tmp_path / "archive"), str(tmp_path / "index")
    put_sessions(root, range(3))
    ingest.sync(spark, str(root), target, None, 1, index=path)
    put_sessions(root, range(3, 5))
    ingest.sync(spark, str(root), target, None, 1)  # cut off before the index
    rows = Archive(spark, target).read("events")
    assert sorted(r.session_id for r in index_gap(rows, path).collect()) == ["id-3", "id-4"]
    assert catch_up(rows, path) == 2 and catch_up(rows, path) == 0
    index = SearchIndex(spark, path)
    hits = search.search(rows, index, Archive(spark, target).read("sessions"), "hello").collect()
    assert {r.session_id for r in hits} == {f"id-{k}" for k in range(5)}
    assert index.totals.first().n == rows.where(F.col("indexed_text").isNotNull()).count()


def test_many_vector_queries_equal_single_ones(spark, tmp_path):
    from quillmill.operators import vectors

    rng = random.Random(3)
    data = [(f"c{k % 97:03d}-{k}", f"s{k % 9}", [float(rng.randrange(-4, 5)) for _ in range(6)]) for k in range(300)] + [("null", "s1", None), ("short", "s1", [1.0])]
    chunks = spark.createDataFrame(data, "chunk_id string, session_id string, vector array<double>")
    asked = spark.createDataFrame([(k, data[7 * k][2]) for k in range(12)] + [(99, None), (98, [0.0] * 6)], "q int, vector array<double>")
    got = sorted((r.q, r["rank"], r.chunk_id, r.score) for r in vectors.vector_topk_many(chunks, asked, "chunk_id", "q", "vector", 5).collect())
    want = []
    for k in range(12):
        best = sorted((-sum(a * b for a, b in zip(v, data[7 * k][2])), c) for c, _, v in data[:300])
        want += [(k, place + 1, c, -s) for place, (s, c) in enumerate(best[:5]) if s < 0]
    assert got == want
    plan = vectors.vector_topk_many(chunks, asked, "chunk_id", "q", "vector", 5)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert vectors.vector_topk_many(chunks, asked.limit(0), "chunk_id", "q").count() == 0
    path = str(tmp_path / "vectors")
    good = chunks.where("size(vector) = 6")
    vectors.store_chunks(good, path, "hash")
    vectors.store_chunks(good.where("session_id = 's3'").limit(2), path, "hash")
    assert vectors.stored_chunks(spark, path, "hash", 6).groupBy("session_id").count().where("session_id = 's3'").first()["count"] == 2
    assert vectors.stored_chunks(spark, path, "hash", 6).count() == 300 - good.where("session_id = 's3'").count() + 2
    assert vectors.stored_chunks(spark, path, "other", 6) is None


def test_slim_payloads_stay_slim(spark):
    from quillmill.operators.hot import to_hot

    rows = [("response_item", "function_call", '{"type":"function_call","name":"x","call_id":"c","arguments":"short"}'), ("compacted", None, '{"message":"m","replacement_history":[1,2],"k":"v"}'), ("response_item", "message", '{"type":"message","role":"user","content":[{"type":"t","text":"hello"},{"type":"u","n":1},"s"]}'), ("novel", None, '{"a":[1,2],"b":null,"c":1.5}'), ("event_msg", "token_count", "{}"), ("event_msg", "other", "no json"), ("legacy", "message", None)]
    events = spark.createDataFrame([(k, *r, "text") for k, r in enumerate(rows)], "event_id int, top_type string, sub_type string, payload string, text_content string")
    once = to_hot(events)
    twice = to_hot(once.select(*events.columns))
    a, b = ({r.event_id: r.payload for r in df.collect()} for df in (once, twice))
    assert {k: a[k] for k in (0, 2, 4, 5, 6)} == {k: b[k] for k in (0, 2, 4, 5, 6)}
    import json

    assert json.loads(a[0]) == {"type": "function_call", "name": "x", "call_id": "c", "arguments": "short", "arguments_chars": 5, "arguments_sha256": json.loads(a[0])["arguments_sha256"]}
    assert json.loads(a[1])["k"] == "v" and "message" not in json.loads(a[1]) and json.loads(a[1])["replacement_history_count"] == 2
    assert [set(x) for x in json.loads(a[2])["content"]] == [{"type", "chars", "sha256"}, {"type", "n"}, {"type"}]
    assert {k: json.loads(a[3])[k] for k in ("b", "c")} == {"b": None, "c": 1.5} and "a" not in json.loads(a[3])


def test_tasks_of_an_index_and_pieces_of_a_batch_are_bounded(spark, tmp_path, monkeypatch):
    """One frequent term, and texts of more terms than a worker takes at once."""
    cut = list(pieces(pa.RecordBatch.from_pydict({"a": [0, 1, 2, 3, 4]}), np.array([3, 3, 9, 0, 1]), 4))
    assert [x.column(0).to_pylist() for x in cut] == [[0, 1], [2], [3, 4]] and not list(pieces(pa.RecordBatch.from_pydict({"a": pa.array([], pa.int64())}), np.array([], int), 4))
    monkeypatch.setattr(search, "PIECE_TERMS", 5)
    monkeypatch.setattr(search, "estimated_bytes", lambda df: 256 << 20)
    ev = spark.range(400).select(F.col("id").alias("event_id"), F.concat(F.lit("the same, the same "), F.col("id") % 3, F.lit(" x"), F.col("id")).alias("indexed_text"))
    search.write_index(ev, str(tmp_path), fields=("indexed_text",))
    stored = search.StoredIndex(spark, str(tmp_path))
    of_the = stored.of(["the"]).groupBy(F.input_file_name()).count().collect()
    assert len(of_the) == 16 and max(r["count"] for r in of_the) < 60  # a share of the most frequent term each
    assert stored.postings.count() == 400 * 4
    assert [tuple(r) for r in stored.of(["same"]).select("tf", "positions", "length").distinct().collect()] == [(2, [1, 3], 6)]
    keys = lambda phrase: sorted(r.event_id for r in search.match_phrase(stored, phrase).collect())
    assert keys(["same", "the", "same", "1"]) == list(range(1, 400, 3)) and keys(["the", "the"]) == [] and keys([]) == [] and keys(["x7"]) == [7]
