"""Line deduplication and mixing against plain versions."""

import hashlib
import math
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmill.llm import line_dedup, mixing

STRIP = "\t\n\x0b\x0c\r "
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_dedup(rows):
    key = lambda x: x.strip(STRIP).translate(LOW)
    docs = defaultdict(set)
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                docs[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 20 or len(docs[key(x)]) < 3 or i == max(docs[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_line_dedup(spark, tmp_path):
    long = "  This Line stands in Ménÿ places \x0b"
    rows = [(i, f"own line {i} of this document here\n{long}\nshort\n{long.lower()}") for i in range(9)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, long), (103, "\n".join(["x" * 30] * 200)), (104, "x" * 30), (105, "X" * 30), (106, "É" * 20), (107, "é" * 20), (108, "é" * 20), (109, "y" * 19 + "\n" + "é" * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(1)).withColumn("pos", F.lit("clash")).withColumn("h1", F.lit(2)).write.parquet(str(tmp_path / "documents.parquet"))
    got = line_dedup.op2_line_dedup(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_dedup(rows), key=repr)
    assert not any("Python" in x or "Arrow" in x for x in got._jdf.queryExecution().toString().splitlines())


def test_line_dedup_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.keep_lines(empty, line_dedup.keep_bitmaps(empty)).count() == 0


def test_bitmaps_are_sparse_and_columns_stay(spark):
    lines = [f"own line {k} of a long document" for k in range(1000)]
    for k in (0, 63, 64, 700, 999):
        lines[k] = f"this line {k} is in three documents"
    rows = [(i, "\n".join(lines if i == 1 else [lines[k] for k in (0, 63, 64, 700, 999)])) for i in (1, 2, 3)] + [(1, "one\ntwo"), (None, "\n".join(lines))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("n_dropped", "kept", "n_lines", "word", "bits")})
    bitmaps = line_dedup.keep_bitmaps(docs)
    one = bitmaps.where("doc_id = 1").first()
    assert [w.word for w in one.kept] == [0, 1, 10, 15] and one.n_dropped == 5
    assert [k for w in one.kept for k in range(w.word * 64, w.word * 64 + 64) if not w.bits >> (k % 64) & 1] == [0, 63, 64, 700, 999]
    got = line_dedup.keep_lines(docs, bitmaps)
    assert got.columns == ["doc_id", "text", "kept", "word", "bits", "n_lines", "n_dropped", "kept_text"]
    texts = {(r.doc_id, r.n_lines): r.kept_text for r in got.collect()}
    assert texts[1, 1000] == "\n".join(x for k, x in enumerate(lines) if k not in (0, 63, 64, 700, 999))
    assert texts[None, 1000] == "\n".join(lines) and texts[1, 2] == "two" and texts[3, 5].count("\n") == 4


def test_repeated_rows_count_once(spark):
    docs = spark.createDataFrame([(1, "a" * 25), (1, "a" * 25), (2, "a" * 25)], "doc_id long, text string")
    assert line_dedup.keep_bitmaps(docs).count() == 0


def plain_targets(sizes, share=1.5, weights=(5, 2, 1), cap=2.0):
    """Shares by weight; what is above the cap goes to the others, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    left, open_, out = share * sum(sizes.values()), {s: weights[k % 3] for k, s in enumerate(names)}, {}
    while open_:
        total = sum(open_.values())
        over = [s for s, w in open_.items() if left * w / total >= cap * sizes[s]]
        if not over:
            return out | {s: left * w / total for s, w in open_.items()}
        for s in over:
            out[s] = cap * sizes[s]
            del open_[s]
        left = share * sum(sizes.values()) - sum(out.values())
    return out


def test_mixing(spark, tmp_path):
    rows = [(i, f"s{i % 7}" if i % 11 else None, " ".join(["w"] * (i * 37 % 400))) for i in range(900)]
    rows += [(5000 + i, "hot", " ".join(["w"] * 100)) for i in range(900)] + [(7000, "empty", None), (7001, "empty", ""), (None, "s1", "no id"), (7002, "s2", "a b"), (7002, "s2", "a b")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash")).withColumn("rid", F.lit(0)).write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op9_mix_sources(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s, t in want.items():
        assert math.isclose(taken[s], t, rel_tol=0.02, abs_tol=1)
    again = mixing.op9_mix_sources(spark, str(tmp_path)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_blocks_are_equal_and_slots_interleave(spark):
    docs = spark.createDataFrame([(i, f"s{i % 2}", "w " * 50) for i in range(200)], "doc_id long, source string, text string")
    _, sources, pieces = mixing.mix(docs, weights=(3, 1))
    block = sources.first().block
    per_slot = [r.n for r in pieces.groupBy("slot").agg(F.sum("words").alias("n")).orderBy("slot").collect()]
    assert sum(n != block for n in per_slot) <= 2  # the last block of each source at most
    first = [r.sid for r in pieces.select("slot", "sid").distinct().orderBy("slot").limit(40).collect()]
    assert 1 in first and 0 in first


def test_small_sources_meet_their_targets(spark):
    """Sources of a thousandth of the average and less, beside large ones."""
    lengths = {"a": [2000] * 400, "b": [1], "c": [50] * 5, "d": [3, 4], "e": [2000] * 400, "f": [700] * 3, "g": [9], None: [30, 31]}
    rows = [(1000 * k + i, s, "w " * n) for k, (s, all_) in enumerate(lengths.items()) for i, n in enumerate(all_)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sizes, sources, pieces = mixing.mix(docs)
    want = plain_targets({s: sum(x) for s, x in lengths.items()})
    taken = {r.source: r.n for r in pieces.join(sources, "sid").groupBy("source").agg(F.sum("words").alias("n")).collect()}
    assert taken == {s: math.floor(t + 0.5) for s, t in want.items()}
    slots = sorted({(r.slot, r.sid, r["rank"]) for r in pieces.collect()})
    assert len({x[0] for x in slots}) == len(slots)  # a slot is one source's
    for sid in {x[1] for x in slots}:
        assert [x[2] for x in slots if x[1] == sid] == list(range(sum(x[1] == sid for x in slots)))
    small = [k / len(slots) for k, x in enumerate(slots) if x[1] not in (0, 4)]
    assert min(small) < 0.5 < max(small)  # not all at one end of the mix


def test_mixing_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert mixing.op9_mix_sources(spark, str(tmp_path)).count() == 0


def test_components_need_few_rounds(spark, monkeypatch):
    """Tasks link their own edges first: a path that one task holds needs no round but the one that finds no change."""
    from quillmill.llm import graph

    path = [(k, k + 1) for k in range(100, 400)] + [(7, 5), (5, 7), (3, 3)]
    edges = spark.createDataFrame(path, "a long, b long").repartition(7)
    found = lambda df, rounds=50: {(r.node, r.root) for r in graph.components(df, rounds).collect()}
    want = {(k, 100) for k in range(100, 401)} | {(5, 5), (7, 5)}
    assert found(edges, 1) == want
    assert found(spark.createDataFrame([], "a long, b long")) == set()
    named = edges.select(F.encode(F.lpad(F.col("a").cast("string"), 5, "0"), "utf-8").alias("a"), F.encode(F.lpad(F.col("b").cast("string"), 5, "0"), "utf-8").alias("b"))
    assert {(int(a), int(b)) for a, b in found(named, 1)} == want
    # several tasks, and several stars of each
    monkeypatch.setattr(graph, "TASK_EDGES", 30)
    assert found(edges) == want
    cut = [(5, 6), (9, 6), (9, 1), (2, 3)]
    batch = pa.RecordBatch.from_pydict({"a": [a for a, _ in cut], "b": [b for _, b in cut]})
    monkeypatch.setattr(graph, "TASK_NODES", 3)
    assert [(x.column(0).to_pylist(), x.column(1).to_pylist()) for x in graph._stars(iter([batch]))] == [([6, 9], [5, 5]), ([9, 3], [1, 2])]
