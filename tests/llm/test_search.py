"""Decontamination, near duplicates, nearest neighbours and the pipeline against plain versions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmill.llm import ann, decontaminate, ngram_join
from quillmill.llm.graph import components

WORDS = ["an", "the", "tion", "here", "ing", "with", "sand", "for", "blest", "ren"]


def prose(rng, n):
    return " ".join("".join(rng.choices(WORDS, k=2)) for _ in range(n))


def test_decontamination(spark):
    rng = random.Random(1)
    items = [(k, prose(rng, 18)) for k in range(12)] + [(90, None), (91, ""), (92, "tiny"), (93, items0 := "short but whole item text")]
    clean = [(i, prose(rng, 120)) for i in range(60)]

    def edited(text, edits):
        chars = list(text)
        for _ in range(edits):
            k = rng.randrange(len(chars))
            rng.choice([lambda: chars.__setitem__(k, "#"), lambda: chars.insert(k, "#"), lambda: chars.pop(k)])()
        return "".join(chars)

    def leak(k, edits=0, upper=False):
        text = edited(items[k][1], edits)
        return f"{prose(rng, 40)} {text.upper() if upper else text} {prose(rng, 200)}"

    bad = [(100 + k, leak(k, k % 6, k % 2 == 0)) for k in range(12)] + [(200, leak(0).replace(" ", "\n")), (201, items[3][1]), (202, prose(rng, 90_000) + " " + items[4][1] + " " + prose(rng, 10)), (203, items0.upper()), (204, items[5][1][: len(items[5][1]) // 2])]
    docs = spark.createDataFrame([*clean, *bad, (300, None), (301, ""), (None, items[1][1])], "doc_id long, text string").withColumn("start", F.lit("clash"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated_regions(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {*((100 + k, k) for k in range(12)), (200, 0), (201, 3), (202, 4), (203, 93), (None, 1)}
    for r in got:
        text = decontaminate.normalised(dict([*bad, (None, items[1][1])])[r.doc_id])
        assert r.distance <= len(items[r.item_id][1] if r.item_id < 90 else items0) // 10 and plain_distance(decontaminate.normalised(dict(items)[r.item_id]), text[r.start : r.end]) == r.distance
    sliced = decontaminate.contaminated_regions(docs, benchmark, slice_chars=300).collect()
    assert sorted(map(repr, sliced)) == sorted(map(repr, got))
    assert decontaminate.contaminated_regions(docs, benchmark.limit(0)).count() == 0


def least_distance(item, text):
    """Edits of an item against the substring of a text that it is nearest to: all of them are tried at once."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_decontamination_against_a_full_search(spark):
    """Every document against every item; texts in which an item was edited up to beyond its budget, nulls, repeats."""
    rng = random.Random(12)
    items = [(k, prose(rng, rng.randrange(6, 12))) for k in range(6)]
    docs = []
    for i in range(90):
        chars = list(items[i % 6][1])
        for _ in range(rng.randrange(0, 2 + len(chars) // 8)):
            k = rng.randrange(len(chars))
            rng.choice([lambda: chars.__setitem__(k, "#"), lambda: chars.insert(k, "#"), lambda: chars.pop(k)])()
        docs.append((i, f"{prose(rng, 6)} {''.join(chars)} {prose(rng, 6)}" if i % 5 else prose(rng, 20)))
    rows = [*docs, docs[1], (None, docs[2][1]), (7, None), (8, "")]
    got = decontaminate.contaminated_regions(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found, want = sorted(((r.doc_id, r.item_id) for r in got), key=repr), []
    for i, text in rows:
        for k, item in items:
            a, b = decontaminate.normalised(item), decontaminate.normalised(text)
            budget = min(int(0.1 * len(a)), (len(a) - 8) // 8)  # the largest that the q-gram bound allows
            if b and least_distance(a, b) <= budget:
                want.append((i, k))
    assert found == sorted(want, key=repr) and 40 < len(want) < 90
    assert decontaminate.contaminated_regions(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_gram_hashes_tell_grams_apart():
    flat = np.frombuffer("abcabcabd".encode("utf-32-le"), np.uint32)
    for q in (1, 3, 5, 8):
        h = decontaminate.gram_hashes(flat, q).tolist()
        grams = ["abcabcabd"[k : k + q] for k in range(10 - q)]
        assert len(h) == len(grams) and all((h[i] == h[j]) == (grams[i] == grams[j]) for i in range(len(h)) for j in range(len(h)))


def plain_classes(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets.append((i, frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in sets:
        for j, b in sets:
            if j < i and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(a), root(i)) for i, a in sets)


def near_rows():
    rng = random.Random(3)
    rows, k = [], 0
    passage = prose(rng, 60).split()
    for _ in range(25):
        base = prose(rng, rng.randrange(3, 160)).split()
        if rng.random() < 0.6:
            base[1:1] = passage
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = "edit%d" % rng.randrange(10**6)
            rows.append((k, "  ".join(w).upper() if rng.random() < 0.3 else " ".join(w)))
            k += 1
    rng.shuffle(rows)
    return rows + [(900, None), (901, ""), (902, " \n "), (903, "two words"), (904, "TWO\twords"), (905, "a b c d e"), (906, "a b c d e"), (907, "é é é é é É")]


@pytest.mark.parametrize(("part_size", "most_hot"), [(4096, 1), (3, 1000)])
def test_near_duplicates(spark, monkeypatch, part_size, most_hot):
    monkeypatch.setattr(ngram_join, "MOST_SENT", part_size)  # members sent, or shuffled
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit("clash")).withColumn("block", F.lit(1))
    got = ngram_join.near_duplicates(docs, part_size=part_size, most_hot=most_hot).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_classes(rows)
    assert all(r.representative == (r.doc_id == r.component_id) for r in got)


def test_blocks_of_frequent_tokens(spark, monkeypatch):
    """Tokens that many sets hold are dealt into stars: the blocks are the same."""
    monkeypatch.setattr(ngram_join, "STAR", 2)
    rng = random.Random(7)
    held = {t: rng.sample(range(1, 400), rng.choice([1, 2, 3, 60])) for t in range(40)}
    rows = [(max(0, math.ceil(math.log2(len(sets)))) << 57 | t, half) for t, sets in held.items() for half in sets]
    up = {}

    def root(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for sets in held.values():
        for half in sets:
            x, y = root(sets[0]), root(half)
            up[max(x, y)] = min(x, y)
    got = {r.half: r.block for r in ngram_join.blocks_of(spark.createDataFrame(rows, "token long, half long")).collect()}
    assert got == {i: root(i) for i in up if any(i in s and len(s) > 1 for s in held.values())}


def test_near_duplicates_of_odd_tables(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()), key=repr) == [(1, 2, 1), (1, 2, 1), (None, 2, None)]


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 260)]
    up = {}

    def root(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    nodes = {i for p in pairs for i in p if p[0] != p[1]}
    assert sorted(map(tuple, got)) == sorted((i, root(i)) for i in nodes)


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (600, 9)) * rng.uniform(0.2, 3, (600, 1))
    x[100:400] = x[100]  # a third and more are one vector
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, []), (1040, [0.0] * 9), (1060, [float("nan")] * 9), (1080, [1.0, None] + [1.0] * 7), (1100, [1.0]), (None, [1.0] * 9)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("code", F.lit("clash"))
    got = ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), block=150, query_block=16).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 600, 20))
    hits = 0
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21)) and q not in {r.vec_id for r in found}
        exact = x @ x[q]
        assert all(abs(r.score - exact[r.vec_id]) < 1e-9 for r in found)
        want = [i for i in sorted(range(600), key=lambda i: (-(x[i] * x[q]).sum(), i)) if i != q][:20]
        hits += len(set(want) & {r.vec_id for r in found})
    assert hits / (20 * len(by)) >= 0.9


@pytest.mark.parametrize("kind", ["unrelated", "clusters", "near copies", "copies"])
def test_a_whole_block_is_exact(kind):
    """At the block and rerank of production: recall is 1 whatever the codes of close vectors are."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(8192, 64))
    if kind == "clusters":
        x = rng.normal(size=(10, 64))[rng.integers(0, 10, len(x))] + 0.3 * x
    elif kind != "unrelated":  # a third of the rows
        x[: len(x) // 3] = rng.normal(size=64) + (0.02 if kind == "near copies" else 0) * x[: len(x) // 3]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids, asked = np.arange(len(x)), np.arange(0, len(x), 64)
    fitted = ann.Quantiser(64).fit(x.astype(float))
    found = list(ann.scan(fitted, ids, x, fitted.encode(x.astype(float)), asked, x[asked].astype(float), 20, 128))
    assert len(found) == len(asked)
    for q, (q_ids, near, scores) in zip(asked, found):
        exact = (x.astype(np.float64) * x[q]).sum(1)
        want = [i for i in np.lexsort((ids, -exact)) if i != q][:20]
        assert set(q_ids) == {q} and near.tolist() == want and scores.tolist() == exact[want].tolist()


def test_nearest_of_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(few.limit(0), few).count() == 0


def test_rows_are_judged_by_their_texts(spark):
    """Null ids, ids that repeat, further columns of clashing names."""
    rng = random.Random(4)
    a, b, c, item = prose(rng, 60), prose(rng, 60), prose(rng, 60), prose(rng, 25)
    rows = [(1, a, "x"), (1, b, "y"), (1, b, "w"), (2, a, "z"), (None, a, "n"), (None, None, "m"), (3, "", "e"), (3, "", "e"), (4, f"{c} {item}", "k"), (4, c, "l"), (None, f"{item} {c}", "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({x: F.col("source") for x in ("score", "time", "times", "key", "row", "class", "set", "text_key", "found", "first")})
    docs = docs.withColumn("more", F.create_map(F.col("source"), F.lit(1)))
    tags = lambda df: sorted(r.time for r in df.collect())
    one = corpus_pipeline.one_of_each(spark, docs, None)
    assert one.columns == docs.columns and tags(one) == sorted("xwnmeeklo")


def test_stages_keep_columns_and_empty_tables(spark, tmp_path):
    rng = random.Random(6)
    item = prose(rng, 25)
    names = ["score", "time", "times", "key", "row", "found"]
    rows = [(k % 3, prose(rng, 50), f"s{k % 2}") for k in range(12)] + [(7, f"{prose(rng, 9)} {item}", "s1"), (None, f"{item} {prose(rng, 9)}", "s1"), (7, prose(rng, 40), "s1"), (None, prose(rng, 40), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({x: F.concat(F.lit(x), F.coalesce("source", F.lit("-"))) for x in names})
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and all(r[x] == f"{x}{r.source or '-'}" for r in out.collect() for x in names)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    clean = corpus_pipeline.without_benchmarks(spark, docs, str(tmp_path))
    assert sorted(r.text for r in clean.collect()) == sorted(t for _, t, _ in rows if item not in t)
    assert None in {r.doc_id for r in corpus_pipeline.mixed(spark, docs, str(tmp_path)).collect()}
    assert corpus_pipeline.token_output(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    item = prose(rng, 25)
    good = [(i, prose(rng, 80), "en", f"s{i % 3}") for i in range(120)]
    junk = [(200 + i, " ".join(w.upper() + "!!" for w in prose(rng, 80).split()), "en", "s0") for i in range(40)]
    copies = [(300 + i, good[i][1], "en", "s1") for i in range(10)]
    leaks = [(400 + i, f"{prose(rng, 30)} {item} {prose(rng, 30)}", "en", "s2") for i in range(5)]
    rows = [(*r, len(r[1])) for r in good + junk + copies + leaks] + [(500, None, None, None, None), (501, "", "en", "s0", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(not 200 <= r[0] < 300), 0) for r in rows if r[0] < 300], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        ids.append([r.doc_id for r in docs.select("doc_id").collect()])
    first, second, third, fourth, last = map(set, ids)
    assert not first & set(range(200, 300)) and set(range(120)) <= first
    assert second == first - set(range(300, 310))
    assert third == second - set(range(400, 405))
    assert fourth == last <= third and len(ids[3]) == len(ids[4]) and max(ids[3].count(i) for i in fourth) <= 2


def test_queries_that_repeat_are_asked_once_and_ranked_apart(spark):
    rng = np.random.default_rng(8)
    data = rng.normal(size=(60, 8)).round(3)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(data)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    other = [float(x) for x in data[1]]
    queries = spark.createDataFrame([rows[0], rows[0], (0, other), rows[5]], "vec_id long, embedding array<float>")
    got = ann.nearest(vectors, queries, k=5).collect()
    assert len(got) == 15
    want = []
    exact = np.array([r[1] for r in rows], np.float32).astype(float)
    for q_id, q in ((0, exact[0]), (0, exact[1]), (5, exact[5])):
        scores = exact @ q
        best = sorted((j for j in range(60) if j != q_id), key=lambda j: (-(exact[j] * q).sum(), j))[:5]
        want += [(q_id, rank + 1, j, round(scores[j], 9)) for rank, j in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == sorted(want)
