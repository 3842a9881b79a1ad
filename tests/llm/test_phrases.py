"""Repeated byte strings, periodic runs and collocations against plain versions."""

from __future__ import annotations

import collections
import random
import re

import pytest

from quillmill.llm import collocations, periodic, repeats
from quillmill.llm.run_index import RunIndex

DOCS = "doc_id long, text string, lang string, source string"


def _repeated(texts: list[bytes], length: int) -> list[tuple[list, bytes]]:
    """The removed runs of each text, and what stays, by counting all windows."""
    counts = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs, i = [], 0
        while i < len(t):
            j = i
            while j < len(t) and gone[j] == gone[i]:
                j += 1
            if gone[i]:
                runs.append((i, j))
            i = j
        out.append((runs, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def _words(rnd: random.Random, n: int) -> str:
    return " ".join("".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(1, 7))) for _ in range(n))


@pytest.mark.parametrize("most", [4096, 3])
def test_repeats_equal_counted_windows(spark, most):
    """Copies, near copies, shared passages around hot lines, periods, short and empty texts; also with anchors split."""
    rnd = random.Random(most)
    passage, line = _words(rnd, 60), _words(rnd, 14)
    texts = [_words(rnd, 80) for _ in range(12)]
    texts += texts[:3] + [t[:150] + "X" + t[151:] for t in texts[:4]]
    texts += [_words(rnd, 20) + passage + _words(rnd, k) for k in range(6)]
    texts += [_words(rnd, 30) + "\n" + line + "\n" + _words(rnd, 30) for _ in range(15)]
    texts += ["a" * 700, "ab" * 300, "b" * 201, "c" * 199, "", "é" * 150, passage * 3]
    rows = [(k, t, None, None) for k, t in enumerate(texts)] + [(None, None, None, None), (7, texts[7], None, None), (5, "z" + texts[5], None, None), (None, passage, None, None)]
    found = repeats.remove_repeats(spark.createDataFrame(rows, DOCS), 200, most).collect()
    want = _repeated([(r[1] or "").encode() for r in rows], 200)
    expected = [(r[0], len((r[1] or "").encode()), sum(b - a for a, b in runs), runs, kept) for r, (runs, kept) in zip(rows, want)]
    got = [(r.doc_id, r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert sum(x[2] for x in expected) > 5000


def test_repeats_in_parts(spark):
    """A text of more than a part, repeats across the border, and an empty table."""
    rnd = random.Random(5)
    long = _words(rnd, 220_000)
    assert len(long.encode()) > repeats.PART
    text = long[: repeats.PART - 300] + long[500:1500] + long[9000:9300] + long[repeats.PART - 300 :] + "ab" * 200
    got = repeats.remove_repeats(spark.createDataFrame([(1, text, None, None)], DOCS)).first()
    runs, kept = _repeated([text.encode()], 200)[0]
    assert ([(s.start, s.end) for s in got.spans], bytes(got.kept)) == (runs, kept)
    assert len(runs) >= 4
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(spark.createDataFrame([], DOCS), 8)


def test_matching_statistics_equal_all_pairs():
    rnd = random.Random(2)

    def shared(a: bytes, b: bytes) -> int:
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    for _ in range(200):
        strings = [bytes(rnd.randrange(rnd.choice([1, 2, 3, 256])) for _ in range(rnd.randint(0, 25))) for _ in range(rnd.randint(1, 6))]
        strings += [x[rnd.randint(0, 3) :] for x in strings if rnd.random() < 0.5]
        index = RunIndex(strings)
        places = [(s, k) for s in range(len(strings)) for k in range(len(strings[s]) + 1)]
        want = [max([shared(strings[s][k:], strings[t][j:]) for t, j in places if (t, j) != (s, k)] or [0]) for s, k in places]
        assert index.matching_statistics().tolist() == want
        assert index.runs <= index.size


def _runs(words: list, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    out: dict = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and j > i:
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_all_periods():
    rnd, many = random.Random(1), 0
    for _ in range(400):
        docs = []
        for _ in range(rnd.randint(1, 6)):
            words, letters = [], rnd.choice([1, 2, 2, 3, 20])
            for _ in range(rnd.randint(0, 8)):
                base = [b"%d" % rnd.randrange(letters) for _ in range(rnd.randint(1, rnd.choice([3, 8, 30])))]
                if rnd.random() < 0.3:
                    base = base * rnd.randint(1, 6) + [b"x"] * rnd.randint(0, 2)
                words += (base * rnd.randint(1, 7))[: rnd.randint(1, 200)]
            docs.append(words)
        for words, found in zip(docs, periodic.runs_of(docs)):
            assert [tuple(map(int, x)) for x in zip(*found)] == _runs(words)
            many += len(found[0])
    assert many > 2000


def test_runs_of_odd_rows(spark):
    rows = [(1, "a b a b a b a b c", None, None), (1, "a b a b a b a b c", None, None), (None, "x " * 9, None, None), (3, None, None, None), (4, "", None, None), (5, " \t\n", None, None), (6, "a b c", None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("runs", periodic.F.lit(1))
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs).collect()), key=repr)
    assert got == sorted([(1, 9, [(0, 8, 2)], "a b c"), (1, 9, [(0, 8, 2)], "a b c"), (0, 9, [(0, 9, 1)], "x"), (3, 0, [], ""), (4, 0, [], ""), (5, 0, [], ""), (6, 2, [], "a b c")], key=repr)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(periodic.np.arange(3), times=3)


def _collocations(rows: list, most: int, least: int) -> dict:
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts: dict = collections.Counter()
    totals: dict = collections.Counter()
    for _, text, lang, _ in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(table)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang or "und"] += len(words)
            counts.update((lang or "und", tuple(words[i : i + n])) for n in range(1, most + 1) for i in range(len(words) - n + 1))
    out = {}
    frequent = {k: v for k, v in counts.items() if v >= least and len(k[1]) > 1}
    for (lang, ws), a in frequent.items():
        if any(k[0] == lang and len(k[1]) > len(ws) and f >= a and any(k[1][i : i + len(ws)] == ws for i in range(len(k[1]))) for k, f in frequent.items()):
            continue
        score, k = min((1000 * a * totals[lang] // (counts[lang, ws[:k]] * counts[lang, ws[k:]]), k) for k in range(1, len(ws)))
        out[lang, " ".join(ws)] = (a, counts[lang, ws[:k]], counts[lang, ws[k:]], totals[lang], score)
    return out


def test_collocations_equal_plain_counts(spark):
    """Overlapping phrases, pieces cut into chunks, languages apart, upper case, long pieces, odd rows."""
    rnd = random.Random(4)
    vocabulary = [_words(rnd, 1) for _ in range(30)]
    rows = []
    for k in range(150):
        words = []
        for _ in range(rnd.randint(0, 60)):
            words += rnd.choice([[rnd.choice(vocabulary)], vocabulary[:5], vocabulary[3:6], ["x"] * 4])
        text = "".join(w + rnd.choice([" ", " ", " ", " \t ", ". ", "\n", "!"]) for w in words)
        rows.append((k, rnd.choice([text, text.upper()]), rnd.choice(["en", "en", "de", None]), None))
    rows += [(1, None, "en", None), (1, "", None, None), (None, "  ", "fr", None), rows[0]]
    docs = spark.createDataFrame(rows, DOCS)
    want = _collocations(rows, 5, 20)
    got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(docs, 5, 20).collect()}
    assert got == want and len(want) > 50
    top = collocations.top_collocations(collocations.collocations(docs, 5, 20), 10).collect()
    order = sorted((lang, -v[4], -v[0], phrase.encode()) for (lang, phrase), v in want.items())
    assert [(r.lang, r.phrase.encode()) for r in sorted(top, key=lambda r: (r.lang, r.rank))] == [(x[0], x[3]) for lang in sorted({o[0] for o in order}) for x in [o for o in order if o[0] == lang][:10]]
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_chunks_tile_the_phrases():
    """Each phrase of five words begins in one chunk's own words; without pieces of text longer than a run."""
    rnd = random.Random(9)
    words = [rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(3000)]
    text = (" ".join(words) + ".").encode()
    chunks, starts, _ = collocations.cut_chunks([text, b" A  b\tc!"], 4)
    counts: collections.Counter = collections.Counter()
    for chunk, own in zip(chunks.to_pylist(), starts.tolist()):
        ws = chunk.decode().split(" ")
        counts.update(tuple(ws[i : i + 5]) for i in range(own) if i + 5 <= len(ws))
    assert counts == collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    assert len(chunks) > 50 and chunks.to_pylist()[-1] == b"a b c"


def test_long_texts_are_cut_at_breaks(monkeypatch):
    monkeypatch.setattr(collocations, "RUN", 100)
    text = b"ab c. " * 50 + b"x " * 200 + b"!" + b"y " * 90
    runs = list(collocations._pieces_runs(text))
    assert b"".join(runs) == text and all(x.endswith((b".", b"!", b" ")) for x in runs[:-1]) and len(runs) > 5


def test_filter_keeps_what_it_was_given(spark):
    rnd = random.Random(3)
    some = [rnd.randrange(-(2**63), 2**63) for _ in range(500)]
    keep = collocations.Filter(spark.createDataFrame([(x,) for x in some], "h long"))
    hashes = collocations.np.array(some, "int64").view("uint64")
    assert keep(hashes).all()
    assert keep(hashes ^ collocations.np.uint64(0x5555)).mean() < 0.2
    assert not collocations.Filter(spark.createDataFrame([], "h long"))(hashes).any()
