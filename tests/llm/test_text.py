"""HTML extraction, quality, tokens, token counts, WARC against plain versions."""

import hashlib
import io
import math
import random
import re
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmill.llm import html_text, quality, token_counts, token_files, warc
from quillmill.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", "a", " \n\n x  y\t", "naïve ²³ ½ don't I'll", "日本語 😀 é", "a\x1cb \x85 c\xa0", "one\ntwo\n\nthree\n" * 400, "x" * 20_000, "<|endoftext|>", "see <|endoftext|>\n<|endoftext|> end", "Ǆ ȸ ...!!! 12_3"]


def library():
    return Tokenizer.from_file(PATH)


def test_tokens_equal_the_library():
    encoder, spans, t, rng = Encoder(PATH), Encoder(PATH, True), library(), random.Random(1)
    alphabet = [*"ab zé'sdmt ²½0_.,!\n\t\x85\xa0ß日́", *encoder.added, "<|endof", "text|>"]
    assert "<|endoftext|>" in encoder.added and encoder.tokenizer.encode("a <|endoftext|> b").ids == np.frombuffer(encoder.ids(["a <|endoftext|> b"])[0], np.uint16).tolist()
    for text in [x or "" for x in TEXTS] + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(2000)]:
        e = t.encode(text, add_special_tokens=False)
        assert np.frombuffer(encoder.ids([text])[0], np.uint16).tolist() == e.ids
        assert list(zip(*(x.tolist() for x in spans.spans(text)))) == e.offsets


def test_token_files(spark, tmp_path):
    rows = [(50 - k, x) for k, x in enumerate(TEXTS)] + [(7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("offset", F.lit("clash")).repartition(3)
    manifest = token_files.write_token_files(docs, str(tmp_path / "out"), PATH, length=16, rows=4)
    got = sorted(map(tuple, token_files.read_token_files(manifest, str(tmp_path / "out")).collect()))
    t, want, at = library(), [], 0
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)


def test_files_are_equal_length_sequences(spark, tmp_path):
    import pyarrow as pa

    token_files.write_token_files(spark.createDataFrame([(1, "a b c " * 30)], "doc_id long, text string"), str(tmp_path / "out"), PATH, length=8, rows=2)
    (file,) = [p for p in (tmp_path / "out").glob("part-*.arrow") if ".docs" not in p.name]
    reader = pa.ipc.open_file(pa.memory_map(str(file)))
    assert reader.schema.field("ids").type == pa.list_(pa.uint16(), 8) and reader.schema.field("mask").type == pa.list_(pa.bool_(), 8)
    masks = np.concatenate([reader.get_batch(k)["mask"].flatten().to_numpy(zero_copy_only=False) for k in range(reader.num_record_batches)])
    assert masks.sum() == len(library().encode("a b c " * 30, add_special_tokens=False).ids) + 1 and len(masks) % 8 == 0


def test_token_files_of_nothing(spark, tmp_path):
    manifest = token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "out"), PATH)
    assert token_files.read_token_files(manifest, str(tmp_path / "out")).count() == 0


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_token_counts(spark, rule):
    docs = spark.createDataFrame([(k, x) for k, x in enumerate([*TEXTS, "a\n\n\n\nb", "x \n y"])], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    t = library()
    for r in token_counts.section_tokens(docs, PATH, rule).collect():
        text = dict(enumerate([*TEXTS, "a\n\n\n\nb", "x \n y"]))[r.doc_id] or ""
        lines, want = text.split("\n"), None
        owner = [k for k, line in enumerate(lines) for _ in line + "\n"]
        want = [0] * len(lines)
        for a, b in t.encode(text, add_special_tokens=False).offsets:
            held = [owner[c] for c in range(a, max(b, a + 1))]
            want[{"first": held[0], "last": held[-1], "most": max(sorted(set(held)), key=lambda s: (held.count(s), -s))}[rule]] += 1
        assert r.section_tokens == want and r.n_tokens == sum(want) and r.n_sections == len(lines) and r.n_chars == len(text)


def test_token_counts_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a\nb"), (2, None)], "doc_id long, text string").withColumn("section_tokens", F.lit("clash"))
    got = sorted(((r.doc_id, r.n_tokens, r.section_tokens) for r in token_counts.section_tokens(docs, PATH).collect()), key=repr)
    assert got == [(1, 2, [2]), (1, 2, [2]), (2, 0, [0]), (None, 3, [2, 1])]
    assert token_counts.section_tokens(docs.limit(0), PATH).count() == 0


def test_warc_of_nothing(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.write_packages(pages, str(tmp_path / "w")), str(tmp_path / "w")).count() == 0


def test_token_counts_refuses_other_rules(spark):
    with pytest.raises(ValueError):
        token_counts.section_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH, "some")


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header>Site</header><nav><ul><li>Menu</ul></nav><!-- ad --><div class="ad">Buy <b>now</div><div id="cookie-notice">We use</div>
<article><h1>The &amp; title</h1><p><b>First   paragraph<br>of
text.<p>Second&nbsp;one.</p><div class="share-buttons">Share</div><form>Mail <input></form><aside>See also</aside>
<ul><li>item one<li>item two</ul><blockquote>Short.</blockquote></article>
<section class="comments"><article class="comment"><p>I like it a lot, really very much so.</p></article></section><footer>&copy; us"""


def test_article_stays_and_the_rest_goes():
    assert html_text.main_text(PAGE) == "The & title\nFirst paragraph of text.\nSecond one.\nitem one\nitem two\nShort."


def test_pages_without_an_article():
    page = "<body><div><p>" + "Long text of the page. " * 20 + "</p><p>Be.</p></div><nav>a</nav></body>"
    assert html_text.main_text(page) == ("Long text of the page. " * 20).strip() + "\nBe."


PROSE = "The river ran under the old bridge and the people of the town came down to watch it, year after year. "


@pytest.mark.parametrize("wrap", ["div", "article", "main"])
def test_ratios_decide_where_names_tell_nothing(wrap):
    """No class, id or role; the furniture stands in plain divs, inside the container or outside."""
    menu = "<div><a href=/>Home</a></div><div><a href=/a>About us</a></div><div><a href=/t>Terms</a></div><div><a href=/c>Contact</a></div>"
    body = f"<div><h1>On rivers</h1><p>{PROSE * 3}</p><p>Short.</p><p>{PROSE * 2}<a href=/x>more</a></p><ul><li>one thing<li>another thing</ul><p>{PROSE * 4}</p></div>"
    related = "".join(f"<div><a href=/{k}>Something else to read {k}</a></div>" for k in range(8))
    text = ["On rivers", (PROSE * 3).strip(), "Short.", PROSE * 2 + "more", "one thing", "another thing", (PROSE * 4).strip()]
    want = "\n".join(text)
    assert html_text.main_text(f"<body>{menu}<{wrap}>{body}</{wrap}>{related}</body>") == want
    assert html_text.main_text(f"<body>{menu}<{wrap}>{body}{related}</{wrap}></body>") == want


def test_a_wrapper_that_tells_of_a_sidebar_stays():
    page = f"<body><div class='content has-sidebar'><div><p>{PROSE * 2}</p></div><div class=sidebar>See <p>{PROSE}</p></div></div></body>"
    assert html_text.main_text(page) == (PROSE * 2).strip()


def test_containers_of_links_alone_are_not_the_article():
    cards = "".join(f"<article><a href=/{k}>Read about {k}</a></article>" for k in range(6))
    assert html_text.main_text(f"<body>{cards}<div><h1>Title</h1><p>{PROSE * 4}</p><p>{PROSE * 3}</p></div></body>") == f"Title\n{(PROSE * 4).strip()}\n{(PROSE * 3).strip()}"


def plain_content(lines):
    """content_lines, step by step: means over windows, borders by trying all of them out from the mean on, runs one by one."""
    weights = [np.exp(-0.5 * d * d) for d in range(3)]
    ratios = [x.plain / max(1, x.tags) for x in lines]
    smooth = []
    for k in range(len(lines)):
        near = [(weights[abs(j - k)], ratios[j]) for j in range(len(lines)) if abs(j - k) <= 2]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    border = sum(smooth) / len(smooth)
    for _ in range(20):
        low, high = [v for v in smooth if v < border], [v for v in smooth if v >= border]
        if not low or not high:
            break
        border = (sum(low) / len(low) + sum(high) / len(high)) / 2
    border = min(border, max(smooth))
    runs = []
    for k, x in enumerate(lines):
        links = x.plain < x.chars - x.plain
        kind = (x.region, None if links else x.section, links)
        if not runs or runs[-1][0] != kind:
            runs.append((kind, []))
        runs[-1][1].append(k)
    upper = {k for _, ks in runs if sum(smooth[k] for k in ks) / len(ks) >= border - 1e-9 for k in ks} or {k for k in range(len(lines)) if smooth[k] >= border - 1e-9}
    regions = {lines[k].region for k in upper} - {0}
    where = (lambda x: x.region in regions) if regions else (lambda x: x.section in {lines[k].section for k in upper})
    return [where(x) and (k in upper or x.plain >= x.chars - x.plain) for k, x in enumerate(lines)]


def test_content_against_a_plain_version():
    rng = random.Random(8)
    for _ in range(300):
        lines, region, section = [], 0, 1
        for _ in range(rng.randrange(1, 25)):
            if rng.random() < 0.3:
                region, section = rng.choice([0, 0, 1, 2]), section + rng.random().__round__()
            chars = rng.choice([3, 12, 40, 300, 900])
            lines.append(html_text.Line("x", rng.choice([0, chars, chars, chars // 2, chars // 3]), chars, rng.randrange(1, 6), region, section))
        assert html_text.content_lines(lines) == plain_content(lines)


def test_deep_and_unclosed_pages(spark):
    deep = "<div>" * 20_000 + "<p>" + PROSE
    pages = spark.createDataFrame([(1, "u", deep), (1, "u", deep), (2, "u", "<p>" + PROSE + "<b><i><a href='" )], "page_id long, url string, html string")
    assert [r.text for r in html_text.extract(pages).orderBy("page_id").collect()] == [PROSE.strip()] * 3
    assert html_text.extract(pages.limit(0)).count() == 0


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<script>x"), (None, "u", "<p>é &lt;b&gt;"), (5, "u", "<p>" + "w " * 100_000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(pages).collect()}
    assert got == {1: ("", 0), 2: ("", 0), 3: ("", 0), None: ("é <b>", 5), 5: (("w " * 100_000).strip(), 199_999)}


def test_unclosed_advert_does_not_swallow_the_article():
    assert html_text.main_text("<div class=ad>Buy<article><p>Text stays here.</article>") == "Text stays here."


def test_quality_learns_and_keeps_all_rows(spark):
    rng = random.Random(2)
    words = ["the", "river", "house", "under", "green", "tree", "walked", "again"]
    good = lambda: " ".join(rng.choices(words, k=rng.randrange(30, 300))).capitalize() + "."
    bad = lambda: " ".join(w.upper() + "!!" for w in rng.choices(words, k=rng.randrange(30, 300)))
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(400)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "x"), (1, rows[1][1]), (1002, good() * 300)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)] + [(1000, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, sample=300, most_passages=2000)
    got = quality.score(docs, model).withColumn("held_out", F.expr(quality.HELD_OUT)).collect()
    assert len(got) == 405 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert len(held) > 40 and sum((r.score >= 0.3) == (r.doc_id % 4 != 0) for r in held) / len(held) > 0.95
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    kept = quality.score(docs, model, keep=True)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == 405


def plain_score(model, text):
    """One text, passage by passage and word by word."""
    data = (text or "").encode("utf-8", "replace") + b"\n"
    spans = [(m.start(), m.end()) for m in re.finditer(rb"[^\t-\r ]+", data)]
    rows = []
    for k in range(0, max(1, len(spans)), quality.PASSAGE):
        some = spans[k : k + quality.PASSAGE]
        row = [0.0] * quality.N_FEATURES
        if some:
            end = spans[k + quality.PASSAGE][0] if k + quality.PASSAGE < len(spans) else len(data)
            counts = [0] * quality.N_CLASSES
            for b in data[some[0][0] : end]:
                counts[quality.CLASS[b]] += 1
            words = [data[a:b] for a, b in some]
            sizes, n = [len(w) for w in words], len(words)
            mean = sum(sizes) / n
            row = [math.sqrt(c / sum(counts)) for c in counts]
            row += [mean / 8, math.sqrt(max(0, sum(x * x for x in sizes) / n - mean**2)) / 8, len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, sum(quality.CLASS[w[0]] == 1 for w in words) / n, math.log1p(n) / 4, sum(x > 20 for x in sizes) / n]
        rows.append(row)
    p = model.p
    h = [np.tanh((np.array(r) - model.mean) * model.scale @ p["W"] + p["b"]) for r in rows]
    e = [float((np.tanh(x @ p["V"]) / (1 + np.exp(-(x @ p["U"])))) @ p["w"]) for x in h]
    a = [math.exp(x - max(e)) for x in e]
    z = sum(w / sum(a) * x for w, x in zip(a, h))
    return 1 / (1 + math.exp(-float(z @ p["c"] + p["d"])))


def test_scores_equal_a_plain_version(spark):
    rng = random.Random(3)
    texts = [None, "", "  \n", "one", " \n leading blanks", "É Ünï \t end  "] + ["".join(rng.choices(["word ", "Again ", "x1-", "  ", "\n", "a" * 25 + " ", "é "], k=rng.randrange(1, 400))) for _ in range(40)]
    x, n = quality.passages([t or "" for t in texts])
    model = quality.fit(x.astype(float), n, np.array([k % 2 for k in range(len(texts))], float), steps=20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all(got[k] == pytest.approx(plain_score(model, t), abs=1e-9) for k, t in enumerate(texts))
    assert quality.score(docs.limit(0), model).count() == 0


def test_long_labelled_documents_leave_the_sample_its_size(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(quality, "fit", lambda x, n, y: fitted.append(sorted(n.tolist())))
    for long in (lambda i: i % 50 == 0, lambda i: i % 10 > 0, lambda i: True):
        docs = spark.createDataFrame([(i, " ".join(["word"] * (64 * (300 + i) if long(i) else 64))) for i in range(500)], "doc_id long, text string")
        quality.train(docs, docs.select("doc_id", F.lit(1).alias("quality")), sample=30, most_passages=1000)
    assert fitted[0] == [1] * 30 and fitted[1][:30] == [1] * 30
    assert len(fitted[2]) >= 2 and sum(fitted[2]) <= 1000  # where all are long, as many as fit


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert quality.train(docs, spark.createDataFrame([], "doc_id long, quality int")) is None
    assert quality.score(docs, None).first().score == 0.5


def test_gradient():
    """The training's gradient lowers the loss on bags that a mean could not tell apart."""
    rng = np.random.default_rng(0)
    n = rng.integers(1, 6, 200)
    x = rng.normal(0, 1, (n.sum(), 4))
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    y = (np.maximum.reduceat(x[:, 0], starts) > 1).astype(float)
    score = quality.fit(x, n, y).score(x, n)
    assert ((score > 0.5) == y).mean() > 0.9


def test_warc_round_trip(spark, tmp_path):
    big, mid = "é" * 70, "p" * 100
    rows = [(5, "http://a", big), (3, "http://b\r\n", big), (9, None, big), (3, "http://b", big), (1, "u", "p" * 99), (2, "u", "p" * 99), (4, "u", None), (6, "u", ""), (None, "u", mid), (8, "u", mid), (10, "u", mid), (11, "u", "\r\n\r\nWARC/1.1" * 30_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("refers_to", F.lit(0))
    path = str(tmp_path / "warc")
    got = sorted(map(tuple, warc.read_records(warc.write_packages(pages, path, most_bytes=4000), path, chunk_bytes=500).collect()), key=repr)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, other in rows if (other or "").encode() == data and j is not None]
        first = min(same, default=None) if len(data) >= 100 else None
        again = i is not None and first is not None and i > first
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=repr)


def test_zip64_directory_is_read():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for k in range(3):
            with z.open(zipfile.ZipInfo(f"m{k}"), "w", force_zip64=True) as f:
                f.write(b"data %d" % k)
    size = len(raw.getvalue())
    found = warc.members(raw, size)
    assert {n: raw.getvalue()[a : a + k] for n, (a, k) in found.items()} == {f"m{k}": b"data %d" % k for k in range(3)}
    with zipfile.ZipFile(raw := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("m", "data" * 99)
    with pytest.raises(ValueError):
        warc.members(raw, len(raw.getvalue()))
    with zipfile.ZipFile(raw := io.BytesIO(), "w") as z:  # more entries than the old directory can count
        for k in range(65_600):
            z.writestr(f"{k}", b"")
    assert len(warc.members(raw, len(raw.getvalue()))) == 65_600


@pytest.mark.parametrize("part", ['<h2 id="social-impact">{}</h2>', '<h2 id="comments-on-method">{}</h2>', '<p id="warning-signs">{}</p>', '<p class="legal-history">{}</p>', '<section class="search-algorithms"><p>{}</p></section>', '<section id="search"><p>{}</p></section>', '<p class="warning">{}</p>', '<li id="ad">{}</li>'])
def test_names_of_subjects_stay(part):
    """Within an article, and in pages without one where the name is no furniture as a whole."""
    text = "A line about the subject of the page that says enough of it."
    want = f"{PROSE.strip()}\n{text}\n{PROSE.strip()}"
    assert html_text.main_text(f"<body><nav><a href=x>Home</a></nav><article><p>{PROSE}</p>{part.format(text)}<p>{PROSE}</p></article></body>") == want
    if part.startswith(("<h2", '<p id', '<p class="legal')):
        assert html_text.main_text(f"<body><nav><a href=x>Home</a></nav><div><p>{PROSE}</p>{part.format(text)}<p>{PROSE}</p></div></body>") == want


FURNISHED = [
    '<div class="ad">{}</div>', '<div class="ad-slot">{}</div>', '<section id="comments"><p>{}</p></section>', '<div class="share-buttons">{}</div>', '<div class="cookie-banner">{}</div>', '<ul class="related-posts"><li>{}</li></ul>',
    '<aside>{}</aside>', '<form><p>{}</p></form>', '<nav>{}</nav>', '<script>{}</script>', '<style>{}</style>', '<footer>{}</footer>', '<div hidden>{}</div>', '<div style="display: none">{}</div>', '<div class="newsletter box">{}</div>', '<!-- {} -->', '<div class="comment-list"><p>{}</p></div>',
]


@pytest.mark.parametrize("wrap", ["article", "main", "div"])
def test_pages_equal_what_they_were_made_of(wrap):
    """Random pages: blocks of an article, written in many ways, with furniture within, before and behind it."""
    rng = random.Random(len(wrap))
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))
    for _ in range(120):
        blocks, html = [], []
        for k in range(rng.randint(3, 9)):
            text = words(rng.randint(25, 60))
            form = rng.choice(["<p>{}</p>", "<p>{}", "<p id=ad-{0:.3}>{0}</p>", "<blockquote>{}</blockquote>", "<p><b>{}</b></p>", "<pre>{}</pre>", "<div>{}</div>" if wrap != "div" else "<p>{}</p>"])
            blocks.append(text)
            html.append(form.format(text.replace(" ", rng.choice([" ", "\n", " \t", "&nbsp;"]) if form != "<pre>{}</pre>" else " ", 1)))
            if rng.random() < 0.4:
                html.append(rng.choice(FURNISHED).format(words(rng.randint(1, 30))))
        before, after = ("".join(rng.choice(FURNISHED).format(words(rng.randint(1, 30))) for _ in range(rng.randint(0, 3))) for _ in range(2))
        page = f"<html><head><title>{words(4)}</title></head><body><header><p>{words(5)}</p></header>{before}<{wrap}>{''.join(html)}</{wrap}>{after}<footer>{words(9)}</footer></body></html>"
        assert html_text.main_text(page) == "\n".join(blocks), page


def test_unmatched_tags_cost_no_more_than_their_number():
    import time

    def seconds(n: int) -> float:
        page = "<body><article><p>Text.</p>" + "<div>" * n + "</section>" * n + "<b><div>" + "<i>" * n + "</b>" * n + "<div class=ad>" + "<article>" * n
        start = time.perf_counter()
        html_text.main_text(page)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(32_000) < 40 * seconds(4_000)
