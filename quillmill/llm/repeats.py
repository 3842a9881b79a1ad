"""Removal of long byte strings that stand elsewhere too, by run-length indexes of what may repeat.

1. Every window of ``length`` bytes names one place in it, its anchor: the leftmost of the least hashes of CORE bytes.
   Equal windows have their anchors at the same offset, so that repeats meet under the hash of the anchor's core. An
   anchor that stands once in the corpus has no repeat and is out: most are.
2. The windows of an anchor are one stretch of text, its context. Equal contexts (of a copy, say) are one, and all their
   windows repeat. Distinct contexts of one anchor, a text for each, meet in an index.
3. An index is the Burrows-Wheeler transform of some groups of contexts, in runs, with sampled ends; the matching
   statistics that stream from the samples say of each place how long a stretch from it begins elsewhere too.
4. An anchor with more contexts than an index takes is split: each half of its windows shares more text than the anchor
   alone, up to the whole window, so that what does not repeat falls apart, and what repeats becomes equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngram_join import text_key
from .run_index import RunIndex
from .scratch import new_path, removed, written_at

#: Bytes of an anchor.
CORE = 32
#: Bytes of text that are hashed at once; a longer text is taken in overlapping parts.
PART = 1 << 20
#: Contexts of one anchor that go into one index; more are split.
MOST_CONTEXTS = 4096
#: Bytes of contexts that make an index, to which one more anchor's are added at most.
INDEX_BYTES = 1 << 20
VALUES = np.random.default_rng(111).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OTHERS = np.random.default_rng(112).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP, NEXT, LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)
POWERS: list[np.ndarray] = []
ANCHORS = "h long, c long, doc_id long, text_key long, first long, many int, off int"
CONTEXTS = f"{ANCHORS}, whole boolean, low int, high int, bytes binary"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * NEXT
    return h ^ (h >> np.uint64(29))


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Of texts of PART + length bytes together: for each anchor its text's number, h (of its core), c (of its context),
    first (where its first window begins in its text), many (its windows), off (from there to the anchor)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(x) for x in texts])
    ends = np.cumsum(sizes)
    n, wide = len(data), length - CORE + 1  # a window has so many places for its anchor
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    if not POWERS or len(POWERS[0]) <= n:
        POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, PART + 2 * length), base, np.uint64)])) for base in (STEP, np.uint64(pow(int(STEP), -1, 1 << 64)))]
    power, inverse = POWERS
    sums = np.concatenate([[np.uint64(0)], np.cumsum(VALUES[data] * power[:n])])
    core = (sums[CORE:] - sums[:-CORE]) * inverse[: n - CORE + 1]
    least = (_mixed(core) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(core), dtype=np.uint64)
    span = 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if wide > span:
        least = np.minimum(least[: span - wide], least[wide - span :])
    text = np.repeat(np.arange(len(texts)), sizes)
    windows = np.flatnonzero(text[: n - length + 1] == text[length - 1 :])
    place = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)])) if len(windows) else windows
    first, at = windows[new], place[new]
    many = np.diff(np.append(new, len(windows)))
    others = np.concatenate([[np.uint64(0)], np.cumsum(OTHERS[data] * power[:n])])
    context = (others[first + many - 1 + length] - others[first]) * inverse[first]
    off = at - first
    c = _mixed(context + many.astype(np.uint64) * LAST) ^ (off.astype(np.uint64) * NEXT)
    h = _mixed(_mixed(core[at] * LAST + np.uint64(1)))
    number = text[first]
    return number, h.view(np.int64), c.view(np.int64), first - (ends - sizes)[number], many, off


def _anchor_rows(length: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(some: list[tuple]) -> pa.RecordBatch:
            number, h, c, first, many, off = anchors([x[3] for x in some], length)
            ids, keys, begins = (pa.array([x[k] for x in some], pa.int64()).take(pa.array(number)) for k in (0, 1, 2))
            first = first + begins.to_numpy(zero_copy_only=False) if len(first) else first
            return pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(c, pa.int64()), ids, keys, pa.array(first, pa.int64()), pa.array(many, pa.int32()), pa.array(off, pa.int32())],
                names=["h", "c", "doc_id", "text_key", "first", "many", "off"],
            )

        some, size = [], 0
        for batch in batches:
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                text = text.as_py() or b""
                for begin in range(0, max(1, len(text) - length + 1), PART):
                    part = text[begin : begin + PART + length - 1]
                    if len(part) < length:
                        continue
                    if some and size + len(part) > PART:
                        yield flush(some)
                        some, size = [], 0
                    some.append((doc_id, key, begin, part))
                    size += len(part)
        if some:
            yield flush(some)

    return step


def repeated_windows(contexts: list[tuple[object, int, bytes]], length: int) -> list[np.ndarray]:
    """Of contexts (text, first byte in it, bytes) which of their windows begin elsewhere too, as first and behind the
    last by turns. Contexts that overlap in their text are one string, as no window is a repeat of itself."""
    order = sorted(range(len(contexts)), key=lambda k: contexts[k][:2])
    strings, starts, where, place = [], [], {}, 0
    text, end = None, -1
    for k in order:
        own, first, data = contexts[k]
        if own != text or first > end:
            place += len(strings[-1]) + 1 if strings else 0
            strings.append(bytearray(data))
            starts.append(first)
            text, end = own, first + len(data)
        elif first + len(data) > end:
            strings[-1] += data[end - first :]
            end = first + len(data)
        where[k] = place + first - starts[-1]
    long = RunIndex([bytes(x) for x in strings]).matching_statistics() >= length
    edges = np.diff(np.concatenate([[0], long.view(np.int8), [0]]))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out = []
    for k, (_, _, data) in enumerate(contexts):
        lo, hi = where[k], where[k] + len(data) - length + 1
        a, b = np.searchsorted(ends, lo, side="right"), np.searchsorted(begins, hi)
        out.append(np.column_stack([np.maximum(begins[a:b], lo) - lo, np.minimum(ends[a:b], hi) - lo]).ravel())
    return out


def _index_step(length: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[dict]) -> pa.RecordBatch:
            found = repeated_windows([((r["doc_id"] is None, r["doc_id"] or 0, r["text_key"]), r["first"], r["bytes"]) for r in rows], length)
            out = [(r["h"], r["c"], int(a), int(b)) for r, x in zip(rows, found) if not r["whole"] for a, b in zip(x[::2], x[1::2])]
            columns = list(zip(*out)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["h", "c", "low", "high"])

        rows, size, last = [], 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for r in batch.slice(at, 1024).to_pylist():
                    if size >= INDEX_BYTES and r["h"] != last:
                        yield flush(rows)
                        rows, size = [], 0
                    rows.append(r)
                    size += len(r["bytes"])
                    last = r["h"]
        if rows:
            yield flush(rows)

    return step


def _halves(length: int):
    """Each context as the two of its windows with the anchor in the upper and in the lower half of their offsets."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                out = []
                for r in batch.slice(at, 1024).to_pylist():
                    middle = (r["low"] + r["high"]) // 2
                    for low, high in ((r["low"], middle), (middle + 1, r["high"])):
                        least, most = max(low, r["off"] - r["many"] + 1), min(high, r["off"])
                        if least > most:
                            continue
                        skip, many = r["off"] - most, most - least + 1
                        data = r["bytes"][skip : skip + many - 1 + length]
                        core = data[most - low : most - high + length]
                        key = hashlib.blake2b(b"%d %d %d " % (r["h"], low, high) + core, digest_size=8).digest()
                        context = hashlib.blake2b(b"%d %d " % (many, most) + data, digest_size=8).digest()
                        signed = [int.from_bytes(x, "little", signed=True) for x in (key, context)]
                        out.append((r["h"], r["c"], skip, *signed, r["doc_id"], r["text_key"], r["first"] + skip, many, most, False, low, high, data))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
                names = ["of_h", "of_c", "skip", "h", "c", "doc_id", "text_key", "first", "many", "off", "whole", "low", "high", "bytes"]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 14, kinds)], names=names)

    return step


class _Scratch:
    """Tables in the shared folder, deleted together."""

    def __init__(self, spark):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(new_path(self.spark, name))
        return written_at(df, self.paths[-1])

    def drop(self) -> None:
        removed(self.spark, *self.paths)
        self.paths.clear()


def _marks(contexts: DataFrame, length: int, most: int, scratch: _Scratch) -> DataFrame:
    """h, c, low, high: the windows (low to before high, from the first of a context) that repeat. contexts: a written
    table of distinct contexts, two or more for each anchor; whole: all windows are known to repeat."""
    counts = scratch.keep(contexts.groupBy("h").count().where(F.col("count") > most).select("h"), "hot-anchors")
    if counts.isEmpty():
        small, hot = contexts, None
    else:
        small, hot = contexts.join(counts, "h", "left_anti"), contexts.join(counts, "h", "left_semi")
    found = small.repartition("h").sortWithinPartitions("h").mapInArrow(_index_step(length), "h long, c long, low int, high int")
    if hot is None:
        return found
    parts = scratch.keep(hot.mapInArrow(_halves(length), f"of_h long, of_c long, skip int, {CONTEXTS}"), "half-contexts")
    again = scratch.keep(parts.groupBy("h").count().where("count > 1").select("h"), "half-anchors")
    parts = scratch.keep(parts.join(again, "h", "left_semi"), "half-contexts")
    same = scratch.keep(parts.groupBy("h", "c").agg(F.count("*").alias("n"), *[F.first(x).alias(x) for x in ("doc_id", "text_key", "first", "many", "off", "low", "high", "bytes")]), "contexts")
    several = scratch.keep(same.groupBy("h").count().where("count > 1").select("h"), "half-anchors")
    inner = scratch.keep(same.join(several, "h", "left_semi").withColumn("whole", F.col("n") > 1), "contexts")
    marks = _marks(inner, length, most, scratch).union(same.where("n > 1").select("h", "c", F.lit(0), "many"))
    marks = scratch.keep(marks.toDF("h", "c", "a", "b"), "marks")
    back = parts.join(marks, ["h", "c"]).select(F.col("of_h").alias("h"), F.col("of_c").alias("c"), (F.col("skip") + F.col("a")).alias("low"), (F.col("skip") + F.col("b")).alias("high"))
    return found.union(back)


def _same_row(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.text_key") == F.col(f"{right}.text_key"))


def _cut_contexts(length: int):
    """Rows of a text and the places of its contexts as a row for each context, with its bytes."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                text, places = row.column("text").cast(pa.binary())[0].as_py(), row.column("places").flatten()
                for at in range(0, len(places), 4096):
                    some = places.slice(at, 4096)
                    h, c, first, many, off, whole = (some.field(x) for x in ("h", "c", "first", "many", "off", "whole"))
                    data = [text[a : a + b - 1 + length] for a, b in zip(first.to_pylist(), many.to_pylist())]
                    n = len(data)
                    yield pa.RecordBatch.from_arrays(
                        [h, c, pa.array(row.column("doc_id").to_pylist() * n, pa.int64()), pa.array(row.column("text_key").to_pylist() * n, pa.int64()), first, many, off, whole, pa.array([0] * n, pa.int32()), pa.array([length - CORE] * n, pa.int32()), pa.array(data, pa.binary())],
                        names=["h", "c", "doc_id", "text_key", "first", "many", "off", "whole", "low", "high", "bytes"],
                    )

    return step


def _cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, spans) as what is left of the texts, a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            out = []
            for text, spans in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist()):
                text, merged, kept, last = text or b"", [], [], 0
                for span in sorted((x["start"], x["end"]) for x in spans or []):
                    if merged and span[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], span[1])
                    else:
                        merged.append(list(span))
                for start, end in merged:
                    kept.append(text[last:start])
                    last = end
                kept.append(text[last:])
                out.append((len(text), sum(b - a for a, b in merged), [{"start": a, "end": b} for a, b in merged], b"".join(kept)))
            n_bytes, n_removed, spans, kept = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
            )


def remove_repeats(docs: DataFrame, length: int = 200, most: int = MOST_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, end of the removed runs), kept (the bytes that stay) for each row.

    A byte goes if a string of ``length`` bytes (CORE at least) that covers it also starts elsewhere, in another text or
    in its own, overlapping or not. Strings end with their text, and are judged on the input. Texts are UTF-8; a null
    one is empty. Rows are told apart by doc_id, which may be null, and text; rows that repeat repeat each other. No
    other column is read. ``most``: distinct contexts of an anchor that one index takes.

    Shuffled are 16 bytes for each anchor (one in 85 bytes), the anchors that stand twice or more, the distinct contexts
    of those, and the texts twice. No task holds more than an index of some 2.5 MB of text, or one document.
    """
    if length < CORE:
        raise ValueError(f"length must be {CORE} or more")
    spark = docs.sparkSession
    scratch = _Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    all_anchors = scratch.keep(rows.mapInArrow(_anchor_rows(length), ANCHORS), "anchors")
    again = scratch.keep(all_anchors.groupBy("h").count().where("count > 1").select("h"), "anchors-again")
    places = scratch.keep(all_anchors.join(again, "h", "left_semi"), "places")
    removed(spark, *scratch.paths[:2])
    same = scratch.keep(places.groupBy("h", "c").agg(F.count("*").alias("n"), *[F.first(x).alias(x) for x in ("doc_id", "text_key", "first", "many", "off")]), "contexts")
    several = scratch.keep(same.groupBy("h").count().where("count > 1").select("h"), "anchors-several")
    apart = same.join(several, "h", "left_semi").withColumn("whole", F.col("n") > 1)
    by_text = apart.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("h", "c", "first", "many", "off", "whole")).alias("places"))
    texts = rows.alias("t").join(by_text.alias("p"), _same_row("t", "p")).select("t.doc_id", "t.text_key", "t.text", "p.places")
    contexts = scratch.keep(texts.mapInArrow(_cut_contexts(length), CONTEXTS), "contexts")
    marks = _marks(contexts, length, most, scratch).union(same.where("n > 1").select("h", "c", F.lit(0), "many"))
    marks = scratch.keep(marks.toDF("h", "c", "low", "high"), "marks")
    found = places.join(marks, ["h", "c"]).select("doc_id", "text_key", (F.col("first") + F.col("low")).alias("start"), (F.col("first") + F.col("high") - 1 + length).alias("end"))
    spans = scratch.keep(found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    removed(spark, *scratch.paths[:-1])
    joined = rows.alias("t").join(spans.alias("p"), _same_row("t", "p"), "left").select("t.doc_id", "t.text", "p.spans")
    return joined.mapInArrow(_cut_spans, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def op11_repeats(spark, sf_dir: str) -> DataFrame:
    """Per document: its bytes, those that go, in how many runs, and the SHA-256 of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, unnest(range(n - 199)) AS i, x FROM texts WHERE n >= 200),
hashed AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS w FROM windows),
twice AS (SELECT w FROM hashed GROUP BY w HAVING count(*) > 1),
marked AS (SELECT doc_id, i FROM hashed SEMI JOIN twice USING (w)),
steps AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM marked),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM steps),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY doc_id, span),
gaps AS (
  SELECT s.doc_id, coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS f, a AS t, b - a AS gone FROM spans s
  UNION ALL SELECT t.doc_id, coalesce(max(s.b), 0), t.n, 0 FROM texts t LEFT JOIN spans s ON s.doc_id = t.doc_id GROUP BY t.doc_id, t.n)
SELECT g.doc_id, any_value(t.n)::BIGINT AS n_bytes, sum(g.gone)::BIGINT AS n_removed, count(*) FILTER (WHERE g.gone > 0) AS n_spans,
       sha256(unhex(string_agg(substr(t.x, 2 * f + 1, 2 * (g.t - f)), '' ORDER BY f, g.t))) AS kept_sha256
FROM gaps g JOIN texts t ON t.doc_id = g.doc_id GROUP BY g.doc_id
"""
