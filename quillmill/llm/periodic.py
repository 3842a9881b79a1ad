"""Periodic stretches of words, by internal pattern matching.

A bundle of documents is one text of word numbers, each document closed by a number of its own. Prefix doubling names
all stretches of 2^k words and ends in the suffix array; a wavelet matrix over it answers where, after a place, a block
occurs next. A run of period q and at least 4 q words holds, for some k, a dyadic block of 2^k words (no longer than
its part that comes again q words on) with q <= 4/3 2^k. So each block asks for its occurrences in the two windows
behind it, which are an arithmetic progression each:

* behind the block, up to 2^k: of two or more, the first one is the block's own period, the only one that can be q;
* from there to 4/3 2^k: of two or more, the block is a part of a stretch with a shorter period, as they are, and a run
  of period q takes the one stretch onto the other: it takes the begin of the one onto the other's, or the end.

Each candidate is extended to both sides by the names of stretches; of equal stretches the least period counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that are indexed at once; a longer document is a bundle of its own.
BUNDLE = 1 << 17
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
OUT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _names(ids: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of each k the names of the stretches of 2^k words from each place, a name being the place in the order of all
    stretches where its first one stands; how many share each name; and the suffix array. The last word occurs once."""
    n, names, sizes = len(ids), [], []
    order = np.argsort(ids, kind="stable")
    key = ids[order]
    while True:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, n))
        name, many = np.empty(n, np.int32), np.empty(n, np.int32)
        name[order], many[order] = np.repeat(first, size), np.repeat(size, size)
        names.append(name)
        sizes.append(many)
        if len(first) == n:
            return names, sizes, order
        step = 1 << (len(names) - 1)
        # only stretches whose name is shared have to be told apart, each within the places of its name
        at = np.flatnonzero(np.repeat(size, size) > 1)
        places = order[at]
        shared = name[places].astype(np.int64) * (n + 1) + np.where(places + step < n, name[np.minimum(places + step, n - 1)] + 1, 0)
        sort = np.argsort(shared, kind="stable")
        order[at] = places[sort]
        key = np.arange(n, dtype=np.int64) * -1 - 1
        key[at] = shared[sort]


class Wavelet:
    """A wavelet matrix over a permutation: places of the suffix array by the value that stands there."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros = []
        for b in reversed(range(self.bits)):
            one = (values >> b) & 1 == 1
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values at places lo to hi are less than x."""
        count = np.zeros(len(lo), np.int64)
        for b, before in zip(reversed(range(self.bits)), self.zeros):
            one, a, z = (x >> b) & 1 == 1, before[lo], before[hi]
            count += np.where(one, z - a, 0)
            lo, hi = np.where(one, before[-1] + lo - a, a), np.where(one, before[-1] + hi - z, z)
        return count

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value, from 0, at places lo to hi. With k = below(lo, hi, x): the first that is x or more."""
        value, k = np.zeros(len(lo), np.int64), k.copy()
        for b, before in zip(reversed(range(self.bits)), self.zeros):
            a, z = before[lo], before[hi]
            one = k >= z - a
            k -= np.where(one, z - a, 0)
            lo, hi = np.where(one, before[-1] + lo - a, a), np.where(one, before[-1] + hi - z, z)
            value += one.astype(np.int64) << b
        return value


def _ahead(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i and from j on are equal; i < j."""
    n, same = len(names[0]), np.zeros(len(i), np.int64)
    for k in reversed(range(len(names))):
        inside = j + same < n
        equal = inside & (names[k][np.where(inside, i + same, 0)] == names[k][np.where(inside, j + same, 0)])
        same += equal.astype(np.int64) << k
    return same


def _back(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i and before j are equal; i < j."""
    same = np.zeros(len(i), np.int64)
    for k in reversed(range(len(names))):
        inside = i - same >= 1 << k
        equal = inside & (names[k][np.where(inside, i - same - (1 << k), 0)] == names[k][np.where(inside, j - same - (1 << k), 0)])
        same += equal.astype(np.int64) << k
    return same


def _stretch(names: list[np.ndarray], i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the longest stretch around i to i + q that keeps period q."""
    return i - _back(names, i, i + q), i + q + _ahead(names, i, i + q)


def find_runs(ids: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end, period of all runs, by start and period: of ``least`` words and ``times`` (4 or more) periods at
    least. The last number of ids occurs once."""
    if times < 4:
        raise ValueError("blocks are dense enough for four periods or more")
    names, sizes, order = _names(ids)
    n, tree, found = len(ids), None, []
    for k in range(1, len(names)):
        size = 1 << k
        i = np.arange(0, n - size + 1, size)
        lo = names[k][i].astype(np.int64)
        many = sizes[k][i]
        i, lo, hi = i[many > 1], lo[many > 1], (lo + many)[many > 1]
        if not len(i):
            continue
        tree = tree or Wavelet(order)
        behind, near, far = (tree.below(lo, hi, np.minimum(x, n)) for x in (i + 1, i + size + 1, i + 4 * size // 3 + 1))
        own = near > behind
        found.append((i[own], tree.smallest(lo[own], hi[own], behind[own]) - i[own]))
        one = far - near == 1
        found.append((i[one], tree.smallest(lo[one], hi[one], near[one]) - i[one]))
        more = far - near > 1
        if more.any():
            i, lo, hi, near = i[more], lo[more], hi[more], near[more]
            first, second = tree.smallest(lo, hi, near), tree.smallest(lo, hi, near + 1)
            begin, end = _stretch(names, i, second - first)
            other_begin, other_end = _stretch(names, first, second - first)
            found += [(i, other_begin - begin), (i, other_end - end)]
    i, q = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    i, q = i[(q > 0) & (i + q < n)], q[(q > 0) & (i + q < n)]
    begin, end = _stretch(names, i, q)
    long = end - begin >= np.maximum(least, times * q)
    begin, end, q = begin[long], end[long], q[long]
    order = np.lexsort((q, end, begin))
    begin, end, q = begin[order], end[order], q[order]
    # of one stretch the least period; runs of one begin come by their periods, as longer ones have longer periods or not
    new = np.concatenate([[True], (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])]) if len(q) else np.zeros(0, bool)
    begin, end, q = begin[new], end[new], q[new]
    order = np.lexsort((q, begin))
    return begin[order], end[order], q[order]


def _may_repeat(ids: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The documents with two equal stretches of four words, or equal words one or two apart twice in a row: others have
    no run. (A run has a period of one or two words, or four words of it come again.)"""
    names = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        for step in (1, 2):
            after = np.zeros_like(names)
            after[:-step] = names[step:]
            names = (names * np.uint64(0x9E3779B97F4A7C15) + after) * np.uint64(0xD6E8FEB86659FD93)
            names ^= names >> np.uint64(32)
    order = np.argsort(names)
    again = np.flatnonzero(names[order[1:]] == names[order[:-1]])
    out = [docs[order[again]], docs[order[again + 1]]]
    for q in (1, 2):
        equal = ids[q:] == ids[:-q]
        out.append(docs[np.flatnonzero(equal[1:] & equal[:-1])])
    return np.unique(np.concatenate(out))


def runs_of(texts: list[list[bytes]], least: int = 6, times: int = 4) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """start, length, period of the runs of each document, a list of words, by start and period."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for words in texts for w in (*words, b" ")], np.int64)
    lengths = np.array([len(words) + 1 for words in texts])
    ends = np.cumsum(lengths)
    ids[ends - 1] = len(known) + np.arange(len(texts))  # no document's close is like another's
    docs = np.repeat(np.arange(len(texts)), lengths)
    none = np.zeros(0, np.int64)
    out = [(none, none, none)] * len(texts)
    some = _may_repeat(ids, docs)
    if len(some):
        inside = np.isin(docs, some)
        begin, end, q = find_runs(ids[inside], least, times)
        first = np.cumsum(np.append(0, lengths[some]))
        borders = np.searchsorted(begin, first)
        for k, doc in enumerate(some.tolist()):
            part = slice(borders[k], borders[k + 1])
            out[doc] = (begin[part] - first[k], end[part] - begin[part], q[part])
    return out


def _collapsed(words: list[bytes], runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    """The words that no run holds behind its first period."""
    start, length, period = runs
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def _bundles(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes]]]]:
    first, some, many = 0, [], 0
    for k, text in enumerate(batch.column(1).cast(pa.binary())):
        words = (text.as_py() or b"").split()  # at [\x20\x09-\x0D], as bytes are split
        if some and many + len(words) > BUNDLE:
            yield first, some
            first, some, many = k, [], 0
        some.append(words)
        many += len(words)
    if some:
        yield first, some


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start and period), collapsed, for each row of docs.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text. A run is a stretch of at least ``least`` words and ``times`` periods
    (4 or more), with its smallest period, that no word beside it continues. collapsed: the words that no run holds
    behind its first period, joined by one space.

    Documents are independent: no shuffle; a task's memory is that of a bundle of 131,072 words or its longest document.
    Null and empty texts have no words, no runs and an empty collapsed text. Null and repeated ids stay as they are, rows
    that repeat are each judged; further columns are left out.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _bundles(batch):
                runs = runs_of(texts, least, times)
                flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*runs)]
                offsets = np.cumsum([0, *(len(r[0]) for r in runs)]).astype(np.int32)
                collapsed = [_collapsed(w, r) if len(r[0]) else b" ".join(w) for w, r in zip(texts, runs)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array([len(w) for w in texts], pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in flat], names=["start", "length", "period"])),
                        pa.array(collapsed, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(step, OUT)


def with_periods(docs: DataFrame) -> DataFrame:
    """docs with planted periods: with h = crc32 of the decimal doc_id and g = h div 10, where h ends in 0, words from
    a = g mod n on repeat the p = 1 + (n - a) div (3 + g mod 8) words from a on. Texts are not changed otherwise."""
    # every name is bound once: an expression that stands in a lambda would be computed for each word
    repeated = F.expr(r"""
        transform(array(filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')), ws ->
          transform(array(named_struct('n', size(ws), 'g', __g)), v ->
            transform(array(named_struct('a', v.g % v.n)), u ->
              transform(array(1 + (v.n - u.a) div (3 + v.g % 8)), p ->
                array_join(transform(ws, (w, i) -> if(i < u.a, w, ws[cast(u.a + (i - u.a) % p as int)])), ' ')))))[0][0][0][0]""")
    marked = docs.select("doc_id", "text", F.expr("crc32(cast(doc_id as string))").alias("__h")).withColumn("__g", F.expr("__h div 10"))
    words = F.expr(r"text rlike '[^\\x20\\x09-\\x0D]'")
    return marked.select("doc_id", F.when(F.expr("__h % 10 = 0") & words, repeated).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Per document, a tenth of them with planted periods: its runs, the one of most periods, and what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(with_periods(docs))
    # the exact greatest of length / period; runs come in order, so that the first of equals stays
    best = F.expr("aggregate(runs, cast(null as struct<start:long,length:long,period:long>), (m, r) -> if(m is null or r.length * m.period > m.length * r.period, r, m))")
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP12_SQL = r"""
WITH hashed AS (
  SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS h
  FROM documents),
split AS (
  SELECT doc_id, h, h // 10 AS g, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM hashed),
sized AS (SELECT *, len(ws) AS n, CASE WHEN len(ws) > 0 THEN g % len(ws) END AS a FROM split),
planted AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE ws END AS ws
  FROM sized),
words AS (SELECT doc_id, n, unnest(ws) AS w, unnest(range(n)) AS i FROM planted),
equal AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal),
stretches AS (
  SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS e FROM islands GROUP BY doc_id, q, island
  HAVING max(i) + 1 + q - min(i) >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, s, e, min(q) AS q FROM stretches GROUP BY doc_id, s, e),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id),
best AS (
  SELECT r.* FROM runs r WHERE NOT EXISTS (
    SELECT 1 FROM runs b WHERE b.doc_id = r.doc_id AND ((b.e - b.s) * r.q > (r.e - r.s) * b.q
      OR (b.e - b.s) * r.q = (r.e - r.s) * b.q AND (b.s < r.s OR b.s = r.s AND b.q < r.q)))),
dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM runs),
kept AS (
  SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS text FROM words w ANTI JOIN dropped d ON w.doc_id = d.doc_id AND w.i = d.i GROUP BY w.doc_id)
SELECT p.doc_id, coalesce(l.n_runs, 0) AS n_runs, b.s AS start, b.e - b.s AS length, b.q AS period, 1000 * (b.e - b.s) // b.q AS exponent_milli,
       sha256(coalesce(l.lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM planted p LEFT JOIN listed l ON p.doc_id = l.doc_id LEFT JOIN best b ON p.doc_id = b.doc_id LEFT JOIN kept k ON p.doc_id = k.doc_id
"""
