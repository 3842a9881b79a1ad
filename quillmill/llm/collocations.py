"""Phrases whose words stand together more often than by chance, counted in a prefix-free parse.

1. Texts are cut at punctuation into pieces, and pieces into chunks by their content: a window of as many words as two
   neighbouring chunks share ends one chunk and begins the next where its hash says so. Equal chunks are one entry of a
   dictionary with the number of times it stands in the parse; what repeats in the corpus is counted once.
2. Phrases are counted inside the entries, times the entry's number. A phrase belongs to the chunk in which it begins
   before the shared window, so that it is counted once. A phrase can only be frequent if the two phrases that it
   extends by a word are: each length counts the hashes of those alone, and a bit filter of fixed size carries the
   frequent ones to the next length. The filter lets none out that is frequent; what it lets in wrongly is counted.
3. The last pass takes the phrases' texts, whose exact counts are then known; cuts, scores and ranks are joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .scratch import new_path, removed, written_at

BREAKS = b".,;:!?\n\x0b\x0c\r"
KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: blank, 2: end of a piece
KIND[list(b" \t")], KIND[list(BREAKS)] = 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: One window of words in so many ends a chunk.
EACH = 16
#: Bytes that are cut or counted at once; a longer piece is a run of its own.
RUN = 1 << 20
#: Bits of a hash that are counted: two phrases that agree in them may both be let in, and are counted by text then.
COUNTED = np.uint64((1 << 48) - 1)
#: Phrases that are summed up before they are sent.
SUMMED = 1 << 21
#: Bits of the largest filter (16 MB), as a power of two, and bits for each frequent phrase.
MOST_BITS, BITS_EACH = 27, 32
#: Parts into which a language is split to rank its phrases.
SALTS = 32
VALUES = np.random.default_rng(13).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP, NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * NEXT
    return h ^ (h >> np.uint64(29))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse modulo 2^64, kept for what runs are long, and made anew for longer ones."""
    if size in POWERS or size <= 2 * RUN and 2 * RUN in POWERS:
        return POWERS.get(size) or POWERS[2 * RUN]
    many = max(size, 2 * RUN)
    out = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(many, base, np.uint64)])) for base in (STEP, np.uint64(pow(int(STEP), -1, 1 << 64))))
    if many == 2 * RUN:
        POWERS[many] = out
    return out


def _words(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the words in data, and their hashes. data ends with a break."""
    inside = kind == 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    begin, end = edges[::2], edges[1::2]
    power, inverse = _powers(len(data))
    total = np.cumsum(VALUES[data] * power[: len(data)])
    hashes = total[end - 1] - np.where(begin > 0, total[begin - 1], np.uint64(0))
    return begin, end, _mixed(hashes * inverse[begin])


def _ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """The hashes of the n words from each place on; of the last n - 1 places nothing that counts."""
    out = words.copy()
    for k in range(1, n):
        out[:-k] = _mixed(out[:-k] * STEP + words[k:]) if k < len(words) else out[:-k]
    return out


def _sliced(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes data[begin:end], as a binary column."""
    size = end - begin
    offsets = np.concatenate([[0], np.cumsum(size)])
    places = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[places])])


def _pieces_runs(text: bytes) -> Iterator[bytes]:
    """A text in runs that end with a break."""
    at = 0
    while len(text) - at > RUN:
        cut = max(text.rfind(bytes([b]), at, at + RUN) for b in BREAKS)
        if cut < 0:
            found = [x for b in BREAKS if (x := text.find(bytes([b]), at + RUN)) >= 0]
            cut = min(found, default=len(text) - 1)
        yield text[at : cut + 1]
        at = cut + 1
    yield text[at:]


def cut_chunks(texts: list[bytes], overlap: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(chunks, starts, text): the chunks of texts, lower-cased, their words joined by one space; how many words of each
    begin a phrase that is its own; and the number of each one's text."""
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    kind = KIND[data]
    begin, end, words = _words(data, kind)
    if not len(begin):
        return pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    piece = np.cumsum(kind == 2, dtype=np.int32)[begin]
    n = len(begin)
    first = np.concatenate([[True], piece[1:] != piece[:-1]])
    last = np.append(np.flatnonzero(first)[1:], n)  # behind the words of each piece
    behind = np.repeat(last, np.diff(np.append(np.flatnonzero(first), n)))
    window = (_ngrams(words, overlap) % np.uint64(EACH) == 0) & (np.arange(n) + overlap <= behind)
    start = np.flatnonzero(first | window)
    stop = np.minimum(np.append(start[1:], n) + overlap, behind[start])
    closes = np.append(first[start[1:]], True)  # the last one of its piece has all its words to itself
    stop = np.where(closes, behind[start], stop)
    # all words with one blank behind each
    size = end - begin + 1
    at = np.concatenate([[0], np.cumsum(size)])
    joined = np.full(at[-1], 32, np.uint8)
    inside = np.flatnonzero(kind == 0)
    joined[np.arange(len(inside)) + np.repeat(np.arange(n), end - begin)] = data[inside]
    text = np.searchsorted(np.cumsum([len(x) + 1 for x in texts]), begin[start], side="right")
    return _sliced(joined, at[start], at[stop] - 1), np.where(closes, stop - start, stop - start - overlap), text


def dictionary(docs: DataFrame, most: int = 5) -> DataFrame:
    """lang, chunk, starts, n: the distinct chunks of each language, and how often they stand in the parse."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(langs: list, texts: list[bytes]) -> pa.RecordBatch:
            chunks, starts, text = cut_chunks(texts, most - 1)
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(text)), chunks, pa.array(starts, pa.int32())], names=["lang", "chunk", "starts"])

        langs, texts, size = [], [], 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                for run in _pieces_runs(text.as_py() or b""):
                    if texts and size + len(run) >= RUN:
                        yield flush(langs, texts)
                        langs, texts, size = [], [], 0
                    langs.append(lang.as_py())
                    texts.append(run)
                    size += len(run) + 1
        if texts:
            yield flush(langs, texts)

    chunks = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").mapInArrow(step, "lang string, chunk binary, starts int")
    return chunks.groupBy("lang", "chunk", "starts").agg(F.count("*").alias("n"))


class Filter:
    """Hashes in a table of bits: says yes to all that are in it, and to few others."""

    def __init__(self, frequent: DataFrame):
        """frequent: a column h. The table has 2^27 bits (16 MB) at most, whatever the number of hashes."""
        bits = min(MOST_BITS, max(10, (frequent.count() * BITS_EACH).bit_length()))
        place = F.expr(f"h & {(1 << bits) - 1}L")
        rows = frequent.select((place.bitwiseAND(F.lit(63))).alias("bit"), F.shiftright(place, 6).alias("word")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits")).toArrow()
        table = np.zeros(1 << max(0, bits - 6), np.uint64)
        table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        self.mask, self.table = np.uint64((1 << bits) - 1), table

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & self.mask
        return (self.table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Entries of the dictionary, a run at once."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch.column("chunk").nbytes
        if size > RUN:
            yield pa.Table.from_batches(some)
            some, size = [], 0
    if some:
        yield pa.Table.from_batches(some)


def _phrases(table: pa.Table, most: int, filters: list, lengths: list[int]):
    """Of each length the hashes, counts and words (first, behind the last) of the phrases whose parts pass the filters;
    a hash comes once. Also the bytes and the words' begins and ends."""
    column = table.column("chunk").combine_chunks()
    column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"\n".join(column.to_pylist()) + b"\n", np.uint8)
    kind = KIND[data]
    begin, end, words = _words(data, kind)
    entry = np.searchsorted(np.cumsum(sizes + 1), begin, side="right")
    langs = table.column("lang").combine_chunks().dictionary_encode()
    langs = langs if isinstance(langs, pa.Array) else pa.chunked_array(langs.chunks).unify_dictionaries().combine_chunks()
    seeds = np.array([int.from_bytes(x.encode(), "little") % (1 << 61) for x in langs.dictionary.to_pylist()], np.uint64)
    words = _mixed(words ^ (_mixed(seeds * STEP) * NEXT)[langs.indices.to_numpy()][entry])
    per_entry = np.bincount(entry, minlength=len(sizes))
    behind = np.cumsum(per_entry)
    place = np.arange(len(words)) - (behind - per_entry)[entry]
    own = place < table.column("starts").to_numpy()[entry]
    weights = table.column("n").to_numpy()[entry]
    left = behind[entry] - np.arange(len(words))  # words from here to the entry's end
    passes, grams, out = np.ones(len(words), bool), words, {}
    for n in range(1, most + 1):
        if n > 1:
            grams = grams.copy()
            grams[: 1 - n] = _mixed(grams[: 1 - n] * STEP + words[n - 1 :])
            passes = passes & np.append(passes[1:], False) & (left >= n)
        if n <= len(filters):
            known = np.flatnonzero(passes)
            passes = np.zeros(len(words), bool)
            passes[known[filters[n - 1](grams[known])]] = True
        if n in lengths:
            at = np.flatnonzero(passes & own)
            order = at[np.argsort(grams[at], kind="stable")]
            keys = grams[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            out[n] = (keys[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0], order[first], entry[order[first]])
        if n == max(lengths):
            break
    return out, data, begin, end


def _summed(parts) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.Array]]]:
    """Parts (hashes, counts, columns), with those of equal hashes summed up as long as they are not too many."""

    def flush(some: list) -> tuple:
        h, count = (np.concatenate([x[k] for x in some]) for k in (0, 1))
        order = np.argsort(h)
        first = np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]]])) if len(h) else np.zeros(0, np.int64)
        columns = [pa.concat_arrays([x[2][k] for x in some]).take(pa.array(order[first])) for k in range(len(some[0][2]))]
        return h[order[first]], np.add.reduceat(count[order], first) if len(first) else count, columns

    some, size = [], 0
    for part in parts:
        some.append(part)
        size += len(part[0])
        if size > SUMMED:
            some = [flush(some)]
            if len(some[0][0]) > SUMMED // 2:
                yield some.pop()
            size = len(some[0][0]) if some else 0
    if some:
        yield flush(some)


def _count_hashes(entries: DataFrame, n: int, filters: list, least: int) -> DataFrame:
    """h: the hashes of phrases of n words that may be frequent and stand ``least`` times or more."""
    shared = entries.sparkSession.sparkContext.broadcast(filters)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (_phrases(table, n, shared.value, [n])[0][n][:2] for table in _entries(batches))
        for h, count, _ in _summed((h & COUNTED, count, []) for h, count in found):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(count)], names=["h", "n"])

    return entries.mapInArrow(step, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h")


def frequent_phrases(entries: DataFrame, most: int = 5, least: int = 100) -> DataFrame:
    """lang, phrase (words joined by one space), words, f: all phrases of up to ``most`` words that stand ``least`` times
    or more in a language, with exact counts. entries: a written table, as dictionary makes it."""
    spark, filters, paths = entries.sparkSession, [], []
    for n in range(1, most + 1):
        paths.append(new_path(spark, "phrase-hashes"))
        filters.append(Filter(written_at(_count_hashes(entries, n, filters, least), paths[-1])))
    shared = spark.sparkContext.broadcast(filters)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for table in _entries(batches):
            found, data, begin, end = _phrases(table, most, shared.value, list(range(1, most + 1)))
            langs = table.column("lang").combine_chunks()
            for n, (h, count, first, entry) in found.items():
                yield h, count, [langs.take(pa.array(entry)), _sliced(data, begin[first], end[first + n - 1]).cast(pa.string()), pa.array(np.full(len(first), n, np.int32))]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, count, columns in _summed(texts(batches)):
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count)], names=["lang", "phrase", "words", "n"])

    counted = entries.mapInArrow(step, "lang string, phrase string, words int, n long").groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.sum("n").alias("f"))
    out = written_at(counted.where(F.col("f") >= least), new_path(spark, "phrases"))
    removed(spark, *paths)
    return out


def collocations(docs: DataFrame, most: int = 5, least: int = 100, contained: int = 100) -> DataFrame:
    """lang, phrase, a, l, r, n, score of all phrases of 2 to ``most`` words that stand ``least`` times or more.

    A-Z count as a-z, pieces end at [.,;:!?\\x0A-\\x0D], words are [^\\x20\\x09]+; a phrase stands inside a piece. n: all
    words of the language, a: occurrences of the phrase, overlapping ones included. Of its cuts in two, with l and r
    occurrences of the parts, the one with the least floor(1000 a n / (l r)) counts, of equals the first. A phrase that
    stands inside a longer one with 100 f(longer) >= ``contained`` a is left out.

    Null languages are `und`, null and empty texts hold nothing; each row counts, repeated ones too; no other column is
    read. Products are decimals of 38 digits. Broadcast: filters of 16 MB at most for each length.
    """
    spark = docs.sparkSession
    path = new_path(spark, "chunks")
    entries = written_at(dictionary(docs, most), path)
    phrases = frequent_phrases(entries, most, least)
    totals = written_at(entries.groupBy("lang").agg(F.sum(F.col("starts") * F.col("n")).alias("n")), new_path(spark, "words"))
    removed(spark, path)
    counts = phrases.select("lang", "phrase", "f")
    found = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("ws"))
    cuts = found.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("ws", 1, F.col("k")), " ").alias("left"), F.array_join(F.slice("ws", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    scored = cuts.join(totals, "lang").withColumn("score", F.expr("(cast(a as decimal(38,0)) * n * 1000) div (cast(l as decimal(38,0)) * r)"))
    least_cut = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("m")).select("lang", "phrase", "m.a", "m.l", "m.r", "m.n", "m.score")
    inside = found.select("lang", "words", "ws", F.col("a").alias("longer"), F.explode(F.expr("sequence(2, words - 1)")).alias("size")).where("words > 2")
    inside = inside.select("lang", "longer", F.explode(F.expr("transform(sequence(1, words - size + 1), i -> array_join(slice(ws, i, size), ' '))")).alias("phrase"))
    longest = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = least_cut.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a")))
    return kept.drop("longer")


def top_collocations(found: DataFrame, top: int = 2000) -> DataFrame:
    """The first ``top`` of each language, ranked from 1 by score, then a (both descending), then phrase by its bytes."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order))
    some = found.withColumn("rank", part).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")
    return top_collocations(collocations(docs)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
grouped AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws, count(*) AS times FROM pieces GROUP BY 1, 2),
totals AS (SELECT lang, sum(len(ws) * times)::HUGEINT AS n FROM grouped GROUP BY lang),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase, times
  FROM grouped, (SELECT unnest(range(1, 6)) AS size) s WHERE len(ws) >= size),
counts AS (SELECT lang, size, phrase, sum(times)::HUGEINT AS f FROM grams GROUP BY ALL HAVING sum(times) >= 100),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, string_split(c.phrase, ' ') AS ws, c.size FROM counts c, (SELECT unnest(range(1, 5)) AS k) s WHERE k < c.size),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, t.n, 1000 * c.a * t.n // (x.f * y.f) AS score, k
  FROM cuts c JOIN totals t ON c.lang = t.lang
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1:], ' ')),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM least s WHERE NOT EXISTS (
    SELECT 1 FROM counts b WHERE b.lang = s.lang AND b.size > len(string_split(s.phrase, ' ')) AND 100 * b.f >= 100 * s.a
      AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
