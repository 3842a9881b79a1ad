"""Near-duplicate documents: an exact Jaccard join of word n-gram sets over prefix trees.

1. One pass cuts the documents into chunks, hashes each document's distinct n-grams, digests the set, and sends every
   chunk's n-grams, as sorted gaps of some two bytes, to buckets of hashes. A bucket sees all chunks: it answers each
   with the class of the count of every n-gram. Documents with equal sets are one class from here on.
2. A set linked to another at similarity t shares t n of its n-grams with it. So a set with fewer n-grams that other
   documents hold is out at once: most are. The others get one global order, by class of count, rare ones first, then
   by hash: two linked sets share a token among the first (1 - t) n + 1 of each. Sets that do are chained into blocks.
   A passage that many documents hold stands last in all of them and ties none together, unless most of the text is
   that passage.
3. Within a block, prefixes by exact counts leave groups of candidates; each group's sets go into a prefix tree, which
   links them exactly. Blocks above a size are joined in parts: each within, then through representatives of their
   classes; then whatever is not in its block's largest class meets the parts with which it shares a token.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .graph import components
from .prefix_tree import Links, build, join, probe
from .scratch import new_path, removed, written, written_at

#: Bits of a hash, below those that name its bucket, that tell n-grams apart when they are counted. Two n-grams that
#: agree in them count as one: such an error (under 1 %) can put a set among the candidates, never take one out.
KEPT = 28
#: Bytes of text for each bucket of hashes, as a power of two: some four million n-grams.
BUCKET_BYTES = 25
#: Bytes of text in a chunk, a longer text being one of its own: as many for each bucket, so that the gaps between a
#: chunk's n-grams in a bucket are as small where there are many buckets, from a least to a most size.
LEAST_BYTES, EACH_BYTES, MOST_BYTES = 1 << 21, 1 << 18, 1 << 22
#: Documents that share an n-gram meet under one of them by as many at once, as a power of two.
STAR = 12
#: Members of blocks that are sent to their sets (rows of some 50 bytes); beyond, both sides are shuffled.
MOST_SENT = 500_000
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256)
LOWER[65:91] += 32
BYTES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)[LOWER] * np.uint64(2) + np.uint64(1)
STEP, NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * NEXT
    h = (h ^ (h >> np.uint64(29))) * STEP
    return h ^ (h >> np.uint64(32))


#: Bytes whose words are hashed at once, a longer word being one run of its own.
RUN = 1 << 18


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of STEP, and of its inverse modulo 2^64."""
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base, np.uint64)])) for base in (STEP, np.uint64(pow(int(STEP), -1, 1 << 64))))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and their hashes; data ends with a blank. A word is a polynomial of its bytes, which a
    difference of running sums gives."""
    begins, hashes, lo = [], [], 0
    while lo < len(data):
        hi = min(lo + RUN, len(data))
        while not BLANK[data[hi - 1]]:
            more = np.flatnonzero(BLANK[data[hi : hi + RUN]])
            hi = hi + int(more[0]) + 1 if len(more) else min(hi + RUN, len(data))
        some = data[lo:hi]
        blank = BLANK[some]
        borders = np.flatnonzero(blank[1:] != blank[:-1]) + 1  # begins and ends by turns; the run ends with a blank
        if not blank[0]:
            borders = np.concatenate([[0], borders])
        if len(borders):
            power, inverse = _powers(max(RUN, 1 << (len(some) - 1).bit_length()))
            total = np.cumsum(BYTES[some] * power[: len(some)])
            first, last = borders[::2], borders[1::2]
            sums = total[last - 1] - np.where(first > 0, total[first - 1], np.uint64(0))
            begins.append(first + lo)
            hashes.append(_mixed(sums * inverse[first]))
        lo = hi
    return (np.concatenate(begins), np.concatenate(hashes)) if begins else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def ngrams(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The distinct hashes of the word n-grams of each text (UTF-8), ascending. Fewer words than n: one hash of them all."""
    if not texts:
        return []
    with np.errstate(over="ignore"):
        begin, words = _words(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8))
        borders = np.searchsorted(begin, np.cumsum([0, *(len(x) + 1 for x in texts)])).tolist()
        grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for j in range(n):
            grams = grams * STEP + words[j : len(words) - n + 1 + j] if len(grams) else grams
        grams = _mixed(grams)
        out = []
        for lo, hi in zip(borders[:-1], borders[1:]):
            if hi - lo >= n:
                some = np.sort(grams[lo : hi - n + 1])
                out.append(some[np.concatenate([[True], some[1:] != some[:-1]])])
            else:
                h = np.zeros(1, np.uint64)
                for w in words[lo:hi]:
                    h = h * STEP + w
                out.append(_mixed(h + np.uint64(hi - lo)) if hi > lo else np.zeros(0, np.uint64))
        return out


def digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def text_key(text: Column) -> Column:
    """A hash that tells the texts of rows with one doc_id apart."""
    return F.xxhash64(F.lit("text"), text).alias("text_key")


def _packed(data: bytes, level: int = 1) -> bytes:
    return pa.Codec("zstd", level).compress(data, asbytes=True)


def _unpacked(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)


def _chunks(batch: pa.RecordBatch, most: int):
    """Rows (doc_id, text) of a batch in bounded runs: (first row, texts as bytes)."""
    column = batch.column(1).cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    before, first = np.cumsum(sizes) - sizes, 0
    while first < batch.num_rows:
        end = max(first + 1, int(np.searchsorted(before, before[first] + most)))
        yield first, [x or b"" for x in column.slice(first, end - first).to_pylist()]
        first = end


def _keys(sets: list[np.ndarray], bits: int, **more) -> tuple:
    """Of all n-grams of a chunk the distinct hashes as they are counted, ascending, and what else numpy's unique tells."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return np.unique(flat >> np.uint64(64 - bits - KEPT), **more)


PROFILE = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("size", pa.int64()), ("digest", pa.binary()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])


def profile(docs: DataFrame, n: int, bits: int, path: str) -> DataFrame:
    """Three kinds of rows, written at a path: a document's set (bucket -2: doc_id, text_key, size, digest, chunk), a chunk's texts (bucket -1: one of
    each distinct set; n bytes of lengths and texts), and a chunk's n-grams in a bucket of hashes (n of them)."""

    def rows(parts):
        chunk, most = TaskContext.get().partitionId() << 32, min(MOST_BYTES, max(LEAST_BYTES, EACH_BYTES << bits))
        for batch in parts:
            for first, texts in _chunks(batch, most):
                ids = batch.column(0).slice(first, len(texts))
                sets = ngrams(texts, n)
                digests = [digest(s) if len(s) else None for s in sets]
                m = len(sets)
                yield pa.RecordBatch.from_arrays([ids, batch.column(2).slice(first, m), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([chunk] * m, pa.int64()), pa.array([-2] * m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], schema=PROFILE)
                once = list({d: k for k, (d, i) in enumerate(zip(digests, ids.is_valid().to_pylist())) if d is not None and i}.values())
                if once:
                    whole = np.array([len(once), *(len(texts[k]) for k in once)], "<u4").tobytes() + b"".join(texts[k] for k in once)
                    keys, counts = _keys([sets[k] for k in once], bits, return_counts=True)
                    place = np.flatnonzero(np.diff(keys >> np.uint64(KEPT), prepend=np.uint64(2**63)))
                    buckets, sizes, data = [-1], [len(whole)], [_packed(whole, 3)]
                    for lo, hi in zip(place, np.append(place[1:], len(keys))):
                        buckets.append(int(keys[lo] >> np.uint64(KEPT)))
                        sizes.append(int(hi - lo))
                        data.append(_bucket_data(keys[lo:hi] & np.uint64((1 << KEPT) - 1), counts[lo:hi]))
                    m = len(data)
                    yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array([chunk] * m, pa.int64()), pa.array(buckets, pa.int32()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], schema=PROFILE)
                chunk += 1

    return written_at(docs.mapInArrow(rows, "doc_id long, text_key long, size long, digest binary, chunk long, bucket int, n long, data binary"), path)


def _bucket_data(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as gaps, byte by byte of lower to higher order, and their counts."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u4")
    return _packed(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes() + np.minimum(counts, 65535).astype("<u2").tobytes())


def count_classes(table: pa.Table) -> pa.Table:
    """chunk, bucket, n, classes: of each of a chunk's n-grams in this bucket, the class of its count in all chunks: 0 for
    one, k for more than 2^(k-1) and up to 2^k."""
    sizes = table["n"].to_pylist()
    keys, counts = [], []
    for data, size in zip(table["data"], sizes):
        raw = _unpacked(data.as_py(), 6 * size)
        keys.append(np.cumsum(np.ascontiguousarray(np.frombuffer(raw[: 4 * size], np.uint8).reshape(4, size).T).view("<u4").ravel(), dtype=np.uint32))
        counts.append(np.frombuffer(raw[4 * size :], "<u2"))
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate(counts))
    classes = np.ceil(np.log2(total)).astype(np.uint8)[place]
    ends = np.cumsum(sizes)
    out = [_packed(classes[e - s : e].tobytes()) for e, s in zip(ends, sizes)]
    return pa.table([table["chunk"], table["bucket"], table["n"], pa.array(out, pa.binary())], names=["chunk", "bucket", "n", "classes"])


def possible_sets(rows: DataFrame, named: DataFrame, n: int, percent: int, bits: int) -> DataFrame:
    """digest, tokens (in the global order), prefix of the sets that may be linked: those with enough n-grams that other
    documents hold. prefix: the tokens of which linked sets share one, without those that no other has. Of a set that
    several chunks hold, the chunk that ``named`` says gives the row."""

    def choose(texts: pa.Table, answers: pa.Table) -> pa.Table:
        out = pa.schema([("digest", pa.binary()), ("tokens", pa.binary()), ("prefix", pa.list_(pa.int64()))])
        if not texts.num_rows:
            return out.empty_table()
        whole = _unpacked(texts["data"][0].as_py(), texts["n"][0].as_py())
        m = int(np.frombuffer(whole, "<u4", 1)[0])
        ends = np.cumsum(np.frombuffer(whole, "<u4", m, 4), dtype=np.int64) + 4 * (m + 1)
        sets = ngrams([whole[lo:hi] for lo, hi in zip([4 * (m + 1), *ends[:-1]], ends)], n)
        own_here = set(answers["digest"].drop_null().to_pylist())
        answers = answers.filter(pc.is_null(answers["digest"])).sort_by("bucket")
        classes = np.frombuffer(b"".join(_unpacked(d.as_py(), size) for d, size in zip(answers["classes"], answers["n"].to_pylist())), np.uint8)
        classes = classes[_keys(sets, bits, return_inverse=True)[1]].astype(np.uint64)
        found, at = [], 0
        for s in sets:
            own = classes[at : at + len(s)]
            at += len(s)
            need = -(-percent * len(s) // 100)
            if np.count_nonzero(own) >= need and (key := digest(s)) in own_here:
                tokens = np.sort(own << np.uint64(57) | s >> np.uint64(7))
                first = tokens[: len(s) - need + 1]
                found.append((key, tokens.tobytes(), first[first >= np.uint64(1 << 57)].view(np.int64)))
        if not found:
            return out.empty_table()
        digests, tokens, prefix = zip(*found)
        return pa.table([pa.array(digests, pa.binary()), pa.array(tokens, pa.binary()), pa.array(list(prefix), pa.list_(pa.int64()))], schema=out)

    counted = rows.where("bucket >= 0").select("chunk", "bucket", "n", "data").groupBy("bucket").applyInArrow(count_classes, "chunk long, bucket int, n long, classes binary")
    texts = rows.where("bucket = -1").select("chunk", "n", "data")
    answers = counted.withColumn("digest", F.lit(None).cast("binary")).unionByName(named.select("chunk", "digest"), allowMissingColumns=True)
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(choose, "digest binary, tokens binary, prefix array<long>")


def blocks_of(rows: DataFrame) -> DataFrame:
    """(half, block) of rows (token, half): sets of which some share a token, and whatever such sets chain together.

    A token's class, in its upper bits, says how many have it at most: those of a token with many are dealt into stars
    of 2^STAR, and the stars' centres meet.
    """
    most = F.shiftrightunsigned("token", 57)
    dealt = rows.withColumn("star", F.when(most > STAR, F.pmod(F.xxhash64("half"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(token, 57) as int) - {STAR})"))).otherwise(F.lit(0)))
    stars = dealt.withColumn("centre", F.min("half").over(W.partitionBy("token", "star")))
    edges = stars.where("half <> centre").select(F.col("half").alias("a"), F.col("centre").alias("b")).distinct()
    centres = stars.where(most > STAR).select("token", F.col("centre").alias("a")).distinct().withColumn("b", F.min("a").over(W.partitionBy("token")))
    return components(edges.union(centres.where("a <> b").select("a", "b"))).select(F.col("node").alias("half"), F.col("root").alias("block"))


def _candidates(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """Groups of sets, as their numbers, outside of which no two are similar: prefixes by exact counts among these sets."""
    tokens, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    inverse, counts = inverse.astype(np.int32), counts.astype(np.int32)
    del tokens
    order = np.lexsort((inverse, counts[inverse], owner))
    place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = order[place < np.repeat(sizes - -(-percent * sizes // 100) + 1, sizes)]
    kept = kept[counts[inverse[kept]] > 1]
    kept = kept[np.lexsort((owner[kept], inverse[kept]))]
    links = Links(len(sets))
    same = inverse[kept][1:] == inverse[kept][:-1]
    for a, b in set(zip(owner[kept][:-1][same].tolist(), owner[kept][1:][same].tolist())):
        links.join(a, b)
    roots = np.array([links.root(k) for k in range(len(sets))])
    order = np.argsort(roots, kind="stable")
    return [g for g in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1) if len(g) > 1]


def _join_block(sets: list[np.ndarray], percent: int) -> Links:
    """The classes of the sets of a block, from a prefix tree for each of its groups of candidates."""
    links = Links(len(sets))
    for group in _candidates(sets, percent) if len(sets) > 2 else [np.arange(len(sets))]:
        inner = join([sets[k] for k in group], percent)
        for k, i in enumerate(group):
            links.join(int(i), int(group[inner.root(k)]))
    return links


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in table["tokens"].to_pylist()]


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, part_size: int = 2048, part_tokens: int = 4_000_000, most_hot: int = 1000) -> DataFrame:
    """doc_id, n_shingles, component_id, representative, set, text_key and class of docs (doc_id, text), over whole texts.

    Words are runs of other characters than ASCII white space, A-Z in lower case. A document's set holds its distinct
    runs of ``n`` words; a text of fewer words is one such run. Sets link at Jaccard similarity percent / 100 or more;
    component_id is the smallest doc_id that links reach, the document's own included. representative: component_id
    equals doc_id. set: a digest of the document's set; class: a digest that names its component; text_key: see there.

    Null, empty and blank texts have no set, link with nothing, and are components of their own (set and class null).
    Rows with a null doc_id count for nothing and get a null component_id and class. Of rows that share a doc_id, each
    belongs to the component of its own text. Further columns are ignored; an empty table gives no rows.
    part_size, part_tokens: sets and their n-grams that one task joins at once; a longer set has a part of its own.
    most_hot: sets that more than one in so many rows hold, so many at most, are sent to those rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (size >> BUCKET_BYTES).bit_length())
    rows = profile(docs, n, bits, texts := new_path(spark, "ngram-profile"))
    known = written(rows.where("bucket = -2").select("doc_id", "text_key", "size", "digest", "chunk"), "ngram-known")
    named = written(known.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("size").alias("size"), F.min("chunk").alias("chunk"), F.count("*").alias("copies")), "ngram-named")
    sets = written(possible_sets(rows, named, n, percent, bits), "ngram-sets")
    removed(spark, texts)
    half = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long").alias("half")
    blocks = blocks_of(sets.select(F.explode("prefix").alias("token"), half))
    placed = written(named.select("digest", "rep", "size", half).join(blocks, "half").drop("half"), "ngram-blocks")
    sizes = placed.groupBy("block").agg(F.count("*").alias("n"), F.sum("size").alias("all"))
    parts = F.greatest(F.ceil(F.col("n") / part_size), F.ceil(F.col("all") / part_tokens)).cast("int")
    members = written(placed.join(sizes.where("n > 1").select("block", parts.alias("parts")), "block").withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")), "ngram-members")
    classes = _classes(members, sets, percent, part_size)

    # the smallest doc_id of each class; a class may hold any share of all rows
    salt = F.pmod(F.xxhash64("digest"), F.lit(16)).cast("int")
    joined = classes.join(placed.select("digest", "rep"), "digest").withColumn("salt", salt)
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    linked = joined.join(least, ["root", "salt"]).select("digest", "root", "component_id")
    found = named.join(linked, "digest", "left").select("digest", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("root", "digest").alias("class"), "copies")
    found = written(found, "ngram-found")
    # there are most_hot of these sets at most: the documents that hold them stay where they are
    often = (found.agg(F.sum("copies")).first()[0] or 0) // most_hot
    hot = F.broadcast(found.where(F.col("copies") > often).select("digest", F.col("component_id").alias("hot_id"), F.col("class").alias("hot_class")))
    near = known.join(hot, "digest", "left")
    plain = F.col("hot_id").isNull() & F.col("digest").isNotNull()
    rest = near.where(plain).join(found.where(F.col("copies") <= often), "digest", "left").select("doc_id", "text_key", "size", "digest", "component_id", "class")
    there = near.where(~plain).select("doc_id", "text_key", "size", "digest", F.col("hot_id").alias("component_id"), F.col("hot_class").alias("class"))
    mine = F.col("doc_id").isNotNull()
    component = F.when(mine, F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return rest.union(there).select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("representative"), F.col("digest").alias("set"), "text_key", F.when(mine, F.col("class")).alias("class"))


def _classes(members: DataFrame, sets: DataFrame, percent: int, part_size: int) -> DataFrame:
    """digest, root (the smallest digest of its class) of the members of all blocks."""

    def within(table: pa.Table) -> pa.Table:
        """Joins each block in a bundle of small ones, or a part of a large one."""
        out = []
        table = table.sort_by([("block", "ascending"), ("digest", "ascending")])
        block = table["block"].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            some = table.slice(lo, hi - lo)
            ids, links = some["digest"].to_pylist(), _join_block(_sets(some), percent)
            out += [(some["block"][0].as_py(), i, ids[links.root(k)]) for k, i in enumerate(ids)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], names=["block", "digest", "root"])

    schema = "block long, digest binary, root binary"
    count, total = members.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bundle = F.when(F.col("parts") > 1, F.xxhash64("block", "part")).otherwise(F.pmod(F.xxhash64("block"), F.lit(max(1, total // 500_000))))
    placed = members.select("digest", "block", bundle.alias("bundle"))
    dealt = sets.select("digest", "tokens").join(F.broadcast(placed) if count <= MOST_SENT else placed, "digest")
    local = written(dealt.select("bundle", "block", "digest", "tokens").groupBy("bundle").applyInArrow(within, schema), "ngram-local")
    large = members.where("parts > 1")
    if large.isEmpty():
        return local.select("digest", "root")
    large = written(large.join(sets, "digest").select("block", "parts", "part", "digest", "size", "tokens", "prefix"), "ngram-large")

    # parts meet through their classes' roots, in groups of bounded size
    heads = local.where("digest = root").select("digest").join(large, "digest")
    per_block = heads.groupBy("block").agg(F.count("*").alias("heads"), F.sum("size").alias("all"))
    groups = F.greatest(F.ceil(F.col("heads") / part_size), F.ceil(F.col("all") / (part_size * 2000)))
    met = heads.join(per_block, "block").withColumn("group", F.pmod(F.xxhash64("digest", F.lit(1)), groups)).select("block", "group", "digest", "tokens").groupBy("block", "group").applyInArrow(within, schema)
    ends = [F.col("digest").alias("a"), F.col("root").alias("b")]
    edges = written(local.select(*ends).union(met.select(*ends)), "ngram-links")
    so_far = components(edges).select(F.col("node").alias("digest"), "root")

    # what is not in the largest class of its block meets the parts in which a set shares a token of its prefix
    marked = written(large.join(so_far, "digest", "left").withColumn("root", F.coalesce("root", "digest")), "ngram-classes")
    largest = marked.groupBy("block", "root").agg(F.count("*").alias("n")).groupBy("block").agg(F.max_by("root", F.struct("n", "root")).alias("largest"))
    rest = marked.join(largest, "block").where("root <> largest").drop("largest")
    there = marked.select("block", "part", F.explode("prefix").alias("token")).distinct()
    meets = rest.select("block", "digest", F.explode("prefix").alias("token")).join(there, ["block", "token"]).select("block", "part", "digest").distinct()
    meets = written(meets, "ngram-meets")
    chunks = F.ceil(F.col("n") / part_size)
    per_part = meets.groupBy("block", "part").agg(F.count("*").alias("n")).select("block", "part", chunks.alias("chunks"))
    columns = ["block", "part", "chunk", "digest", "root", "tokens"]
    asking = meets.join(per_part, ["block", "part"]).withColumn("chunk", F.pmod(F.xxhash64("digest", F.lit(2)), F.col("chunks"))).join(rest.select("digest", "root", "tokens"), "digest").select(*columns)
    targets = marked.join(per_part, ["block", "part"]).withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)"))).select(*[F.col(c).alias(c) for c in columns])

    def across(probes: pa.Table, part: pa.Table) -> pa.Table:
        out = pa.schema([("a", pa.binary()), ("b", pa.binary())])
        if not probes.num_rows or not part.num_rows:
            return out.empty_table()
        ids = part["digest"].to_pylist() + probes["digest"].to_pylist()
        links, first = Links(len(ids)), {}
        for k, root in enumerate(part["root"].to_pylist() + probes["root"].to_pylist()):
            links.join(k, first.setdefault(root, k))
        sets, pairs, n = _sets(part) + _sets(probes), [], part.num_rows
        for group in _candidates(sets, percent):
            stored, asked = group[group < n], group[group >= n]
            if not len(stored) or not len(asked):
                continue
            tree = build([sets[k] for k in stored], stored.tolist())
            for k in asked.tolist():
                pairs += [(ids[k], ids[j]) for j in probe(tree, sets[k], k, links, None, percent)]
        return pa.table([pa.array(c, pa.binary()) for c in zip(*pairs)], schema=out) if pairs else out.empty_table()

    keys = ["block", "part", "chunk"]
    last = asking.groupBy(*keys).cogroup(targets.groupBy(*keys)).applyInArrow(across, "a binary, b binary")
    joined = components(edges.union(last)).select(F.col("node").alias("digest"), "root")
    return joined.union(local.where("digest = root").select("digest", "root")).groupBy("digest").agg(F.min("root").alias("root"))


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
