"""Benchmark passages in documents: q-gram lemma, diagonal bands, banded alignment.

An item of m characters that stands in a text with at most k edits shares at least m - q + 1 - kq of its q-grams with
it, all near one diagonal (place in the text less place in the item). Shared q-grams are counted in overlapping bands
of diagonals; bands that reach the bound are aligned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIME = np.uint64(0x9E3779B97F4A7C15)
REGIONS = "doc_id long, item_id long, start long, end long, distance int"


def normalised(text: str | None) -> str:
    """Lower case, each run of white space one space, none at the ends. Spans count characters of this text."""
    return " ".join((text or "").lower().split())


def gram_hashes(flat: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q code points from each place on, by doubling."""
    if len(flat) < q:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, width = PRIME, 1
        hashes = flat.astype(np.uint64) + np.uint64(1)
        out, taken = None, 0
        while True:
            if q & width:  # append this power of two's block to what is there
                n = len(flat) - taken - width + 1
                block = hashes[taken : taken + n]
                out = block if out is None else out[:n] * power + block
                taken += width
            if taken == q:
                return out * PRIME
            hashes = hashes[:-width] * power + hashes[width:]
            power, width = power * power, width * 2


def align(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Fewest edits of the item against any stretch of the text, within the diagonals low to high: (edits, start, end)."""
    if len(item) <= len(text):  # no edit at all: the first characters say where
        for d in np.flatnonzero(text[: len(text) - len(item) + 1] == item[0]):
            if low <= d <= high and (text[d : d + len(item)] == item).all():
                return 0, int(d), int(d) + len(item)
    diagonals = np.arange(low, high + 1)
    far = 1 << 20
    row = np.where((diagonals >= 0) & (diagonals <= len(text)), 0, far)
    begin = diagonals.copy()
    steps = np.arange(len(diagonals))
    for i in range(len(item)):
        at = i + diagonals
        ok = (at >= 0) & (at < len(text))
        same = np.zeros(len(at), bool)
        same[ok] = text[at[ok]] == item[i]
        best = np.where(ok, row + ~same, far)
        origin = begin
        down = np.append(row[1:], far) + 1  # the item's character has no partner; i + 1 + d' = i + d for d' = d - 1
        take = down < best
        best = np.where(take, down, best)
        origin = np.where(take, np.append(begin[1:], 0), origin)
        # characters of the text without a partner: from any diagonal to the left, one edit for each step
        level = best - steps
        least = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == least, steps, 0))
        row, begin = least + steps, origin[source]
        row[(at + 1 < 0) | (at + 1 > len(text))] = far
    k = int(row.argmin())
    return int(row[k]), int(begin[k]), len(item) + int(diagonals[k])


@dataclass
class Items:
    """The q-grams of a slice of benchmark items, sorted by hash."""

    q: int
    ids: list[int]
    texts: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    grams: np.ndarray  # distinct hashes, ascending
    first: np.ndarray  # of each hash in item and place; one more at the end
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray  # by the top bits of a hash: whether any gram has them

    @staticmethod
    def of(rows: list[tuple[int, str]], q: int, share: float, often: int) -> Items | None:
        """Grams that stand more than ``often`` times in the items are left out where the bound holds without them.

        An edit spoils at most q of the item's grams, of whatever kind, so the bound is the number of an item's grams
        that are looked at, less kq.
        """
        kept = [(i, np.frombuffer(t.encode("utf-32-le"), np.uint32)) for i, t in rows if len(t) >= q]
        if not kept:
            return None
        hashes = [gram_hashes(t, q) for _, t in kept]
        values, counts = np.unique(np.concatenate(hashes), return_counts=True)
        common = values[counts > often]
        edits, bound, used = [], [], []
        for (_, t), h in zip(kept, hashes):
            k = int(share * len(t))
            rare = ~np.isin(h, common)
            if rare.sum() - k * q < max(1, len(h) // 10):
                rare[:] = True
            k = min(k, (len(h) - 1) // q)
            edits.append(k)
            used.append(rare)
            bound.append(max(1, int(rare.sum()) - k * q))
        place = np.concatenate([np.flatnonzero(u) for u in used])
        item = np.repeat(np.arange(len(kept)), [u.sum() for u in used])
        h = np.concatenate([x[u] for x, u in zip(hashes, used)])
        order = np.argsort(h, kind="stable")
        grams, first = np.unique(h[order], return_index=True)
        table = np.zeros(1 << 22, bool)
        table[grams >> np.uint64(42)] = True
        return Items(q, [i for i, _ in kept], [t for _, t in kept], np.array(edits), np.array(bound), grams, np.append(first, len(h)), item[order], place[order], table)

    def hits(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, item, place in the item) of all shared grams."""
        hashes = gram_hashes(flat, self.q)
        at = np.flatnonzero(self.table[hashes >> np.uint64(42)])
        k = np.searchsorted(self.grams, hashes[at])
        k[k == len(self.grams)] = 0
        real = self.grams[k] == hashes[at]
        at, k = at[real], k[real]
        n = self.first[k + 1] - self.first[k]
        index = np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        return np.repeat(at, n), self.item[index], self.place[index]

    def regions(self, flat: np.ndarray, borders: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) in texts that lie end to end; borders: where they begin, and the end."""
        at, item, place = self.hits(flat)
        if not len(at):
            return []
        text = np.searchsorted(borders, at, "right") - 1
        # an item that shares too few grams with a whole text shares too few with any band of it
        pair = text * len(self.texts) + item
        enough = np.bincount(pair, minlength=1)[pair] >= self.bound[item]
        at, item, place, text = at[enough], item[enough], place[enough], text[enough]
        if not len(at):
            return []
        diagonal = at - place
        width = 2 * self.edits[item] + 16
        band = diagonal // width
        # bands overlap: a run of diagonals as wide as the edits lies whole in one band of either series
        second = (diagonal + width // 2) // width
        found, aligned = set(), set()
        for b in (band, second):
            order = np.lexsort((b, item, text))
            key = np.stack([text[order], item[order], b[order]])
            new = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
            # distinct places of the item: a gram that repeats in the text counts once
            size = np.diff(np.append(new, len(order)))
            for lo, n in zip(new[enough := size >= self.bound[item[order[new]]]], size[enough]):
                some = order[lo : lo + n]
                t, i = int(text[some[0]]), int(item[some[0]])
                if len(np.unique(place[some])) < self.bound[i]:
                    continue
                k = int(self.edits[i])
                low, high = int(diagonal[some].min()) - k, int(diagonal[some].max()) + k
                begin = max(int(borders[t]), low - k)
                end = min(int(borders[t + 1]), high + len(self.texts[i]) + k)
                if (t, i, low, high) in aligned:  # the bands of both series hold it
                    continue
                aligned.add((t, i, low, high))
                edits, start, stop = align(self.texts[i], flat[begin:end], low - begin, high - begin)
                if edits <= k:
                    found.add((t, i, begin + start - int(borders[t]), begin + stop - int(borders[t]), edits))
        return sorted(found)


def contaminated_regions(docs: DataFrame, benchmark: DataFrame, q: int = 8, share: float = 0.1, often: int = 8, slice_chars: int = 4_000_000, window: int = 400_000) -> DataFrame:
    """doc_id, item_id, start, end, distance: where a benchmark item stands in a document with at most ``share`` edits.

    Both texts are normalised. Items are sent to the executors in slices of ``slice_chars`` characters at most (one
    item at least), whatever the benchmark's size: each slice is one pass over the documents. Of an item's regions that
    overlap each other in a document, that with the fewest edits is returned, the first of those that tie.

    The edit budget of an item of m characters is the largest k <= share * m for which the q-gram bound is 1 at least;
    items shorter than q characters, null or empty ones match nothing. Null and empty documents give no row; documents
    with a null or repeated id give their own rows. Further columns are ignored.
    """
    sizes = benchmark.where("text is not null and item_id is not null").select("item_id", "text", F.length("text").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    n_slices = -(-total // slice_chars)
    out = None
    for k in range(n_slices):
        rows = [(r[0], normalised(r[1])) for r in sizes.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_slices)) == k).orderBy("item_id", "text").select("item_id", "text").collect()]
        items = Items.of(rows, q, share, often)
        if items is None:
            continue
        part = _regions(docs, items, window)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], REGIONS)


def _regions(docs: DataFrame, items: Items, window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    overlap = max(len(t) + 2 * int(k) + 32 for t, k in zip(items.texts, items.edits))

    def pieces(batch):
        """Texts, the long ones in windows that overlap by more than any region: (doc_id, row, offset, code points)."""
        for k in range(0, batch.num_rows, 200):
            some = batch.slice(k, 200)
            for row, (doc_id, text) in enumerate(zip(some.column(0).to_pylist(), some.column(1).to_pylist())):
                flat = np.frombuffer(normalised(text).encode("utf-32-le", "surrogatepass"), np.uint32)
                for at in range(0, max(1, len(flat) - overlap), window):
                    yield doc_id, k + row, at, flat[at : at + window + overlap]

    def groups(batch, most: int = 400_000):
        some, n = [], 0
        for piece in pieces(batch):
            some.append(piece)
            n += len(piece[3])
            if n >= most:
                yield some
                some, n = [], 0
        if some:
            yield some

    def scan(parts):
        items = shared.value
        for batch in parts:
            found: dict[tuple, list] = {}
            for some in groups(batch):
                gap = np.zeros(1, np.uint32)  # a code point that no text has keeps grams within their text
                flat = np.concatenate([x for p in some for x in (p[3], gap)])
                borders = np.concatenate([[0], np.cumsum([len(p[3]) + 1 for p in some])])
                for t, i, start, end, edits in items.regions(flat, borders):
                    doc_id, row, offset, _ = some[t]
                    found.setdefault((row, doc_id, items.ids[i]), []).append((edits, start + offset, end + offset))
            rows = []
            for (_, doc_id, item_id), regions in found.items():
                kept: list[tuple] = []
                for edits, start, end in sorted(regions):
                    if all(end <= a or start >= b for _, a, b in kept):
                        kept.append((edits, start, end))
                rows += [(doc_id, item_id, start, end, edits) for edits, start, end in kept]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), [pa.int64()] * 4 + [pa.int32()])], ["doc_id", "item_id", "start", "end", "distance"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(scan, REGIONS)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every region of a document that holds a benchmark item."""
    return contaminated_regions(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
