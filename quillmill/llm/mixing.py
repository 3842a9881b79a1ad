"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Only DataFrame functions run here. A source may hold any part of the rows: no window or join key is a source alone
except over per-source or per-bucket sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .scratch import written

#: (sqrt(5) - 1) / 2: the fractional parts of its multiples are a low-discrepancy sequence.
GOLDEN = 0.6180339887498949
WORDS = r"[^\x20\x09-\x0D]+"
#: Buckets of the unit interval by which points and sources meet; a power of two keeps their borders exact.
CELLS = 4096
#: Slots ranked, and documents summed up, by one task at most (about).
CHUNK = 8192
#: Slot numbers from one point to the next: room for slots that are added behind it.
BESIDE = 1 << 20


def word_count(text: Column) -> Column:
    """Number of runs of other characters than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float, weights: tuple[float, ...], cap: float) -> DataFrame:
    """One row per source: index, size, documents, target, and the end of what the mix takes: the target in whole words.

    The whole mix is ``share`` times all sizes, dealt by weight; no target is above ``cap`` times its source's size,
    and what is above goes to the others by weight. That is a water level: sources in order of cap / weight are
    full up to the first whose cap lies above the level of the rest.

    Windows over the sources take one task, with a row for each source: they serve for some millions of sources.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    by_level = W.orderBy(F.col("limit") / F.col("weight"), "sid")
    before, after = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    everywhere = W.orderBy("sid").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        by_source.withColumn("sid", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * F.lit(float(cap)))
        .withColumn("level", (F.sum("source_size").over(everywhere) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
        .withColumn("water", F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), F.col("sid"), F.col("level")))).over(everywhere)["level"])
        .withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.least("limit", F.col("water") * F.col("weight"))))
        .withColumn("block", F.greatest(F.lit(1), F.least(F.lit(4096), F.floor(F.sum("target").over(everywhere) / (2000 * F.count("*").over(everywhere))))).cast("long"))
        .withColumn("to", F.sum("target").over(W.orderBy("sid")))
        .withColumn("total", F.sum("target").over(everywhere))
        .withColumn("end", F.least(F.round("target"), F.floor(F.col("source_size") * F.lit(float(cap)))).cast("long"))
        .select("source", "sid", "source_size", "n_docs", "target", "block", "end", (F.col("to") - F.col("target")).alias("lo"), F.col("to").alias("hi"), "total")
    )


def schedule(sources: DataFrame) -> DataFrame:
    """The slots in the order of the mix: slot, sid and rank (which of its source's blocks the slot takes).

    Each source has as many slots as blocks up to its end. Where more points fall into its interval, the last of them
    take nothing; where fewer do, slots are added at even distances, counted from a place of the source's own, behind
    the points' slots there. Slots ascend, with gaps.
    """
    spark = sources.sparkSession
    n_slots, n_sources = sources.agg(F.max(F.ceil(F.col("total") / F.col("block"))), F.count("*")).first()
    cell = lambda x: F.floor(x * CELLS)
    lo, hi = F.col("lo") / F.col("total"), F.col("hi") / F.col("total")
    #: The last source's interval is open above, so that rounding leaves no point outside.
    spans = sources.where("hi > lo").select("sid", lo.alias("lo"), F.when(F.col("hi") >= F.col("total"), F.lit(2.0)).otherwise(hi).alias("hi"), F.explode(F.sequence(cell(lo), F.least(cell(hi), F.lit(CELLS - 1)))).alias("cell"))
    point = F.col("id") * F.lit(GOLDEN)
    points = spark.range(int(n_slots or 0)).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("point"))
    hit = points.withColumn("cell", cell(F.col("point"))).join(spans, "cell").where("point >= lo and point < hi").select((F.col("slot") * BESIDE).alias("slot"), "sid")
    blocks = sources.select("sid", F.ceil(F.col("end") / F.col("block")).alias("blocks")).where("blocks > 0")
    missing = blocks.join(hit.groupBy("sid").agg(F.count("*").alias("hits")), "sid", "left").withColumn("missing", F.col("blocks") - F.coalesce("hits", F.lit(0))).where("missing > 0")
    place = F.col("sid") * F.lit(GOLDEN) + (F.col("k") + F.lit(0.5)) / F.col("missing")
    added = missing.withColumn("k", F.explode(F.expr("sequence(0L, missing - 1)"))).select("sid", "k", F.floor((place - F.floor(place)) * F.lit(int(n_slots or 0))).alias("beside"))
    added = added.select((F.col("beside") * BESIDE + F.row_number().over(W.partitionBy("beside").orderBy("sid", "k"))).alias("slot"), "sid")
    slots = hit.unionByName(added).withColumn("chunk", F.floor(F.col("slot") / (CHUNK * BESIDE)))
    chunks = slots.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    starts = chunks.select("sid", "chunk", (F.sum("n").over(W.partitionBy("sid").orderBy("chunk")) - F.col("n")).alias("from"))
    inside = F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = slots.withColumn("inside", inside).join(starts, ["sid", "chunk"]).select("slot", "sid", (F.col("from") + F.col("inside")).alias("rank"))
    return ranked.join(blocks, "sid").where("rank < blocks").select("slot", "sid", "rank")


def positions(sizes: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Each document's start within its source's words, the documents shuffled by a hash of their ids."""
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id"))
    docs = (
        sizes.join(sources.select(F.col("source").alias("s"), "sid", "source_size", "block", "end", "n_docs"), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("at", hashed)
        .withColumn("buckets", F.ceil(F.col("n_docs") / CHUNK))
        .withColumn("bucket", F.least(F.floor((F.col("at") / F.lit(2.0**64) + F.lit(0.5)) * F.col("buckets")), F.col("buckets") - 1))
    )
    sums = docs.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    starts = sums.select("sid", "bucket", (F.sum("n").over(W.partitionBy("sid").orderBy("bucket")) - F.col("n")).alias("from"))
    inside = F.sum("size").over(W.partitionBy("sid", "bucket").orderBy("at", "doc_id", "size", "rid").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    return docs.withColumn("inside", inside).join(starts, ["sid", "bucket"]).select("rid", "sid", "size", "source_size", "block", "end", (F.col("from") + F.col("inside")).alias("start"))


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), cap: float = 2.0, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mixes documents (doc_id, source, text); returns (sizes, sources, pieces).

    pieces is the mix: ordered by slot and start, each row says that the mix takes ``words`` words of document ``rid``
    from word ``start`` of its source's shuffled words. A source whose target is more words than it has begins again, up
    to ``cap`` times. Blocks have equal numbers of words: 4,096, or less where the whole mix is small, but for the last
    of each source, which ends at the target: every source gives its target in whole words, however small it is.

    A null or empty text has size 0 and gives no piece. A null source is a source of its own, after all others. Null
    and repeated ids are allowed: rows are told apart by ``rid``, which is no part of the order but between rows that
    equal each other in id, source and size. An empty table gives empty frames. Further columns are ignored.
    """
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("rid", F.monotonically_increasing_id()), "mix-sizes")
    sources = written(source_targets(sizes, share, weights, cap), "mix-sources")
    slots = schedule(sources)
    placed = positions(sizes, sources, seed).where("size > 0 and end > 0")
    rounds = placed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.floor((F.col("end") - 1) / F.col("source_size")).cast("int"))))
    first = F.col("start") + F.col("turn") * F.col("source_size")
    spans = rounds.select("rid", "sid", "block", first.alias("lo"), F.least(first + F.col("size"), F.col("end")).alias("hi")).where("lo < hi")
    blocks = spans.withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / F.col("block")), F.floor((F.col("hi") - 1) / F.col("block")))))
    lo, hi = F.greatest("lo", F.col("rank") * F.col("block")), F.least("hi", (F.col("rank") + 1) * F.col("block"))
    pieces = blocks.withColumn("words", hi - lo).withColumn("start", lo).join(slots, ["sid", "rank"]).select("slot", "sid", "rank", "rid", "start", "words")
    return sizes, sources, pieces


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Per document of the mix: its size, its source's size and target, and the words that the mix takes of it."""
    sizes, sources, pieces = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = pieces.groupBy("rid").agg(F.sum("words").alias("taken"))
    per_source = sources.select(F.col("source").alias("s"), "source_size", "target")
    return (
        sizes.join(taken, "rid", "left")
        .join(per_source, F.col("source").eqNullSafe(F.col("s")))
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )
