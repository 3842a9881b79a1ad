"""Hashed embeddings, vector queries, and hybrid ranking."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from quillmill.functions import constants as C
from quillmill.functions.batches import pieces

from .archive import Archive


#: Tokens that a Python worker takes at a time, and one row more.
PIECE_TOKENS = 1 << 18


def embed(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """key, vector: each token adds or takes one at a slot that its SHA-256 names; unit length, zero stays zero.

    A row's vector comes from the row alone; of each piece of a batch of rows, every distinct token is hashed once.
    """
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(C.EMBEDDING_TOKEN), 0)
    listed = df.select(F.col(key).alias("key"), tokens.alias("tokens"))
    kind = listed.schema["key"].dataType.simpleString()

    def hashed(parts):
        for batch in (x for whole in parts for x in pieces(whole, whole.column(1).value_lengths().to_numpy(zero_copy_only=False), PIECE_TOKENS)):
            words = batch.column(1).flatten().dictionary_encode()
            sums = np.zeros((batch.num_rows, dim))
            if len(words):
                digests = [hashlib.sha256(w.encode("utf-8", "surrogatepass")).digest() for w in words.dictionary.to_pylist()]
                slot = np.array([int.from_bytes(d[:4], "big") % dim for d in digests])
                sign = np.array([1.0 if d[4] % 2 == 0 else -1.0 for d in digests])
                code = words.indices.to_numpy(zero_copy_only=False)
                size = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                flat = np.repeat(np.arange(batch.num_rows), size) * dim + slot[code]
                sums = np.bincount(flat, sign[code], batch.num_rows * dim).reshape(-1, dim)
            norm = np.sqrt((sums**2).sum(1, keepdims=True))
            vectors = sums / np.where(norm > 0, norm, 1.0)
            ends = pa.array(np.arange(0, vectors.size + 1, dim), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(vectors.ravel()))], ["key", "vector"])

    return listed.mapInArrow(hashed, f"key {kind}, vector array<double>").withColumnRenamed("key", key)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_topk(vectors: DataFrame, query: list[float], key: str, vector: str = "vector", k: int = 10) -> DataFrame:
    """key, score of the k vectors of the largest positive dot product with one query."""
    score = dot(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.select(key, F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(k)


#: Components of the queries that one pass over the vectors answers (8 MB), and rows of vectors and queries that are scored at once.
QUERY_COMPONENTS, SCORED, ASKED = 1 << 20, 2048, 256


def vector_topk_many(vectors: DataFrame, queries: DataFrame, key: str, query_key: str, vector: str = "vector", k: int = 10) -> DataFrame:
    """query_key, rank (from 1), key, score of the k vectors of the largest positive dot product with each of many queries
    (query_key, vector): scores rounded to 6 places, ties to the smaller key. Queries have keys of their own.

    Each task keeps the k best so far of each query, and sends no more than these; queries go to the tasks in blocks of a
    bounded size, with a pass over the vectors for each. Vectors that are null or of another length take no part.
    """
    spark = vectors.sparkSession
    whole = queries.where(F.col(vector).isNotNull()).select(query_key, vector)
    dim = whole.agg(F.max(F.size(vector))).first()[0]
    kinds = {c: t for df, c in ((queries, query_key), (vectors, key)) for n, t in df.dtypes if n == c}
    schema = f"`{query_key}` {kinds[query_key]}, `{key}` {kinds[key]}, score double"
    if not dim:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(1))
    blocks = max(1, -(-whole.count() * dim // QUERY_COMPONENTS))
    numbered = whole.withColumn("block", F.pmod(F.xxhash64(query_key), F.lit(blocks)))

    def nearest(some: list):
        shared = spark.sparkContext.broadcast((pa.array([r[0] for r in some], to_arrow_type(queries.schema[query_key].dataType)), np.array([r[1] for r in some], float)))

        def step(parts):
            names, q = shared.value
            best, ids, kind = np.full((len(q), k), -np.inf), None, None
            for batch in parts:
                kind = batch.schema.types[0]
                for at in range(0, batch.num_rows, SCORED):
                    part = batch.slice(at, SCORED)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, dim)
                    own = np.array(part.column(0).to_pylist(), object if pa.types.is_string(part.column(0).type) else None)
                    if ids is None:  # places without a score yet hold some key
                        ids = np.full((len(q), k), own[0], own.dtype)
                    for lo in range(0, len(q), ASKED):  # what is compared at once does not grow with the queries
                        some = slice(lo, lo + ASKED)
                        scores = np.concatenate([best[some], np.round(q[some] @ x.T, 6)], axis=1)
                        keys = np.concatenate([ids[some], np.broadcast_to(own, (len(scores), len(own)))], axis=1)
                        # by key first, so that of equal scores the smaller key comes first
                        order = np.argsort(keys, axis=1, kind="stable")
                        scores, keys = np.take_along_axis(scores, order, 1), np.take_along_axis(keys, order, 1)
                        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                        best[some], ids[some] = np.take_along_axis(scores, order, 1), np.take_along_axis(keys, order, 1)
            if ids is not None:
                row, place = np.nonzero(best > 0)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), pa.array(ids[row, place].tolist(), kind), pa.array(best[row, place])], [query_key, key, "score"])

        return vectors.where(F.size(vector) == dim).select(key, vector).mapInArrow(step, schema)

    found = [nearest(numbered.where((F.col("block") == b) & (F.size(vector) == dim)).select(query_key, vector).collect()) for b in range(blocks)]
    whole = found[0]
    for x in found[1:]:
        whole = whole.union(x)
    place = F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("score"), key))
    return whole.withColumn("rank", place).where(F.col("rank") <= k).select(query_key, "rank", key, "score")


def store_chunks(chunks: DataFrame, path: str, adapter: str) -> int:
    """Stores chunks (session_id, chunk_id, text, vector, ...) of some sessions in place of those that the table below
    ``path`` has of them, for this adapter and their dimension, and returns its version."""
    dims = [r[0] for r in chunks.select(F.size("vector")).distinct().limit(2).collect()]
    if len(dims) > 1:
        raise ValueError("chunks of one store have one dimension")
    return Archive(chunks.sparkSession, f"{path}/{adapter}-{dims[0]}").write({"chunks": chunks}) if dims else 0


def stored_chunks(spark, path: str, adapter: str, dimensions: int) -> DataFrame | None:
    """The chunks of an adapter and dimension; None if there are none."""
    found = Archive(spark, f"{path}/{adapter}-{dimensions}").read("chunks")
    return None if found is None else found.withColumn("adapter", F.lit(adapter)).withColumn("dimensions", F.lit(dimensions))


def replace_chunks(target: DataFrame, new: DataFrame) -> DataFrame:
    """A vector table with the chunks of the new sessions in place of the old ones, for their adapter and dimension."""
    touched = new.select("session_id", "adapter", "dimensions").distinct()
    return target.join(touched, ["session_id", "adapter", "dimensions"], "left_anti").unionByName(new)


def vector_status(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("adapter", "dimensions").agg(F.count("*").alias("chunk_count"), F.count_distinct("session_id").alias("sessions"))


def hybrid_rank(text_hits: DataFrame, vector_hits: DataFrame | None, query: str, cwd: str | None = None, k: int = 20, text_score: str = "reference") -> DataFrame:
    """Candidates of both legs by weighted score.

    text_hits: id, rank (smaller is better), text, project; vector_hits: id, score, text, project; the k best of either
    take part. A text hit's score is 1 / (1 + |rank|), divided by the largest on the page; with text_score "monotone" it is
    |rank| by the largest instead, so that a better hit scores higher. Without vectors the result is the text leg alone.
    """
    page = W.partitionBy(F.lit(1))  # over a page of k rows
    text_hits = text_hits.orderBy("rank", "id").limit(k)
    value = F.abs("rank") if text_score == "monotone" else 1 / (1 + F.abs("rank"))
    text = text_hits.withColumn("value", value).select(F.concat(F.lit("fts:"), F.col("id")).alias("id"), F.lit("fts").alias("source"), F.round(F.col("value") / F.max("value").over(page), 6).alias("fts_score"), F.lit(0.0).alias("vector_score"), "text", "project")
    both = text
    if vector_hits is not None:
        both = text.unionByName(vector_hits.orderBy(F.desc("score"), "id").limit(k).select(F.concat(F.lit("vector:"), F.col("id")).alias("id"), F.lit("vector").alias("source"), F.lit(0.0).alias("fts_score"), F.round("score", 6).alias("vector_score"), "text", "project"))
    same = F.lit(0.0) if cwd is None else F.when(F.col("project").eqNullSafe(F.lit(cwd)), 1.0).otherwise(0.0)
    hint = F.when(F.lower(F.coalesce("text", F.lit(""))).contains(query.lower()), 1.0).otherwise(0.0) if set(query) & set("./\\:") else F.lit(0.0)
    w = C.HYBRID_WEIGHTS
    total = w["fts"] * F.col("fts_score") + w["vector"] * F.col("vector_score") + w["same_project"] * same + w["exact_hint"] * hint
    return both.withColumn("same_project", same).withColumn("exact_hint", hint).withColumn("score", F.round(F.least(F.lit(1.0), total), 6)).drop("text", "project").orderBy(F.desc("score"), "source", "id").limit(k)


def agent_rank(hits: DataFrame, k: int = 20, mode: str = "text") -> DataFrame:
    """The k best hits as an agent sees them: result_id, event_id, score.

    mode "text": hits (event_id, score) get ``fts:event:<id>``, and a score by place alone. "vector": hits (chunk_id,
    score) get ``vector:chunk:<id>`` and keep their score. "hybrid": hits (id, source, score) of hybrid_rank get either
    and keep their score. event_id is null for a chunk.
    """
    if mode == "text":
        place = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("score"), "event_id"))  # over a page
        page = hits.orderBy(F.desc("score"), "event_id").limit(k).withColumn("place", place)
        return page.select(F.concat(F.lit("fts:event:"), F.col("event_id")).alias("result_id"), "event_id", F.round(1.0 / F.col("place"), 6).alias("score"))
    if mode == "vector":
        return hits.orderBy(F.desc("score"), "chunk_id").limit(k).select(F.concat(F.lit("vector:chunk:"), F.col("chunk_id")).alias("result_id"), F.lit(None).cast("long").alias("event_id"), F.round("score", 6).alias("score"))
    if mode == "hybrid":
        fts, bare = F.col("source") == "fts", F.regexp_replace("id", "^[a-z]+:", "")
        page = hits.orderBy(F.desc("score"), "source", "id").limit(k)
        return page.select(F.concat(F.when(fts, "fts:event:").otherwise("vector:chunk:"), bare).alias("result_id"), F.when(fts, bare).try_cast("long").alias("event_id"), F.round("score", 6).alias("score"))
    raise ValueError(f"no such mode: {mode}")
