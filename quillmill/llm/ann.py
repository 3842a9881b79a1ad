"""Nearest neighbours by inner product: anisotropic four-bit product quantisation, table scans, exact reranking.

Vectors are cut into pairs of components, each pair coded by one of 16 centroids. Codes and centroids are chosen for the
score-aware loss: of a vector's residual, the part along the vector counts ``eta`` times as much as the rest, since it
alone moves the inner products with queries that the vector is near to. A query's scores are sums of table entries;
the best of each block of candidates are then scored exactly, in double precision, on the original vectors, and so is
every other one that the bound of its residual does not rule out: the k nearest are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .scratch import written

CENTROIDS = 16


def valid(vector: str) -> str:
    """SQL: the vector is there, has finite components alone, and is not zero."""
    return f"{vector} is not null and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({vector}, x -> x <> 0)"


class Quantiser:
    """centroids: (pairs, 16, 2)."""

    def __init__(self, dim: int, threshold: float = 0.2) -> None:
        self.dim, self.pairs = dim, -(-dim // 2)
        self.eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
        self.centroids = np.zeros((self.pairs, CENTROIDS, 2))

    def _cut(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and their directions, as pairs of components."""
        x = np.pad(x, ((0, 0), (0, 2 * self.pairs - self.dim)))
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return x.reshape(len(x), self.pairs, 2), unit.reshape(len(x), self.pairs, 2)

    def _assign(self, x: np.ndarray, unit: np.ndarray, codes: np.ndarray | None, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes by coordinate descent over the pairs; and the residuals' parts along the vectors, by pair."""
        if codes is None:
            codes = np.stack([((x[:, s, None] - self.centroids[s]) ** 2).sum(2).argmin(1) for s in range(self.pairs)], 1)
        along = np.stack([((x[:, s] - self.centroids[s, codes[:, s]]) * unit[:, s]).sum(1) for s in range(self.pairs)], 1)
        total = along.sum(1)
        for _ in range(sweeps):
            for s in range(self.pairs):
                residual = x[:, s, None] - self.centroids[s]
                here = (residual * unit[:, s, None]).sum(2)
                rest = total - along[:, s]
                cost = (residual**2).sum(2) + (self.eta - 1) * (rest[:, None] + here) ** 2
                codes[:, s] = cost.argmin(1)
                along[:, s] = here[np.arange(len(x)), codes[:, s]]
                total = rest + along[:, s]
        return codes, along

    def fit(self, x: np.ndarray, rounds: int = 6, seed: int = 3) -> Quantiser:
        rng = np.random.default_rng(seed)
        x, unit = self._cut(x)
        for s in range(self.pairs):
            self.centroids[s] = x[rng.choice(len(x), CENTROIDS, len(x) < CENTROIDS), s]
        codes = None
        for k in range(rounds + 2):
            codes, along = self._assign(x, unit, None if k < 2 else codes, 0 if k < 2 else 1)
            total = along.sum(1)
            for s in range(self.pairs):
                u, c = unit[:, s], codes[:, s]
                weight = (self.eta - 1) * (k >= 2)
                rest = total - along[:, s]
                right = x[:, s] + weight * u * (rest + (x[:, s] * u).sum(1))[:, None]
                n = np.bincount(c, minlength=CENTROIDS)
                a = np.zeros((CENTROIDS, 2, 2))
                b = np.stack([np.bincount(c, right[:, i], CENTROIDS) for i in (0, 1)], 1)
                for i in (0, 1):
                    for j in (0, 1):
                        a[:, i, j] = n * (i == j) + weight * np.bincount(c, u[:, i] * u[:, j], CENTROIDS)
                some = n > 0
                self.centroids[s, some] = np.linalg.solve(a[some], b[some][:, :, None])[:, :, 0]
                new = ((x[:, s] - self.centroids[s, c]) * u).sum(1)
                total, along[:, s] = rest + new, new
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Two codes to a byte."""
        codes, _ = self._assign(*self._cut(x), None, 2)
        codes = np.pad(codes, ((0, 0), (0, self.pairs % 2))).astype(np.uint8)
        return codes[:, ::2] | codes[:, 1::2] << 4

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        pairs = np.stack([codes & 15, codes >> 4], 2).reshape(len(codes), -1)[:, : self.pairs]
        return self.centroids[np.arange(self.pairs), pairs].reshape(len(codes), -1)[:, : self.dim]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and byte of a code, the scores of the byte's 256 values: sums of two four-bit tables."""
        q, _ = self._cut(queries)
        four = np.einsum("qsd,scd->qsc", q, self.centroids)
        four = np.pad(four, ((0, 0), (0, self.pairs % 2), (0, 0)))
        return (four[:, 1::2, :, None] + four[:, ::2, None, :]).reshape(len(q), -1, 256).astype(np.float32)


def scan(quantiser: Quantiser, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, rerank: int):
    """The k best of a block for each query, exactly: (query_id, vec_id, score) arrays. ids ascend.

    The ``rerank`` best by table scan give a score that k vectors reach at least; every other vector whose score can
    reach it, by the table's sum and the bound of its residual, is scored too. The residual's part along the decoded
    vector scales the sum; the rest of it meets the part of the query across the decoded vector alone.
    """
    columns = np.ascontiguousarray(codes.T)
    full = vectors.astype(np.float64)
    decoded = quantiser.decode(codes)
    norm = np.linalg.norm(decoded, axis=1)
    square = np.where(norm > 0, norm, 1.0) ** 2
    gain = np.where(norm > 0, (full * decoded).sum(1) / square, 1.0)
    across = np.linalg.norm(full - gain[:, None] * decoded, axis=1)
    lengths, length = np.linalg.norm(queries.astype(np.float64), axis=1), np.linalg.norm(full, axis=1)
    for lo in range(0, len(queries), 64):
        q, q_ids, q_norm = queries[lo : lo + 64].astype(np.float64), query_ids[lo : lo + 64], lengths[lo : lo + 64]
        tables = quantiser.tables(q)
        about = np.zeros((len(q), len(ids)), np.float32)
        for s, column in enumerate(columns):
            about += tables[:, s].take(column, axis=1)
        reach = np.full(len(q), -np.inf)
        for i in range(len(q)):
            row = about[i]
            if len(row) > rerank + 1:
                border = np.partition(row, -(rerank + 1))[-(rerank + 1)]
                above, ties = np.flatnonzero(row > border), np.flatnonzero(row == border)
                some = np.concatenate([above, ties[: rerank + 1 - len(above)]])
            else:
                some = np.arange(len(row))
            some = some[ids[some] != q_ids[i]]
            if len(some) >= k:
                reach[i] = np.partition((full[some] * q[i]).sum(1), -k)[-k]
        # rounding: of sums in single precision, of products in double; "not below" lets what is not a number pass
        slack = (len(columns) + 8) * 2.0**-23 * q_norm[:, None]
        error = slack * norm + len(columns) * 2.0**-148
        along = np.maximum(np.abs(about) - error, 0) / np.sqrt(square)
        most = about * gain + np.sqrt(np.maximum(q_norm[:, None] ** 2 - along**2, 0)) * across + error * np.abs(gain) + slack * length
        can = ~(most < reach[:, None]) | ~np.isfinite(about)
        rows = np.flatnonzero(can.any(0))
        fine = 1e-12 * q_norm[:, None] * length[rows]
        can = can[:, rows] & ~(q @ full[rows].T < reach[:, None] - fine)
        for i in range(len(q)):
            some = rows[can[i]]
            some = some[ids[some] != q_ids[i]]
            exact = (full[some] * q[i]).sum(1)
            best = np.lexsort((ids[some], -exact))[:k]
            yield np.full(len(best), q_ids[i]), ids[some[best]], exact[best]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, sample: int = 16_384, rerank: int = 128, block: int | None = None, query_block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of vectors (vec_id, embedding) to each of queries (same columns).

    Every row is indexed; the quantiser is fitted on the ``sample`` vectors that come first by a hash of vec_id. Rows
    are dealt by hash into blocks of some ``block`` candidates and ``query_block`` queries (by default, 2^22 and 2^20
    components: of 64 each, 65,536 vectors and 16,384 queries); each pair of blocks gives each query's k best of it, and
    the best of all blocks are returned. Candidates are sent out once for each block of queries, queries once for each
    block of candidates. ``rerank`` candidates by table scan set the score that others must be able to reach; it decides
    cost alone, never a result.

    Each distinct query row is asked once and ranked by itself: rows that repeat count once, and rows of one id with
    other vectors give k rows each. Ties go to the smaller vec_id; a query's own vec_id is no candidate of its. Rows with a null id, and vectors that
    are null, empty, zero, hold null or non-finite components, or have another length than most, take no part. Rows
    that repeat a vec_id are candidates each. Further columns are ignored; empty tables give no rows.
    """
    spark = vectors.sparkSession
    ready = vectors.where("vec_id is not null").where(valid("embedding")).selectExpr("cast(vec_id as long) vec_id", "embedding")
    sizes = ready.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, n = sizes
    ready = ready.where(F.size("embedding") == dim)
    # at most ``sample`` vectors
    fitted = Quantiser(dim).fit(np.array([r[0] for r in ready.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()], float))
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"

    def encode(parts):
        for batch in parts:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy().astype(kind).reshape(-1, dim)
                codes = fitted.encode(flat.astype(float))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in flat], pa.binary()), pa.array([x.tobytes() for x in codes], pa.binary())], ["vec_id", "vec", "code"])

    index = written(ready.mapInArrow(encode, "vec_id long, vec binary, code binary"), "vector-index")
    asked = queries.where("vec_id is not null").where(valid("embedding")).where(F.size("embedding") == dim)
    asked = asked.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q")).distinct().withColumn("q_key", F.xxhash64("q"))
    n_queries = asked.count()
    cores = spark.sparkContext.defaultParallelism
    # a table of few blocks is cut finer, so that all cores have some, into twice as many blocks as there are cores at most
    blocks = max(-(-n // (block or max(1, (1 << 22) // dim))), 1 if block else min(-(-n // 4096), 2 * cores))
    query_blocks = max(1, -(-n_queries // (query_block or max(1, (1 << 20) // dim))))
    of = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n))
    every = lambda n: F.explode(F.expr(f"sequence(0L, {n - 1}L)"))
    left = index.withColumn("b", of("vec_id", blocks)).withColumn("qb", every(query_blocks))
    right = asked.withColumn("qb", of("query_id", query_blocks)).withColumn("b", every(blocks))

    def pair(candidates: pa.Table, some: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", pa.int64()), ("q_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not candidates.num_rows or not some.num_rows:
            return out.empty_table()
        ids = candidates["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        joined = lambda column, kind: np.frombuffer(b"".join(candidates[column].to_pylist()), kind).reshape(len(ids), -1)[order]
        q = np.array(some["q"].to_pylist(), float)
        found = list(scan(fitted, ids[order], joined("vec", kind), joined("code", np.uint8), some["query_id"].to_numpy(), q, k, rerank))
        keys = np.repeat(some["q_key"].to_numpy(), [len(x[0]) for x in found])
        query_ids, ids, scores = (np.concatenate(c) for c in zip(*found))
        return pa.table([query_ids, keys, ids, scores], schema=out)

    best = left.groupBy("b", "qb").cogroup(right.groupBy("b", "qb")).applyInArrow(pair, "query_id long, q_key long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id", "q_key").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of all vectors to every twentieth."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
