"""Connected components by joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import new_path, removed, written_at

#: Edges that a task links by itself before the rounds, and nodes that it holds at once at most, two more aside.
TASK_EDGES, TASK_NODES = 1 << 18, 1 << 19


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges (a, b) as stars: each node with the smallest one that it reaches by them."""
    least: dict = {}

    def root(x):
        while (up := least.setdefault(x, x)) != x:
            least[x] = up = least[up]
            x = up
        return x

    def stars():
        ends = [(x, r) for x in list(least) if (r := root(x)) != x]
        least.clear()
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], kind) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        kind = batch.schema.types[0]
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            least[max(a, b)] = min(a, b)
            if len(least) >= TASK_NODES:
                yield stars()
    if least:
        yield stars()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, root (the smallest node that it reaches) of all nodes of edges (a, b), of any order.

    Tasks link their own edges first, some 2^18 each, which leaves few rounds. Each round links every node's neighbours
    to the smallest of them (first those above the node, then all), until no edge changes. Rounds grow with the logarithm
    of the number of nodes. Each is written to the shared folder, and deleted when the next one is. Nodes with many
    neighbours meet their minimum, one row, by a join that Spark splits by itself.
    """
    spark, paths = edges.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        paths.append(new_path(spark, "edges"))
        out = written_at(df, paths[-1])
        removed(spark, *paths[:-1])
        del paths[:-1]
        return out

    edges = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    kind, tasks = edges.schema["a"].dataType.simpleString(), max(1, edges.count() // TASK_EDGES)
    edges = kept(edges.coalesce(tasks).mapInArrow(_stars, f"a {kind}, b {kind}").distinct())
    state = lambda: tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = state()
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = kept(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = kept(small.where("a <> b").distinct())
        # a star for each component, and so no more change: each node has one edge, and no centre has any
        now = state()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components: no end of changes")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
