"""Ranked full-text search over postings."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import constants as C
from quillmill.functions.batches import pieces
from quillmill.storage import estimated_bytes

K1, B = 1.2, 0.75
#: Terms that a Python worker takes at a time, and one event more: all that it holds beside Spark's batch is in proportion.
PIECE_TERMS = 1 << 18


def terms(text: Column) -> Column:
    """Words of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(C.TERM), 0)


def postings(events: DataFrame, fields: tuple[str, ...] = ("tool_name", "file_path", "indexed_text"), key: str = "event_id") -> DataFrame:
    """term, key, field, tf, positions (ascending, from 0), length (terms of the event, in all fields): the inverted index.

    All postings of an event come from its row alone: no token is shuffled. ``key`` holds each event once.
    """
    listed = events.select(F.col(key).alias("key"), *[terms(F.col(f)).alias(f"f{k}") for k, f in enumerate(fields)])
    kind = listed.schema["key"].dataType.simpleString()

    def invert(parts):
        for whole in parts:
            size = sum(whole.column(k + 1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(fields)))
            for batch in pieces(whole, size, PIECE_TERMS):
                lists = [batch.column(k + 1) for k in range(len(fields))]
                sizes = [x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
                length = np.sum(sizes, axis=0)
                for name, column, size in zip(fields, lists, sizes):
                    words = column.flatten().dictionary_encode()
                    if not len(words):
                        continue
                    row = np.repeat(np.arange(len(size)), size)
                    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                    order = np.argsort(row * len(words.dictionary) + code, kind="stable")
                    row, code, place = row[order], code[order], place[order]
                    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])]))
                    ends = np.append(first, len(row))
                    positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [words.dictionary.take(pa.array(code[first])), batch.column(0).take(pa.array(row[first])), pa.array([name] * len(first)), pa.array(np.diff(ends), pa.int64()), positions, pa.array(length[row[first]], pa.int64())],
                        ["term", "key", "field", "tf", "positions", "length"],
                    )

    return listed.mapInArrow(invert, f"term string, key {kind}, field string, tf long, positions array<int>, length long").withColumnRenamed("key", key)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(events: DataFrame, path: str, buckets: int | None = None, fields: tuple[str, ...] = ("tool_name", "file_path", "indexed_text"), key: str = "event_id") -> None:
    """Writes the postings of events, and one row of totals, below ``path``: shuffled once, by bucket of term, and sorted
    by term, so that a query reads its terms' buckets alone, and of these the row groups that hold the terms.

    There is a file for each MB of events or so, 16 at least. A frequent term may hold a large share of all postings: as
    the events grow, buckets of terms and the parts of each, dealt by key, both grow with the root of them. A task writes
    one file: a share of one bucket.
    """
    spark, files = events.sparkSession, max(16, min(1 << 20, estimated_bytes(events) >> 20))
    buckets = buckets or max(16, 1 << (files.bit_length() // 2))
    parts = -(-files // buckets)
    rows = postings(events, fields, key).withColumn("bucket", _bucket(F.col("term"), buckets))
    place = F.col("bucket") * parts + F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    rows.repartitionById(buckets * parts, place).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    totals(spark.read.parquet(f"{path}/postings"), key).withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/totals")


class StoredIndex:
    """What write_index has written; stands wherever an index of postings does."""

    def __init__(self, spark, path: str) -> None:
        self.postings = spark.read.parquet(f"{path}/postings")
        self.totals = spark.read.parquet(f"{path}/totals")
        self.buckets = self.totals.first().buckets

    def of(self, wanted: list[str]) -> DataFrame:
        """The postings of some terms: constants, from which Spark knows the folders to read."""
        some = self.postings.where(F.col("bucket").isin([_bucket(F.lit(t), self.buckets) for t in wanted]) if wanted else F.lit(False))
        return some.where(F.col("term").isin(list(wanted))).drop("bucket")


def of_terms(index: DataFrame | StoredIndex, wanted: list[str]) -> DataFrame:
    return index.of(list(wanted)) if isinstance(index, StoredIndex) else index.where(F.col("term").isin(list(wanted)))


def document_lengths(index: DataFrame, key: str = "event_id") -> DataFrame:
    return index.groupBy(key).agg(F.max("length").alias("length"))


def totals(index: DataFrame, key: str = "event_id") -> DataFrame:
    """One row: n, mean of the lengths of the events that hold a term."""
    return document_lengths(index, key).agg(F.count("*").alias("n"), F.avg("length").alias("mean"))


def parse_query(text: str | None) -> tuple[str, list[str], list[str]]:
    """(kind, terms, terms not wanted): blank, phrase, all, any.

    A query with a quote or another sign of the query language is one phrase. Upper-case OR between words asks for any
    of them, NOT before a word rules it out, AND changes nothing.
    """
    words = lambda x: re.findall(r"[^\W_]+", x.lower())
    if not (text or "").strip():
        return "blank", [], []
    if set(text) & set("\"':()*^{}[]"):
        return "phrase", words(text), []
    parts = text.split()
    unwanted = [w for a, b in zip(parts, parts[1:]) if a == "NOT" for w in words(b)]
    plain = [w for k, x in enumerate(parts) if x not in ("AND", "OR", "NOT") and not (k and parts[k - 1] == "NOT") for w in words(x)]
    if any(len(words(x)) > 1 for x in parts):
        return "phrase", words(text), []  # such as a-b or parser.py: what the index cannot take as one term is a phrase
    return ("any" if "OR" in parts else "all"), plain, unwanted


def match_terms(index: DataFrame | StoredIndex, wanted: list[str], every: bool = True, unwanted: list[str] = (), key: str = "event_id") -> DataFrame:
    """Keys of events that hold all (or any) wanted terms, in any field, and none of the unwanted."""
    found = of_terms(index, wanted).groupBy(key).agg(F.count_distinct("term").alias("n"))
    out = (found.where(F.col("n") == len(set(wanted))) if every else found).select(key)
    return out.join(of_terms(index, unwanted).select(key), key, "left_anti") if unwanted else out


def match_phrase(index: DataFrame | StoredIndex, phrase: list[str], key: str = "event_id") -> DataFrame:
    """Keys of events that hold the terms one after the other, in one field: each position less its term's place in the
    phrase must be the same for all of them. The postings of a field meet as lists; no position is a row of its own."""
    wanted = of_terms(index, phrase).select(key, "field", F.struct("term", "positions").alias("posting"))
    if not phrase:
        return wanted.select(key)
    # dealt before they are grouped: what is collected is a task's share, and not what a task of the scan has read
    found = wanted.repartition(key, "field").groupBy(key, "field").agg(F.collect_list("posting").alias("postings"))
    at = lambda t, k: F.transform(F.flatten(F.filter("postings", lambda x: x["term"] == t)["positions"]), lambda p: p - k)
    starts = reduce(F.array_intersect, [at(t, k) for k, t in enumerate(phrase)])
    return found.where(F.size(starts) > 0).select(key).distinct()


def match_like(events: DataFrame, part: str, key: str = "event_id") -> DataFrame:
    """Keys of events whose indexed text holds a string, in any case."""
    return events.where(F.lower("indexed_text").contains(part.lower())).select(key)


def bm25(index: DataFrame | StoredIndex, wanted: list[str], key: str = "event_id") -> DataFrame:
    """key, score of every event that holds one of the terms: Okapi BM25, fields as one text, rounded to 6 places."""
    total = index.totals.select("n", "mean") if isinstance(index, StoredIndex) else totals(index, key)
    tf = of_terms(index, wanted).groupBy(key, "term").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    # one row for each term, and one row of totals: as small as the query
    scored = tf.join(F.broadcast(df), "term").join(F.broadcast(total))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return scored.groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))


def search(events: DataFrame, index: DataFrame | StoredIndex, sessions: DataFrame, query: str, limit: int = 20, cwd: str | None = None, session_id: str | None = None, event_type: str | None = None, tool: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """event_id, session_id, score of the best matches: match, filter, rank, and only then whatever is wide."""
    kind, wanted, unwanted = parse_query(query)
    if kind == "blank" or not wanted:
        hits = events.select("event_id").withColumn("score", F.lit(0.0))
    else:
        found = match_phrase(index, wanted) if kind == "phrase" else match_terms(index, wanted, kind == "all", unwanted)
        hits = bm25(index, wanted).join(found, "event_id", "left_semi")
    some = events
    for value, test in ((session_id, F.col("session_id") == session_id), (event_type, (F.col("top_type") == event_type) | F.col("sub_type").eqNullSafe(F.lit(event_type))), (tool, F.col("tool_name") == tool)):
        if value is not None:
            some = some.where(test)
    if since is not None:
        some = some.where(F.col("timestamp") >= since)
    if until is not None:
        some = some.where(F.col("timestamp") <= until)
    if cwd is not None:
        some = some.join(sessions.where(F.col("cwd") == cwd).select("session_id"), "session_id", "left_semi")
    return hits.join(some.select("event_id", "session_id"), "event_id").orderBy(F.desc("score"), "event_id").limit(limit)


def snippets(hits: DataFrame, events: DataFrame, wanted: list[str], width: int = 12) -> DataFrame:
    """hits with a snippet: up to ``width`` words around the first hit, hits in brackets. Texts join the few hits alone."""
    words = F.split(F.trim(F.regexp_replace("indexed_text", C.SPACES, " ")), " ")
    is_hit = lambda w: F.exists(terms(w), lambda t: t.isin(list(wanted)))
    texts = hits.join(events.select("event_id", "indexed_text"), "event_id").withColumn("words", words)
    flags = F.transform("words", lambda w: is_hit(w))
    first = F.greatest(F.lit(1), F.array_position(flags, True).cast("int") - 4)
    some = F.transform(F.slice("words", first, width), lambda w: F.when(is_hit(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return texts.withColumn("snippet", F.concat(F.when(first > 1, "...").otherwise(""), F.array_join(some, " "), F.when(F.size("words") >= first + width, "...").otherwise(""))).drop("words", "indexed_text")
