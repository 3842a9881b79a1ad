"""Transcript files: inventory, lines, validity, digests, side tables, logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


JSONL = {"recursiveFileLookup": True, "pathGlobFilter": "*.jsonl", "ignoreCorruptFiles": True}
URI = "_metadata.file_path"


def file_path() -> Column:
    """The path of a row's file as it is on storage: Spark's own column of it is encoded as a URI."""
    return F.coalesce(F.try_url_decode(F.replace(F.col(URI), F.lit("+"), F.lit("%2B"))), F.col(URI))


def _only(files: DataFrame, uris: list[str] | None) -> DataFrame:
    """The files of these URIs alone: Spark leaves the others out when it lists what to read."""
    return files if uris is None else files.where(F.col(URI).isin(uris))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """path, uri, archived, bytes, mtime of all *.jsonl below sessions/ and archived_sessions/; contents are not read."""
    files = spark.read.format("binaryFile").options(**JSONL).load(root)
    archived = F.col("path").contains("/archived_sessions/")
    return files.select(file_path().alias("path"), F.col(URI).alias("uri"), archived.alias("archived"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime")).where(F.col("archived") | F.col("path").contains("/sessions/"))


#: From so many bytes on, a file is no value of a row.
LARGE = 2147483632


def file_digests(spark: SparkSession, root: str, uris: list[str] | None = None, large: int = LARGE) -> DataFrame:
    """path, uri, raw_sha256 of the files. One of ``large`` bytes or more is read in splits: its digest is that of the
    sums of the hashes of its numbered lines, and begins with `lines:`."""
    files = _only(spark.read.format("binaryFile").options(**JSONL).load(root), uris)
    names = [file_path().alias("path"), F.col(URI).alias("uri")]
    whole = files.where(F.col("length") < large).select(*names, F.sha2("content", 256).alias("raw_sha256"))
    wide = [r.uri for r in files.where(F.col("length") >= large).select(*names).collect()]
    if not wide:
        return whole
    line = F.sha2(F.concat_ws("|", "line_no", "value"), 256)
    parts = [F.sum(F.conv(F.substring(line, k, 15), 16, 10).cast("decimal(38,0)")).alias(f"d{k}") for k in (1, 16, 31, 46)]
    sums = scan_lines(spark, root, wide).groupBy("path").agg(F.count("*").alias("n"), *parts)
    digest = F.concat(F.lit("lines:"), F.sha2(F.concat_ws("|", F.coalesce("n", F.lit(0)), "d1", "d16", "d31", "d46"), 256))
    listed = files.where(F.col("length") >= large).select(*names)
    return whole.union(listed.join(sums, "path", "left").select("path", "uri", digest))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, split, value), as a scan gives them, with each line's place in its split, from 1."""
    last, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [column.dictionary_encode().indices.to_numpy(zero_copy_only=False) for column in batch.columns[:2]]
        new = np.concatenate([[True], (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])])
        first = np.flatnonzero(new)
        place = np.arange(batch.num_rows) - np.repeat(first, np.diff(np.append(first, batch.num_rows))) + 1
        key = lambda k: (batch.column(0)[k].as_py(), batch.column(1)[k].as_py())  # noqa: B023, E731
        if key(0) == last:
            place[: first[1] if len(first) > 1 else batch.num_rows] += n
        last, n = key(batch.num_rows - 1), int(place[-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(place, pa.int64()), batch.column(2)], names=["path", "split", "place", "value"])


def scan_lines(spark: SparkSession, root: str, uris: list[str] | None = None) -> DataFrame:
    """path, line_no (from 1, blank lines counted), value of every line that is not blank; of all files, or of some.

    Lines are numbered where they are read, by their place in their split; of files in several splits, the lines of the
    splits before are counted in a pass of its own, which holds no text. The table of splits that do not begin a file
    (one for each spark.sql.files.maxPartitionBytes of input at most, 24 bytes each) is sent to all tasks, so that no
    text is shuffled. What cannot be read of a broken file is left out.
    """
    files = _only(spark.read.options(**JSONL).text(root), uris)
    lines = files.select(file_path().alias("path"), F.col("_metadata.file_block_start").alias("split"), "value")
    # of all files, small ones too: which files are read decides how Spark splits them
    counts = files.groupBy(file_path().alias("path"), F.col("_metadata.file_block_start").alias("split")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.withColumn("before", before).where("split > 0").select(F.xxhash64("path").alias("file"), "split", "before")
    numbered = lines.mapInArrow(_numbered, "path string, split long, place long, value string")
    found = numbered.withColumn("file", F.xxhash64("path")).join(F.broadcast(starts), ["file", "split"], "left")
    changed = F.raise_error(F.concat(F.lit("a file was changed while it was read; run again: "), F.col("path"))).cast("long")
    line = (F.col("place") + F.when(F.col("split") == 0, 0).otherwise(F.coalesce("before", changed))).cast("int")
    return found.select("path", line.alias("line_no"), F.regexp_replace("value", "\r$", "").alias("value")).where(F.trim(F.regexp_replace("value", r"\s", "")) != "")


def split_valid(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects with rec as a VARIANT, warnings): what is no JSON, or no object, becomes a warning."""
    spark, name = lines.sparkSession, "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name, None)
    try:
        spark.conf.set(name, "true")  # the last of equal keys counts; the plan holds it from here on
        parsed = lines.withColumn("rec", F.try_parse_json("value"))
        parsed.schema  # noqa: B018
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
    is_object = F.coalesce(F.schema_of_variant("rec").startswith("OBJECT"), F.lit(False))
    code = F.when(F.col("rec").isNull(), "invalid_json").otherwise("non_object_record")
    return parsed.where(is_object), parsed.where(~is_object).select("path", "line_no", code.alias("code"), F.substring("value", 1, 1000).alias("raw_excerpt"))


STATE_COLUMNS = "id rollout_path created_at updated_at source cwd title preview archived model agent_path".split()


def thread_state(df: DataFrame) -> DataFrame:
    """A side table of sessions, with all columns, missing ones null; rows without a path are of no use."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in STATE_COLUMNS]).where("rollout_path is not null")


def read_history(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, warnings) of a log of JSON lines; records are in no order: sort them by what they hold."""
    lines = spark.read.text(path)
    parsed = lines.withColumn("r", F.from_json("value", schema)).withColumn("ok", F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False)))
    return parsed.where("ok").select("r.*"), parsed.where("not ok and trim(value) <> ''").select(F.substring("value", 1, 1000).alias("raw_excerpt"))
