"""Removal of lines that many documents share, as keep bitmaps. Only DataFrame functions run here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .scratch import written

BLANKS = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts into which the occurrences of one key are split, by document.
SALTS = 64


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_dropped, and kept: a compressed bitmap of the lines that stay, as (word, bits) in order of word. Bit k of
    word w is set if line 64 w + k stays; words without a line to drop are left out, and all their lines stay.

    Lines meet by 128 bits of hash, range-partitioned by hash and a salt of the document, each part sorted by document
    (the largest first) and position, so that one key may stand in any number of documents. The first occurrence of
    each key in each document streams into the count; a key in ``min_docs`` documents or more is kept in the largest
    doc_id alone, with all its lines there. Documents without a line to drop have no row.

    Null texts are one empty line. Rows with a null doc_id neither count nor lose lines; rows that repeat a doc_id count
    as one document. Further columns are ignored, empty tables give empty results.
    """
    lines = docs.where("doc_id is not null").select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    occurrences = written(keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"), "doc_id", "pos"), "line-hashes")
    salted = occurrences.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    sorted_ = salted.repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", F.desc("doc_id"), "pos")
    stream = W.partitionBy("h1", "h2", "salt").orderBy(F.desc("doc_id"), "pos")
    firsts = sorted_.withColumn("last", F.lag("doc_id").over(stream)).where("last is null or last <> doc_id")
    parts = firsts.groupBy("h1", "h2", "salt").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    # a key has as many parts as there are salts at most; its occurrences meet what is known of it part by part
    key = W.partitionBy("h1", "h2")
    frequent = parts.select("h1", "h2", "salt", F.sum("n").over(key).alias("n"), F.max("keeper").over(key).alias("keeper")).where(F.col("n") >= min_docs).drop("n")
    dropped = salted.join(frequent, ["h1", "h2", "salt"]).where("doc_id <> keeper")
    # a row that repeats a doc_id repeats its positions, hence bits and not sums
    words = dropped.groupBy("doc_id", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)"))).alias("bits"))
    return words.groupBy("doc_id").agg(F.sum(64 - F.bit_count("bits")).cast("long").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("kept"))


def keep_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text: the lines that stay by keep_bitmaps, joined by newlines.

    A null text is one empty line. Rows with a null doc_id, and those without a bitmap, keep all lines; rows that repeat
    a doc_id share its bitmap. Further columns stay, but for those that are named as a result is.
    """
    own = docs.drop("n_lines", "n_dropped", "kept_text")
    marked = own.join(bitmaps.select(F.col("doc_id").alias("__id"), F.col("n_dropped").alias("__dropped"), F.col("kept").alias("__kept")), F.col("doc_id") == F.col("__id"), "left")
    lines = lines_of(F.col("text"))
    # every word of bits at its place, made once for a text and bound to a name
    dense = F.expr("transform(array(map_from_entries(__kept)), m -> transform(sequence(0, element_at(__kept, -1).word), w -> coalesce(try_element_at(m, w), -1L)))[0]")
    stays = lambda bits: lambda x, i: F.coalesce(F.try_element_at(bits, (F.shiftright(i, 6) + 1).cast("int")), F.lit(-1).cast("long")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)) != 0
    kept = F.transform(F.array(dense), lambda bits: F.array_join(F.filter(lines, stays(bits)), "\n"))[0]
    return marked.select(
        *[F.col(f"`{c}`") for c in own.columns],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("__dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("__kept").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept_text"),
    )


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many go, and the SHA-256 of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return keep_lines(docs, keep_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.keeper AS dropped
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
