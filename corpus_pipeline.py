"""From raw documents to token files: quality, near duplicates, decontamination, mixing, tokens.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents, and any further ones.

Rows are told apart by their ids and texts: rows with a null doc_id, or with one doc_id and several texts, are each
judged by their own text. Empty and null texts are scored like any other; no words can be taken of them, so they end at
the mix. Empty tables give empty results. Ties are broken by the rows' values, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm import decontaminate, mixing, ngram_join, quality, token_files
from quillmill.llm.scratch import written

#: Documents that score below are rejected.
LEAST_QUALITY = 0.3


def keep_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quality classifier scores below LEAST_QUALITY."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = docs.withColumnsRenamed({c: f"own_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")})
    kept = quality.score(own, model, keep=True).where(F.col("score") >= LEAST_QUALITY).drop("score")
    return kept.withColumnsRenamed({f"own_{k}": c for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}).select(docs.columns)


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate class: that with the smallest doc_id, the first by set and text where rows
    share it, and the first by all values where they share both. Rows without an id or without words all stay."""
    found = ngram_join.near_duplicates(docs)
    first = found.where("class is not null").groupBy("class").agg(F.min(F.struct("doc_id", "set", "text_key")).alias("first"))
    keys = [F.col("doc_id"), ngram_join.text_key(F.col("text"))]
    wanted = first.select(F.col("first.doc_id").alias("w_id"), F.col("first.text_key").alias("w_key"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), keys[0].alias("id"), keys[1].alias("key"))
    kept = rows.join(wanted, (F.col("id") == F.col("w_id")) & (F.col("key") == F.col("w_key")), "left_semi")
    # maps have no order, their JSON has
    first_row = F.min_by("row", F.to_json("row")) if any("map<" in kind or "variant" in kind for _, kind in docs.dtypes) else F.min("row")
    kept = kept.groupBy("id", "key").agg(first_row.alias("row")).select("row.*")
    return kept.unionByName(docs.where(F.col("doc_id").isNull() | (mixing.word_count(F.col("text")) == 0)))


def without_benchmarks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item stands."""
    key = F.xxhash64("doc_id", "text")
    found = decontaminate.contaminated_regions(docs.select(key.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    return rows.join(found.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as the mix takes its words, to the nearest whole number (0, 1 or 2 times)."""
    key = F.xxhash64("doc_id", "source", "text")
    sizes, _, pieces = mixing.mix(docs.select(key.alias("doc_id"), "source", "text"))
    taken = pieces.groupBy("rid").agg(F.sum("words").alias("taken"))
    times = sizes.where("size > 0").join(taken, "rid").groupBy(F.col("doc_id").alias("key")).agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("times")).where("times > 0")
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key")).join(times, "key")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).select("row.*")


def token_output(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mix as token files and returns what they hold of each document."""
    return token_files.encode_and_read(spark, docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_benchmarks),
    ("mixing sources to target weights", mixed),
    ("token-ID output", token_output),
]

#: Scores, component search and tokens are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
