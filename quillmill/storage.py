"""The folder that driver and executors share, and what is kept in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a fresh temporary one, on one machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-quillmill-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: it is computed once, and a lost executor costs no more than a read."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Stage:
    """Tables of one job in the shared folder: each computed once, all deleted at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Stage:
        return self

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(new_path(self.spark, name))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def __exit__(self, *_) -> None:
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of a table's bytes; 0 where it has none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 55 else 0


def _files(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listFiles(at, True)
    out = []
    while files.hasNext():
        x = files.next()
        out.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
    return tuple(sorted(out))


def kept(spark: SparkSession, name: str, table: str, make: Callable[[str], None]) -> str:
    """The path of what ``make`` writes of a table: made once in an application, and again when the table's files change."""
    here = spark.sparkContext.__dict__.setdefault("_quillmill_kept", {})
    key = (name, table, _files(spark, table))
    if key not in here:
        path = new_path(spark, name)
        make(path)
        here[key] = path
    return here[key]
