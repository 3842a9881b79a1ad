"""Spark sessions for this package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, unless their PYTHONPATH has it. Once for each SparkContext."""
    sc = spark.sparkContext
    if str(PACKAGE.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_quillmill_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="spark-quillmill-")) / "quillmill.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(PACKAGE.rglob("*.py")):
            out.write(file, file.relative_to(PACKAGE.parent))
    sc.addPyFile(str(path))
    sc._quillmill_shipped = True


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, as tests and the benchmark use."""
    settings = {"spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"} | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark
