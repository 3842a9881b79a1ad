"""Pairs of calls and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def calls_of(events: DataFrame) -> DataFrame:
    """path, line_no, kind, call_id of events that are function calls or their outputs."""
    kind = F.when(F.col("sub_type") == "function_call", "call").when(F.col("sub_type") == "function_call_output", "output")
    return events.withColumn("kind", kind).where("kind is not null and call_id <> ''").select("path", "line_no", "kind", "call_id")


def pairing_warnings(calls: DataFrame) -> DataFrame:
    """path, line_no, code, call_id.

    An output is an orphan if no call of its id stands before it, a duplicate if a call does and so does another output;
    a call whose id has no output anywhere in the file misses one, at the id's last call.
    """
    before = W.partitionBy("path", "call_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    count = lambda kind: F.coalesce(F.count_if(F.col("kind") == kind).over(before), F.lit(0))
    code = F.when(count("call") == 0, "orphan_function_call_output").when(count("output") > 0, "duplicate_function_call_output")
    outputs = calls.withColumn("code", code).where("kind = 'output' and code is not null").select("path", "line_no", "code", "call_id")
    groups = calls.groupBy("path", "call_id").agg(F.max(F.when(F.col("kind") == "call", F.col("line_no"))).alias("line_no"), F.count_if(F.col("kind") == "output").alias("outputs"))
    missing = groups.where("outputs = 0").select("path", "line_no", F.lit("missing_function_call_output").alias("code"), "call_id")
    return outputs.unionByName(missing)


def pairing_summary(calls: DataFrame) -> DataFrame:
    """Counts by file, whatever the order: ids without call, with more than one output, without output."""
    by_id = calls.groupBy("path", "call_id").agg(F.count_if(F.col("kind") == "call").alias("calls"), F.count_if(F.col("kind") == "output").alias("outputs"))
    return by_id.groupBy("path").agg(
        F.count_if((F.col("calls") == 0) & (F.col("outputs") > 0)).alias("orphans"), F.count_if((F.col("calls") > 0) & (F.col("outputs") > 1)).alias("duplicates"), F.count_if((F.col("calls") > 0) & (F.col("outputs") == 0)).alias("missing"))
