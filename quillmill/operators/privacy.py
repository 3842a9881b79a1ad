"""Detectors of personal data and secrets: findings, allowlist, redaction, gates."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import constants as C
from quillmill.functions.patterns import for_spark

HIGH = ["high", "critical"]


def _hinted(kind: str, text: Column) -> Column:
    """Whether a text can hold a match at all: a search for fixed strings, which most texts end with."""
    out = F.lit(False)
    for hint in C.DETECTOR_HINTS[kind]:
        out = out | text.contains(hint)
    return out


def scan(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, severity, n (place among the text's matches of that kind), match, excerpt: one row for each match."""
    t = F.coalesce(text, F.lit(""))
    matches = lambda kind, pattern: F.when(_hinted(kind, t), F.regexp_extract_all(t, F.lit(for_spark(pattern)), 0))
    found = [F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), matches(kind, pattern).alias("matches")) for kind, severity, pattern in C.DETECTORS]
    rows = df.select(key, F.explode(F.filter(F.array(*found), lambda x: F.size(x["matches"]) > 0)).alias("x")).select(key, "x.kind", "x.severity", F.posexplode("x.matches").alias("n", "match"))
    return rows.withColumn("excerpt", F.when(F.length("match") > 120, F.concat(F.substring("match", 1, 117), F.lit("..."))).otherwise(F.col("match")))


def match_offsets(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, severity, n, match, start, end (characters, from 0) of each match. Only texts with a match leave the JVM."""
    any_match = F.lit(False)
    for kind, _, pattern in C.DETECTORS:
        any_match = any_match | (_hinted(kind, F.col(text)) & F.col(text).rlike(for_spark(pattern)))
    rows = df.where(any_match).select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind_of_key = rows.schema["key"].dataType.simpleString()
    detectors = [(kind, severity, re.compile(pattern)) for kind, severity, pattern in C.DETECTORS]
    names = ["key", "kind", "severity", "n", "match", "start", "end"]

    def spans(parts):
        for batch in parts:
            out = [(k, kind, severity, n, m[0], m.start(), m.end()) for k, text in zip(*(c.to_pylist() for c in batch.columns)) for kind, severity, pattern in detectors for n, m in enumerate(pattern.finditer(text))]
            if out:
                types = [batch.column(0).type, pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return rows.mapInArrow(spans, f"key {kind_of_key}, kind string, severity string, n int, match string, start int, end int").withColumnRenamed("key", key)


def allowlisted(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """findings with allowlisted: a rule (kind, text, pattern; each may be null) covers the match.

    Rules are a handful of rows that people write, and are sent to every task.
    """
    r = F.broadcast(rules.select(F.col("kind").alias("r_kind"), F.col("text").alias("r_text"), F.col("pattern").alias("r_pattern")))
    covers = (F.col("r_kind").isNull() | (F.col("r_kind") == F.col("kind"))) & ((F.col("r_text") == F.col("match")) | F.expr("match rlike r_pattern"))
    covered = findings.join(r, covers, "left_semi").withColumn("allowlisted", F.lit(True))
    return covered.unionByName(findings.join(r, covers, "left_anti").withColumn("allowlisted", F.lit(False)))


def effective(findings: DataFrame) -> DataFrame:
    return findings.where(~F.col("allowlisted")) if "allowlisted" in findings.columns else findings


def high_risk(findings: DataFrame, key: str) -> DataFrame:
    """Keys with a finding of high or critical severity that no rule allows."""
    return effective(findings).where(F.col("severity").isin(HIGH)).select(key).distinct()


RANKS = {"critical": 0, "high": 1, "medium": 2, "low": 3}
#: Rules that people write; more are no allowlist.
MOST_RULES = 10_000


def redact_text(text: str, rules: list[tuple] = (), allowed: frozenset = frozenset()) -> str:
    """Text with its matches as [REDACTED:kind]. Overlapping matches are one, named by the most severe of them, the
    longest where severities tie. What a rule (kind, text, pattern) covers stays, and so do ``allowed`` (kind, n)."""
    spans = []
    for kind, severity, pattern in C.DETECTORS:
        if not any(hint in text for hint in C.DETECTOR_HINTS[kind]):
            continue
        for n, m in enumerate(re.finditer(pattern, text)):
            if (kind, n) in allowed or any((k is None or k == kind) and (t == m[0] or p is not None and re.search(p, m[0])) for k, t, p in rules):
                continue
            spans.append((m.start(), m.end(), (RANKS[severity], m.start() - m.end(), kind)))
    out, at, start, best = [], 0, None, None
    for first, last, name in sorted(spans):
        if start is not None and first < at:
            at, best = max(at, last), min(best, name)
            continue
        if start is not None:
            out.append(f"[REDACTED:{best[2]}]")
        out.append(text[at:first])
        start, at, best = first, last, name
    if start is not None:
        out.append(f"[REDACTED:{best[2]}]")
    return "".join([*out, text[at:]])


def redacted(text: Column, rules: list[tuple] = (), allowed: Column | None = None) -> Column:
    """Text with each match as [REDACTED:kind], in one pass over the row: see redact_text. Only texts with a match leave
    the JVM. allowed: structs (kind, n) of matches that stay."""
    any_match = F.lit(False)
    for kind, _, pattern in C.DETECTORS:
        any_match = any_match | (_hinted(kind, text) & text.rlike(for_spark(pattern)))
    rules = [tuple(r) for r in rules]

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series, kept: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redact_text(t, rules, frozenset((x["kind"], x["n"]) for x in k) if k is not None else frozenset()) for t, k in zip(texts, kept)], dtype=object)

    none = F.lit(None).cast("array<struct<kind:string,n:int>>")
    return F.coalesce(rewrite(F.when(any_match, text), none if allowed is None else allowed), text)


def redact(df: DataFrame, key: str, text: str, rules: DataFrame | None = None) -> DataFrame:
    """df with its text redacted; with rules, matches that one of them allows stay. A pass over the rows, without a join.

    Rules are a handful of rows that people write: they go to every task, MOST_RULES at most.
    """
    some = [] if rules is None else [(r.kind, r.text, r.pattern) for r in rules.select("kind", "text", "pattern").limit(MOST_RULES + 1).collect()]
    if len(some) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return df.withColumn(text, redacted(F.col(text), some))


def redact_spans(df: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    """df with its text redacted at spans (key, kind, severity, start, end), such as those that no rule allows.

    Overlapping spans are one, named by the most severe of them, the longest where severities tie.
    """
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    listed = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("start"), F.col("end"), rank.alias("rank"), (F.col("start") - F.col("end")).alias("size"), F.col("kind")))).alias("spans"))
    joined = F.expr(
        "aggregate(spans, array(), (acc, s) -> case when size(acc) > 0 and element_at(acc, -1).end > s.start"
        " then concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end),"
        " 'best', least(element_at(acc, -1).best, struct(s.rank as rank, s.size as size, s.kind as kind)))))"
        " else concat(acc, array(named_struct('start', s.start, 'end', s.end, 'best', struct(s.rank as rank, s.size as size, s.kind as kind)))) end)".replace("array(), (acc", "cast(array() as array<struct<start:int,end:int,best:struct<rank:int,size:int,kind:string>>>), (acc")
    )
    rebuilt = F.expr(f"aggregate(merged, struct('' as done, 0 as at), (a, s) -> struct(concat(a.done, substring({text}, a.at + 1, s.start - a.at), '[REDACTED:', s.best.kind, ']') as done, s.end as at), a -> concat(a.done, substring({text}, a.at + 1)))")
    return df.join(listed, key, "left").withColumn("merged", joined).withColumn(text, F.when(F.col("spans").isNull(), F.col(text)).otherwise(rebuilt)).drop("spans", "merged")


def privacy_summary(findings: DataFrame) -> DataFrame:
    """Effective findings (count) and allowed ones by severity and kind, by severity, and in all (nulls), in one pass."""
    allowed = F.col("allowlisted") if "allowlisted" in findings.columns else F.lit(False)
    marked = findings.select("severity", "kind", allowed.alias("allowed"))
    return marked.rollup("severity", "kind").agg(F.count_if(~F.col("allowed")).alias("count"), F.count_if("allowed").alias("allowlisted_count"))


def gate(docs: DataFrame, findings: DataFrame, key: str, text: str, mode: str) -> tuple[DataFrame, DataFrame]:
    """(documents that pass, keys that are skipped): warn passes all, redact rewrites, fail drops what is high-risk.

    findings: those of scan, with or without allowlisted; what a rule allows is neither redacted nor a reason to drop.
    """
    risky = high_risk(findings, key)
    none = risky.limit(0)
    if mode == "warn":
        return docs, none
    if mode == "redact":
        if "allowlisted" not in findings.columns:
            return docs.withColumn(text, redacted(F.col(text))), none
        allowed = findings.where("allowlisted").groupBy(F.col(key).alias("_key")).agg(F.collect_set(F.struct("kind", F.col("n").cast("int").alias("n"))).alias("_allowed"))
        marked = docs.join(allowed, F.col(key) == F.col("_key"), "left")
        return marked.withColumn(text, redacted(F.col(text), (), F.col("_allowed"))).drop("_key", "_allowed"), none
    if mode == "fail":
        return docs.join(risky, key, "left_anti"), docs.select(key).join(risky, key, "left_semi")
    raise ValueError(f"no such mode: {mode}")


def anonymous_id(salt: str, path: Column, session_id: Column) -> Column:
    zero = F.lit("\x00")
    return F.concat(F.lit("sample-"), F.substring(F.sha2(F.concat(F.lit(salt), zero, path, zero, session_id), 256), 1, 16))


def hide_known_paths(text: Column, paths: list[str]) -> Column:
    """Text with known paths replaced, the longest first, in both slash forms."""
    for path in sorted(set(paths), key=lambda p: (-len(p), p)):
        for form in dict.fromkeys((path, path.replace("\\", "/"), path.replace("/", "\\"))):
            text = F.replace(text, F.lit(form), F.lit("[path]"))
    return text
