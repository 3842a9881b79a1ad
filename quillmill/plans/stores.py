"""Queries over what is exported, stored, checked and kept: files are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill import storage
from quillmill.operators import blobs, export, privacy, stats, summary, vectors
from quillmill.plans import sql as S
from quillmill.plans.queries import TERMS, _chat, _query, bm25_top
from quillmill.plans.transcripts import _SQL, _parsed
from quillmill.sources import tables as T
from quillmill.sources import transcripts


@_query(f"WITH {S.CHAT} SELECT session_id, cwd, count(*) AS events, min(event_id) AS first_event, arg_min(coalesce(text_content, ''), event_id) AS first_text FROM sess JOIN chat USING (session_id) GROUP BY session_id, cwd")
def exported_json(spark, d):
    """What the JSON of each session says of its events."""
    value = export.export_json(*_chat(spark, d))
    events = F.from_json(F.get_json_object("value", "$.events"), "array<struct<event_id:long,text_content:string>>")
    rows = value.select("session_id", F.get_json_object("value", "$.session.cwd").alias("cwd"), events.alias("e"))
    return rows.select("session_id", "cwd", F.size("e").alias("events"), F.col("e")[0]["event_id"].alias("first_event"), F.coalesce(F.col("e")[0]["text_content"], F.lit("")).alias("first_text"))


@_query(f"WITH {S.CHAT} SELECT event_id, session_id, top_type, coalesce(text_content, '') AS text FROM chat")
def exported_lines(spark, d):
    """Events, written as JSON lines and read back."""
    path = storage.new_path(spark, "jsonl")
    export.export_jsonl(_chat(spark, d)[1], path)
    return spark.read.schema("event_id long, session_id string, top_type string, text_content string").json(path).select("event_id", "session_id", "top_type", F.coalesce("text_content", F.lit("")).alias("text"))


@_query(f"WITH {S.CHAT} SELECT event_id, top_type, coalesce(text_content, '') AS text FROM chat")
def exported_csv(spark, d):
    """Events, written as CSV, with quotes and line ends in their texts, and read back."""
    path = storage.new_path(spark, "csv")
    export.export_csv(_chat(spark, d)[1], path)
    back = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("lineSep", "\n").csv(path)
    return back.select(F.col("event_id").cast("long").alias("event_id"), "top_type", F.coalesce("text_content", F.lit("")).alias("text"))


@_query(f"WITH {S.CHAT} SELECT 'references/' || session_id || '.md' AS name, session_id FROM sess")
def packet_pages(spark, d):
    """The pages of sessions in a packet."""
    return export.render_packet(*_chat(spark, d)).where("session_id is not null").select("name", "session_id")


@_query(f"WITH {_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS place FROM ev WHERE k = 2) SELECT session_id, place, line_no, {S.short('substring(text_content, 7)', 220)} AS command, 'shell' AS tool FROM c WHERE place <= 12 AND length(text_content) > 6")
def key_commands(spark, d):
    """The first calls of each session, by their arguments."""
    events = _parsed(spark, d)[0].withColumn("f", F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).cast("long"))
    named = events.withColumn("session_id", F.when(F.col("f") % 4 != 3, F.concat(F.lit("s-"), "f")).otherwise(F.col("f").cast("string"))).withColumn("event_id", F.col("line_no").cast("long"))
    found = summary.key_commands(named).where("command <> 'shell'")
    return found.select("session_id", "place", F.col("event_id").alias("line_no"), "command", "tool")


@_query("WITH r AS (SELECT strftime(ts, '%Y-%m-%d %H') AS generated_at, count(*) AS files, count(DISTINCT user_id) AS events, sum(event_id % 3) AS warnings FROM events GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY generated_at DESC) AS k FROM r) SELECT a.generated_at, a.files, a.events, a.warnings::BIGINT AS warnings, a.files - b.files AS delta_files, a.events - b.events AS delta_events, (a.warnings - b.warnings)::BIGINT AS delta_warnings, 'ok' AS status FROM n a JOIN n b ON a.k = 1 AND b.k = 2")
def audit_history(spark, d):
    """The last hourly report and its differences to the one before."""
    reports = T.table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("generated_at")).agg(F.count("*").alias("files"), F.count_distinct("user_id").alias("events"), F.sum(F.col("event_id") % 3).alias("warnings"))
    return stats.audit_history(reports)


def _faulty(spark, d):
    """References to the blobs of all documents, and a store in which some are missing, and some have another content."""
    docs = T.table(spark, d, "documents").where("text is not null")
    refs = docs.select("doc_id", F.sha2("text", 256).alias("blob_id"), F.octet_length("text").cast("long").alias("original_bytes"), "text")
    first = refs.groupBy("blob_id").agg(F.min("doc_id").alias("doc_id"), F.min("original_bytes").alias("original_bytes"), F.min("text").alias("text"))
    k = F.col("doc_id") % 10
    content = F.when(k == 3, F.concat("text", F.lit("!"))).when(k == 4, F.concat(F.expr("substring(text, 2)"), F.lit("~"))).otherwise(F.col("text")).cast("binary")
    stored = first.where(k != 7).select("blob_id", content.alias("content"), "original_bytes", F.concat(F.lit("/store/"), "blob_id").alias("path"))
    return refs.select("blob_id").distinct(), stored


_FAULTY = "f AS (SELECT sha256(text) AS blob_id, min(doc_id) % 10 AS k, min(text) AS t FROM documents WHERE text IS NOT NULL GROUP BY 1), e AS (SELECT *, k = 4 AND octet_length(encode(substring(t, 2) || '~')) <> octet_length(encode(t)) AS other FROM f)"


@_query(f"WITH {_FAULTY} SELECT blob_id, CASE WHEN k = 7 THEN 'missing_blob' WHEN k = 3 OR other THEN 'size_mismatch' ELSE 'hash_mismatch' END AS error FROM e WHERE k = 7 OR k = 3 OR k = 4 AND substring(t, 2) || '~' <> t")
def blob_errors(spark, d):
    """References to blobs that are missing, or whose size or hash is wrong."""
    refs, stored = _faulty(spark, d)
    return blobs.verify_blobs(refs, stored)


@_query(f"WITH {_FAULTY} SELECT '/store/' || blob_id AS path FROM f WHERE k = 7")
def orphan_blob_files(spark, d):
    """Files of the store that its table does not name."""
    refs, stored = _faulty(spark, d)
    return blobs.orphan_files(refs.select(F.concat(F.lit("/store/"), "blob_id").alias("path")), stored)


@_query("WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages) SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 9 = 0 THEN 'missing' WHEN page_id % 9 = 1 THEN 'size_mismatch' ELSE 'hash_mismatch' END AS error FROM p WHERE page_id % 9 < 3")
def manifest_errors(spark, d):
    """Artefacts of a manifest that are missing, of another size or of another content."""
    pages = T.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), (F.col("page_id") % 9).alias("k"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("bytes"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha256"))
    have = pages.where("k <> 0").select("path", (F.col("bytes") + F.when(F.col("k") == 1, 1).otherwise(0)).alias("bytes"), F.when(F.col("k") == 2, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    return blobs.verify_manifest(pages.drop("k"), have)


@_query(r"SELECT doc_id, replace(replace(replace(replace(replace('in /home/me/work/' || source || ' and /home/me, C:\data\x or C:/data/x', '/home/me/work', '[path]'), '\home\me\work', '[path]'), 'C:\data', '[path]'), 'C:/data', '[path]'), '/home/me', '[path]') AS text FROM documents")
def hidden_known_paths(spark, d):
    """Texts without the paths that are known, the longest first, in both slash forms."""
    text = F.concat(F.lit("in /home/me/work/"), "source", F.lit(" and /home/me, C:\\data\\x or C:/data/x"))
    return T.table(spark, d, "documents").select("doc_id", privacy.hide_known_paths(text, ["/home/me", "/home/me/work", "C:\\data"]).alias("text"))


@_query(f"WITH {S.POSTINGS}, {S.bm25(TERMS)}, ttop AS (SELECT event_id, score, text FROM scored JOIN documents ON doc_id = event_id ORDER BY score DESC, event_id LIMIT 20), legs AS (SELECT 'fts:' || event_id AS id, round((1 / (1 + score)) / max(1 / (1 + score)) OVER (), 6) AS fts_score, CASE WHEN event_id % 2 = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS same_project, CASE WHEN contains(lower(text), 'the.') THEN 1.0::DOUBLE ELSE 0.0 END AS exact_hint FROM ttop) SELECT id, fts_score, round(least(1.0, 0.65::DOUBLE * fts_score + 0.05::DOUBLE * same_project + 0.05::DOUBLE * exact_hint), 6) AS score FROM legs")
def hybrid_without_vectors(spark, d):
    """Hybrid ranking where there is no vector index: the text leg alone."""
    top = bm25_top(spark, d).join(T.table(spark, d, "documents").select(F.col("doc_id").alias("event_id"), "text"), "event_id")
    text = top.select(F.col("event_id").alias("id"), (-F.col("score")).alias("rank"), "text", F.concat(F.lit("p"), F.col("event_id") % 2).alias("project"))
    return vectors.hybrid_rank(text, None, "the.", "p1").select("id", "fts_score", "score")


@_query("SELECT vec_id AS chunk_id, 's' || vec_id % 50 AS session_id, CASE WHEN vec_id % 50 < 10 THEN 'new' ELSE 'old' END AS text, 64::BIGINT AS dimensions FROM embeddings WHERE vec_id % 50 >= 10 OR vec_id % 3 = 0")
def stored_chunks(spark, d):
    """A stored vector table in which some sessions' chunks were replaced by fewer ones."""
    path = storage.new_path(spark, "vectors")
    chunks = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("s"), F.col("vec_id") % 50).alias("session_id"), F.lit("old").alias("text"), F.col("embedding").alias("vector"))
    vectors.store_chunks(chunks, path, "hash")
    vectors.store_chunks(chunks.where("chunk_id % 50 < 10 and chunk_id % 3 = 0").withColumn("text", F.lit("new")), path, "hash")
    return vectors.stored_chunks(spark, path, "hash", 64).select("chunk_id", "session_id", "text", "dimensions")


@_query("SELECT doc_id AS event_id, CASE WHEN doc_id % 4 = 0 THEN 'application/octet-stream' ELSE 'image/png' END AS media_type, sha256(text) AS blob_id, octet_length(encode(text)) AS bytes FROM documents WHERE doc_id % 4 <> 3 AND length(text) > 0")
def image_assets(spark, d):
    """Images of messages as assets: those whose base64 is broken stay where they are."""
    docs = T.table(spark, d, "documents").where("length(text) > 0")
    k = F.col("doc_id") % 4
    url = F.concat(F.when(k == 0, "data:;base64,").otherwise("data:image/png;base64,"), F.base64(F.col("text").cast("binary")), F.when(k == 3, "!").otherwise(""))
    part = lambda kind, url: F.struct(F.lit(kind).alias("type"), url.alias("image_url"))
    payload = F.to_json(F.struct(F.lit("message").alias("type"), F.array(part("input_text", F.lit(None).cast("string")), part("input_image", url)).alias("content")))
    found = blobs.extract_assets(docs.select(F.col("doc_id").alias("event_id"), payload.alias("payload")))
    return found.select("event_id", "media_type", "blob_id", F.octet_length("content").cast("long").alias("bytes"))


@_query("SELECT nullif(o_orderkey % 5, 0) AS kind, count(*) AS n, CASE WHEN o_orderkey % 5 = 0 THEN 'warning' ELSE 'record' END AS what FROM orders GROUP BY ALL")
def history_log(spark, d):
    """A log of JSON lines, some of them malformed, as records and warnings."""
    path = storage.new_path(spark, "history")
    k = F.col("o_orderkey") % 5
    T.table(spark, d, "orders").select(F.when(k == 0, F.concat(F.lit('{"kind": '), "o_orderkey")).otherwise(F.to_json(F.struct(k.alias("kind")))).alias("value")).write.text(path)
    records, warnings = transcripts.read_history(spark, path, "kind long")
    return records.groupBy("kind").agg(F.count("*").alias("n")).withColumn("what", F.lit("record")).union(warnings.agg(F.lit(None).cast("long").alias("kind"), F.count("*").alias("n")).withColumn("what", F.lit("warning")))
