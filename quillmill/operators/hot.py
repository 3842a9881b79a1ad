"""Hot and cold store at import: what an event keeps, and what goes into blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import constants as C
from quillmill.functions.text import is_any

from .archive import Archive
from .blobs import BLOOM_HASHES, bloom_places, extract_assets, slim_payload
from .policy import classify_storage, drop_stub, stored_text


def _kinds() -> tuple[Column, Column, Column, Column]:
    """Whether an event is noise, a compacted history, a message, or has its whole payload in the cold store."""
    top, sub = F.col("top_type"), F.col("sub_type")
    compacted = F.coalesce(top == "compacted", F.lit(False))
    message = F.coalesce((top == "response_item") & (sub == "message"), F.lit(False))
    cold = compacted | F.col("storage_class").isin("evidence", "quarantine")
    return F.col("storage_class") == "noise", compacted, message, cold


def _json_with(base: Column, extra: list[tuple[str, Column]]) -> Column:
    """JSON of an object with further keys, sorted."""
    more = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.parse_json(v)) for k, v in extra]))
    have = F.coalesce(F.try_variant_get(F.try_parse_json(base), "$", "map<string,variant>"), F.expr("cast(map() as map<string, variant>)"))
    return F.to_json(F.parse_json(F.to_json(F.map_concat(F.map_filter(have, lambda k, _: ~k.isin([k for k, _ in extra])), more))))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def to_hot(events: DataFrame) -> DataFrame:
    """events as the hot store keeps them: payload slim, text_content cut, with storage_class, payload_ref (the blob of
    the whole payload, where there is one), payload_original_bytes, text_original_chars and content_flags (sorted).

    Noise keeps a stub and no text. Compacted histories, evidence, metadata, unknown and large events have their whole
    payload in a blob; tool outputs keep their text's head and tail. Messages and calls are slim, what else is small is
    whole. A pass over each event's own row: no shuffle.
    """
    rows = slim_payload(classify_storage(events))
    noise, compacted, message, cold = _kinds()
    top, sub, payload = F.col("top_type"), F.col("sub_type"), F.coalesce("payload", F.lit(""))
    ref, size = F.sha2(payload, 256), F.octet_length(payload).cast("string")
    evidence = is_any(top, sub, C.EVIDENCE_TYPES)
    call = F.coalesce((top == "response_item") & sub.isin("function_call", "custom_tool_call"), F.lit(False))
    said = F.coalesce(F.get_json_object(payload, "$.message"), F.lit(""))
    history = F.coalesce(F.size(F.expr("try_variant_get(try_parse_json(payload), '$.replacement_history', 'array<variant>')")), F.lit(0))
    rest = F.to_json(F.map_filter(F.coalesce(F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>"), F.expr("cast(map() as map<string, variant>)")), lambda k, _: ~k.isin("replacement_history", "message")))
    short = _json_with(rest, [("message_chars", F.length(said).cast("string")), ("message_sha256", _quoted(F.sha2(said, 256))), ("replacement_history_count", F.greatest(history, F.lit(0)).cast("string")), ("cold_ref", _quoted(ref))])
    stub = _json_with(F.col("slim"), [("cold_ref", _quoted(ref)), ("original_bytes", size), ("original_sha256", _quoted(ref))])
    images = F.coalesce(F.col("slim").contains('"asset_ref"'), F.lit(False)) & message
    cut = evidence & (F.length("text_content") > C.TOOL_HEAD_CHARS + C.TOOL_TAIL_CHARS)
    flags = [("images_externalized", images), ("payload_cold", cold), ("payload_dropped", noise), ("payload_slimmed", ~noise & (message | call | (cold & (F.col("storage_class") != "quarantine")))), ("quarantined", F.col("storage_class") == "quarantine"), ("replacement_history_externalized", compacted), ("text_dropped", noise), ("text_truncated", cut)]
    kept = F.when(noise & payload.contains('"storage":"dropped"'), payload).when(noise, drop_stub(payload, "low_value_telemetry")).when(compacted, short).when(message | call, F.coalesce("slim", "payload")).when(cold, stub).otherwise(F.col("payload"))
    return rows.select(
        *[F.col(c) for c in events.columns if c not in ("payload", "text_content", "storage_class")],
        F.when(noise, F.lit(None)).when(cut, stored_text(F.col("text_content"))).otherwise(F.col("text_content")).alias("text_content"),
        kept.alias("payload"),
        F.when(cold, ref).alias("payload_ref"),
        F.octet_length(payload).cast("long").alias("payload_original_bytes"),
        F.length(F.coalesce("text_content", F.lit(""))).cast("long").alias("text_original_chars"),
        "storage_class",
        F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in flags]), lambda x: x.isNotNull()).alias("content_flags"),
    )


def cold_blobs(events: DataFrame) -> DataFrame:
    """blob_id, kind, content, original_bytes of what to_hot takes out of whole events: payloads and images, each once."""
    rows = classify_storage(events)
    _, compacted, message, cold = _kinds()
    top, sub = F.col("top_type"), F.col("sub_type")
    kind = F.when(compacted, "compacted_history").when(F.col("storage_class") == "quarantine", "unknown_event").when(top.isin(C.METADATA_TYPES), top).otherwise(F.concat_ws(":", top, F.coalesce(sub, F.lit("none"))))
    payloads = rows.where(cold).select(F.sha2(F.coalesce("payload", F.lit("")), 256).alias("blob_id"), kind.alias("kind"), F.coalesce("payload", F.lit("")).cast("binary").alias("content"))
    images = extract_assets(rows.where(message)).select("blob_id", F.concat(F.lit("asset:"), F.col("media_type")).alias("kind"), "content")
    return payloads.union(images).dropDuplicates(["blob_id"]).withColumn("original_bytes", F.octet_length("content").cast("long"))


def new_blobs(found: DataFrame, archive: Archive) -> DataFrame:
    """The blobs that an archive has not yet. Hashes are looked up in the filters beside its segments, a word for some
    six stored hashes, and only those that seem to be there in the store's own column of hashes. No content is read."""
    segments = {s: x["bloom"] for s, x in archive.segments("blobs").items() if "bloom" in x}
    if not segments:
        return found
    ids = found.select("blob_id")
    sizes = F.array(*[F.struct(F.lit(s).alias("seg"), F.lit(n).cast("long").alias("size")) for s, n in segments.items()])
    asked = bloom_places(ids.withColumn("s", F.explode(sizes)).select("blob_id", "s.*"), F.col("size"))
    filters = archive._stored("_blooms", archive.segments("_blooms"))
    hits = asked.join(filters, ["seg", "word"]).where("bits & bit <> 0")
    maybe = hits.groupBy("blob_id", "seg").agg(F.count("*").alias("n")).where(F.col("n") == BLOOM_HASHES).select("blob_id").distinct()
    there = archive.read("blobs").select("blob_id").join(maybe, "blob_id", "left_semi").distinct()
    return found.join(there, "blob_id", "left_anti")
