"""Content-addressed payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalize import parts_text


def blobs(df: DataFrame, payload: str, stored: DataFrame | None = None) -> DataFrame:
    """blob_id, content, original_bytes of each distinct payload that is not stored yet. The hash is taken before rows meet."""
    hashed = df.where(F.col(payload).isNotNull()).select(F.sha2(payload, 256).alias("blob_id"), F.col(payload).alias("content"))
    new = hashed if stored is None else hashed.join(stored.select("blob_id"), "blob_id", "left_anti")
    return new.dropDuplicates(["blob_id"]).withColumn("original_bytes", F.octet_length("content").cast("long"))


#: Calls keep these strings at any length; of these others, the length and hash stand for the string.
KEPT_WHOLE, MEASURED = ("name", "call_id", "status"), ("arguments", "input")


def _small(entries: str, chars: int, whole: tuple[str, ...] = ()) -> str:
    """SQL: of a map of variants, the scalars, the short strings, and the strings under some keys."""
    kept = ", ".join(f"'{k}'" for k in whole) or "''"
    string = f"schema_of_variant(v) = 'STRING' and (length(cast(v as string)) <= {chars} or k in ({kept}))"
    scalar = "schema_of_variant(v) in ('VOID', 'BOOLEAN', 'BIGINT', 'DOUBLE') or schema_of_variant(v) like 'DECIMAL%'"
    return f"map_filter({entries}, (k, v) -> v is null or {scalar} or {string})"


def _text_at(key: str) -> Column:
    """The value under a key if it is a string."""
    return F.expr(f"case when schema_of_variant(try_variant_get(rec, '$.{key}', 'variant')) = 'STRING' then try_variant_get(rec, '$.{key}', 'string') end")


def _slim_part(part: Column, chars: int) -> Column:
    """JSON of what is kept of a part of a message."""
    get = lambda key: F.try_variant_get(part, f"$.{key}", "string")
    is_text = lambda key: F.schema_of_variant(F.try_variant_get(part, f"$.{key}", "variant")) == "STRING"
    kind = F.coalesce(F.when(get("type") != "", get("type")), F.lit("unknown"))
    content = F.try_to_binary(F.regexp_extract(get("image_url"), "(?s)^data:[^,]*;base64,(.*)$", 1), F.lit("base64"))
    image = F.to_json(F.struct(kind.alias("type"), F.sha2(content, 256).alias("asset_ref"), _media(get("image_url")).alias("media_type"), F.octet_length(content).alias("bytes"), get("detail").alias("detail")))
    is_image = (kind == "input_image") & get("image_url").startswith("data:") & get("image_url").contains(";base64,") & content.isNotNull()
    text = F.to_json(F.struct(kind.alias("type"), F.length(get("text")).alias("chars"), F.sha2(get("text"), 256).alias("sha256")))
    other = F.to_json(F.map_filter(F.try_variant_get(part, "$", "map<string,variant>"), lambda k, v: v.isNull() | ~(F.schema_of_variant(v).startswith("OBJECT") | F.schema_of_variant(v).startswith("ARRAY") | ((F.schema_of_variant(v) == "STRING") & (F.length(F.try_variant_get(v, "$", "string")) > chars)))))
    whole = F.schema_of_variant(part)
    names = F.when(whole == "STRING", "str").when(whole == "BIGINT", "int").when(whole == "BOOLEAN", "bool").when(whole == "VOID", "NoneType").when(whole.startswith("ARRAY"), "list").otherwise("float")
    return F.when(~whole.startswith("OBJECT"), F.to_json(F.struct(names.alias("type")))).when(F.coalesce(is_image, F.lit(False)), image).when(F.coalesce(is_text("text"), F.lit(False)), text).otherwise(other)


def _media(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, "^data:([^;,]*)", 1), F.lit("")), F.lit("application/octet-stream"))


def slim_payload(events: DataFrame, payload: str = "payload", chars: int = 256) -> DataFrame:
    """events with slim: what the hot store keeps of each payload, as JSON with sorted keys; null where it is no object.

    Scalars and strings of at most ``chars`` characters stay. A call keeps its name, call_id and status whole, and of
    its arguments or input the length and hash. Of a message's content each part is kept as its type, length and hash;
    a decoded image as a reference to its blob, media type and bytes; other parts as their scalars.
    """
    kind = F.expr("coalesce(try_variant_get(rec, '$.type', 'string'), '')")
    top = F.expr("case when schema_of_variant(rec) like 'OBJECT%' then cast(rec as map<string, variant>) end")
    rows = events.withColumn("rec", F.try_parse_json(payload)).withColumn("top", top)
    call = kind.isin("function_call", "custom_tool_call")
    small = F.when(call, F.expr(_small("top", chars, KEPT_WHOLE))).otherwise(F.expr(_small("top", chars)))
    measured = [
        F.when(call & _text_at(key).isNotNull(), F.map_from_entries(F.array(F.struct(F.lit(f"{key}_chars"), F.parse_json(F.length(_text_at(key)).cast("string"))), F.struct(F.lit(f"{key}_sha256"), F.parse_json(F.concat(F.lit('"'), F.sha2(_text_at(key), 256), F.lit('"')))))))
        for key in MEASURED
    ]
    content = F.when((kind == "message") & F.expr("schema_of_variant(try_variant_get(rec, '$.content', 'variant')) like 'ARRAY%'"), F.transform(F.expr("try_variant_get(rec, '$.content', 'array<variant>')"), lambda p: _slim_part(p, chars)))
    listed = F.when(F.size(content) > 0, F.map_from_entries(F.array(F.struct(F.lit("content"), F.parse_json(F.concat(F.lit("["), F.array_join(content, ","), F.lit("]")))))))
    none = F.expr("cast(map() as map<string, variant>)")
    taken = lambda k: ((k == "content") & listed.isNotNull()) | F.array_contains(F.array_distinct(F.flatten(F.array(*[F.coalesce(F.map_keys(m), F.array().cast("array<string>")) for m in measured]))), k)
    merged = F.map_concat(F.map_filter(small, lambda k, v: ~taken(k)), *[F.coalesce(m, none) for m in measured], F.coalesce(listed, none))
    slim = F.when(F.col("top").isNotNull(), F.to_json(F.parse_json(F.to_json(merged))))
    return rows.withColumn("slim", slim).drop("rec", "top")


def extract_assets(events: DataFrame, payload: str = "payload") -> DataFrame:
    """event_id, part, media_type, content, blob_id of images in message contents. Broken base64 stays where it is."""
    parts = events.select("event_id", F.posexplode(F.from_json(F.get_json_object(payload, "$.content"), "array<struct<type:string,image_url:string>>")).alias("part", "p"))
    url = F.col("p.image_url")
    media = _media(url)
    content = F.try_to_binary(F.regexp_extract(url, "(?s)^data:[^,]*;base64,(.*)$", 1), F.lit("base64"))
    found = parts.where(url.startswith("data:") & url.contains(";base64,")).select("event_id", "part", media.alias("media_type"), content.alias("content")).where("content is not null")
    return found.withColumn("blob_id", F.sha2("content", 256))


def hydrate(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Events with their whole payloads, and the text that these hold, where the hot store cut either."""
    whole = stored.select(F.col("blob_id").alias("payload_ref"), F.col("content").cast("string").alias("whole"))
    joined = events.join(whole, "payload_ref", "left").withColumn("rec", F.try_parse_json("whole"))
    text = F.coalesce(F.nullif(F.expr("coalesce(try_variant_get(rec, '$.output', 'string'), try_variant_get(rec, '$.message', 'string'), try_variant_get(rec, '$.text', 'string'))"), F.lit("")), F.nullif(parts_text("content"), F.lit("")))
    return joined.withColumn("payload", F.coalesce("whole", "payload")).withColumn("text_content", F.coalesce(text, "text_content")).drop("whole", "rec")


def event_detail(events: DataFrame, stored: DataFrame, event_id: int) -> DataFrame:
    return hydrate(events.where(F.col("event_id") == event_id), stored)


def referenced(events: DataFrame, payload: str = "payload") -> DataFrame:
    """blob_id of all references: payload_ref, and hashes under keys that end in _ref, at any depth of payloads.

    Payloads are parsed and written anew, so that neither white space nor escapes hide a key; what is no JSON is
    searched as it is. A key is read from its last quote or backslash on, which is enough to tell that it is one: Java's
    engine would call itself for each character of a string that is read in alternatives, and run out of stack.
    """
    plain = F.coalesce(F.to_json(F.try_parse_json(payload)), F.col(payload), F.lit(""))
    inner = F.regexp_extract_all(plain, F.lit(r'["\\][^"\\]*_ref"\s*:\s*"([0-9a-fA-F]{64})"'), 1)
    own = F.when(F.col("payload_ref").isNotNull(), F.array("payload_ref")).otherwise(F.array().cast("array<string>"))
    return events.select(F.explode(F.concat(own, inner)).alias("blob_id")).distinct()


def unreferenced_blobs(stored: DataFrame, refs: DataFrame) -> DataFrame:
    return stored.join(refs, "blob_id", "left_anti")


def verify_blobs(refs: DataFrame, stored: DataFrame, deep: bool = True) -> DataFrame:
    """blob_id, error: references to blobs that are missing, or whose size or (deep) hash is wrong."""
    bad = F.when(F.col("there").isNull(), "missing_blob").when(F.octet_length("content") != F.col("original_bytes"), "size_mismatch")
    if deep:
        bad = bad.when(F.sha2("content", 256) != F.col("blob_id"), "hash_mismatch")
    return refs.join(stored.withColumn("there", F.lit(True)), "blob_id", "left").withColumn("error", bad).where("error is not null").select("blob_id", "error")


def orphan_files(inventory: DataFrame, stored: DataFrame) -> DataFrame:
    """Files of an inventory that no blob's path names."""
    return inventory.join(stored.select("path"), "path", "left_anti")


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, error of artefacts (path, bytes, sha256) that differ from the files."""
    have = files.select("path", F.col("bytes").alias("have_bytes"), F.col("sha256").alias("have_sha256"), F.lit(True).alias("there"))
    error = F.when(F.col("there").isNull(), "missing").when(F.col("bytes") != F.col("have_bytes"), "size_mismatch").when(F.col("sha256") != F.col("have_sha256"), "hash_mismatch")
    return manifest.join(have, "path", "left").withColumn("error", error).where("error is not null").select("path", "error")


#: Bits of a Bloom filter for each hash, and how many of them a hash sets: one in a hundred others seems to be there.
BLOOM_BITS, BLOOM_HASHES = 10, 7


def bloom_places(ids: DataFrame, bits: Column) -> DataFrame:
    """ids (blob_id) with word and bit of each of a hash's places in a filter of ``bits`` bits."""
    place = lambda k: F.pmod(F.xxhash64(F.lit(k), F.col("blob_id")), bits)
    return ids.withColumn("p", F.explode(F.array(*[place(k) for k in range(BLOOM_HASHES)]))).withColumn("word", F.expr("p div 64")).withColumn("bit", F.expr("shiftleft(1L, cast(p % 64 as int))")).drop("p")


def bloom(ids: DataFrame, size: int) -> DataFrame:
    """word, bits: a Bloom filter of hashes (blob_id) in ``size`` bits, the words without a bit left out."""
    return bloom_places(ids.select("blob_id"), F.lit(size).cast("long")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
