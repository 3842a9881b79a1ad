"""WARC records in ZIP packages, read by ranges.

A package holds two stored (not compressed) members: ``archive/data.warc.gz``, one gzip member for each WARC record, and
``indexes/index.cdxj``, one JSON line for each record with its offset and length. The reader parses the ZIP directory
at the package's end (ZIP64 too), finds the members, and reads records by range; nothing is extracted.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import new_path, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _open(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def revisits(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """(page_id, digest, refers_to) of each page whose payload of at least ``min_bytes`` a smaller page_id has too."""
    payloads = pages.where(F.octet_length("payload") >= min_bytes).select("page_id", F.sha2("payload", 256).alias("digest"))
    first = payloads.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to")
    # a table of its own, so that Spark may split a digest that a large share of the pages has
    return payloads.join(written(first.drop("last"), "warc-first"), "digest").where("page_id > refers_to").distinct()


def record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP headers alone."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = "".join((url or "").split())
    more = "" if refers_to is None else f"WARC-Refers-To: {name(refers_to)}\r\nWARC-Profile: {PROFILE}\r\n"
    head = f"WARC/1.1\r\nWARC-Type: {'response' if refers_to is None else 'revisit'}\r\nWARC-Record-ID: {name(page_id)}\r\nWARC-Date: {date}\r\nWARC-Target-URI: {uri}\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}\r\n{more}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """page_id, payload (None in a revisit), payload_bytes, payload_digest, record_type, refers_to, url of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    number = lambda x: int(x) if (x := x.strip("<>").rpartition(":")[2]) else None
    kind = fields["warc-type"]
    return {"page_id": number(fields["warc-record-id"]), "payload": payload if kind == "response" else None, "payload_bytes": sizes[0], "payload_digest": fields["warc-payload-digest"].rpartition(":")[2], "record_type": kind, "refers_to": number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, "url": fields["warc-target-uri"]}


class _Package:
    """One package being written, under a name of its attempt's own: the list of files, which Spark commits, says which count."""

    def __init__(self, path: str, name: str) -> None:
        self.fs, root = _open(path)
        self.fs.create_dir(root, recursive=True)
        self.name = f"{name}-{uuid.uuid4().hex}.wacz"
        self.sink = self.fs.open_output_stream(f"{root}/{self.name}")
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index: list[str] = []
        self.size = 0

    def add(self, page_id, url, raw: bytes) -> None:
        packed = gzip.compress(raw, 6, mtime=0)
        self.data.write(packed)
        self.index.append(json.dumps({"page_id": page_id, "offset": self.size, "length": len(packed)}))
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            index.write("".join(x + "\n" for x in self.index).encode())
        self.zip.close()
        self.sink.close()
        return self.name, len(self.index), self.size


def write_packages(pages: DataFrame, path: str, min_bytes: int = 100, most_bytes: int = 256 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each of pages (page_id, url, html) below ``path``; returns (file, n_records, bytes).

    A null html is an empty payload, a null url an empty one. Of equal payloads of at least ``min_bytes``, that with the
    smallest page_id is a response and the others revisit it; rows that repeat that page_id are responses too, as are
    rows without a page_id. Further columns are ignored; an empty table gives no package.
    """
    payloads = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    known = payloads.withColumn("digest", F.sha2("payload", 256)).join(revisits(payloads, min_bytes), ["page_id", "digest"], "left").select("page_id", "url", "payload", "refers_to")

    def write(parts):
        part, n, out = TaskContext.get().partitionId(), 0, None
        done = lambda p: pa.RecordBatch.from_pylist([dict(zip(("file", "n_records", "bytes"), p.close()))])
        for batch in parts:
            for k in range(0, batch.num_rows, 100):
                for row in batch.slice(k, 100).to_pylist():
                    if out is None:
                        out, n = _Package(path, f"part-{part:05d}-{n:04d}"), n + 1
                    out.add(row["page_id"], row["url"], record(row["page_id"], row["url"], row["payload"], row["refers_to"], date))
                    if out.size >= most_bytes:
                        yield done(out)
                        out = None
        if out is not None:
            yield done(out)

    return written(known.mapInArrow(write, "file string, n_records long, bytes long"), "warc-files")


def _at(file, offset: int, n: int) -> bytes:
    file.seek(offset)
    return file.read(n)


def members(file, size: int) -> dict[str, tuple[int, int]]:
    """The stored members of a ZIP file: name -> (offset of its data, bytes). Reads the directories alone."""
    tail = _at(file, max(0, size - 65_557), min(size, 65_557))
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no ZIP directory")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFF == entries or 0xFFFFFFFF in (length, offset):
        if tail[at - 20 : at - 16] != b"PK\x06\x07":
            raise ValueError("no ZIP64 directory")
        (end,) = struct.unpack_from("<Q", tail, at - 12)
        head = _at(file, end, 56)
        if head[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 directory")
        entries, length, offset = struct.unpack_from("<QQQ", head, 32)
    directory, found, p = _at(file, offset, length), {}, 0
    for _ in range(entries):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken ZIP directory")
        method = struct.unpack_from("<H", directory, p + 10)[0]
        packed, whole, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, p + 20)
        (local,) = struct.unpack_from("<I", directory, p + 42)
        name, extra = directory[p + 46 : p + 46 + n_name].decode(), directory[p + 46 + n_name : p + 46 + n_name + n_extra]
        k = 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # ZIP64: of each value that did not fit, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                whole = wide.pop(0) if whole == 0xFFFFFFFF else whole
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            k += 4 + n
        if method:
            raise ValueError(f"{name} is compressed")
        n_name_here, n_extra_here = struct.unpack_from("<HH", _at(file, local, 30), 26)
        found[name] = local + 30 + n_name_here + n_extra_here, packed
        p += 46 + n_name + n_extra + n_comment
    return found


def _file(fs, name: str):
    return fs.open_input_file(name)


def read_records(files: DataFrame, path: str, chunk_bytes: int = 16 << 20) -> DataFrame:
    """Reads packages back: page_id, payload_bytes, payload_digest, record_type and refers_to of each record.

    One pass reads directories and indexes; then stretches of ``chunk_bytes`` are dealt out and read record by record,
    each payload held against its digest.
    """

    def locate(parts):
        fs, root = _open(path)
        for batch in parts:
            for name in batch.column(0).to_pylist():
                with _file(fs, f"{root}/{name}") as file:
                    found = members(file, file.size())
                    data, (at, n) = found[DATA][0], found[INDEX]
                    lines = [json.loads(x) for x in _at(file, at, n).splitlines()]
                for k in range(0, len(lines), 5000):
                    some = lines[k : k + 5000]
                    offsets = [data + x["offset"] for x in some]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array([x // chunk_bytes for x in offsets], pa.int64()), pa.array(offsets, pa.int64()), pa.array([x["length"] for x in some], pa.int64())], ["file", "chunk", "offset", "length"])

    def read(parts):
        fs, root = _open(path)
        name, file = None, None
        for batch in parts:
            for k in range(0, batch.num_rows, 2000):
                rows = []
                for row in batch.slice(k, 2000).to_pylist():
                    if row["file"] != name:
                        name, file = row["file"], _file(fs, f"{root}/{row['file']}")
                    x = parse(zlib.decompress(_at(file, row["offset"], row["length"]), 31))
                    payload = x.pop("payload")
                    if payload is not None and hashlib.sha256(payload).hexdigest() != x["payload_digest"]:
                        raise ValueError(f"{name}: the record of page {x['page_id']} is broken")
                    rows.append(x)
                columns = [c.split()[0] for c in RECORDS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], pa.string() if c in ("payload_digest", "record_type") else pa.int64()) for c in columns], columns)

    # numbers of partitions that are asked for stay as they are, however small the rows: a task for each package, and for
    # each of the stretches to read
    n_files, n_bytes = files.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = n_files + n_bytes // chunk_bytes
    located = files.select("file").repartition(max(1, n_files)).mapInArrow(locate, "file string, chunk long, offset long, length long")
    return located.repartition(max(1, tasks), "file", "chunk").sortWithinPartitions("file", "offset").mapInArrow(read, RECORDS)


def op8_warc_zip(spark, sf_dir: str) -> DataFrame:
    """Writes all pages as WARC records in ZIP packages and returns what the packages hold of each page."""
    path = new_path(spark, "warc")
    return read_records(write_packages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path), path)


OP8_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
