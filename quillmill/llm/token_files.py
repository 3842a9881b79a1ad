"""Token ids in Arrow files of fixed-size-list batches: equal-length sequences and masks at known places.

A part of the data set is two Arrow IPC files, written by one task:

* ``part-NNNNN-<id>.arrow``: batches of rows (ids: fixed_size_list<uint16 or uint32>[L], mask: fixed_size_list<bool>[L]).
  The ids of the part's documents lie end to end; only the last sequence is padded (id 0, mask false). Row r holds the
  ids from r * L on; a memory map gives any batch without a copy.
* ``part-NNNNN-<id>.docs.arrow``: (doc_id, offset, n_tokens) of each document, in the same order.

Parts are numbered in the order of doc_id. Each attempt of a task writes under an id of its own, and the manifest, which
Spark commits, names the files that count: nothing is renamed, and what a lost attempt leaves is never read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .scratch import new_path, written
from .tokens import batches, encoder

MANIFEST = "part int, file string, n_docs long, n_tokens long"
DOCS = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])


def _open(path: str):
    """The file system of a path or URI, and the path within it."""
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class _Sequences:
    """Gathers ids and writes them as batches of full sequences."""

    def __init__(self, sink, dtype, length: int, rows: int) -> None:
        self.length, self.full, self.dtype = length, length * rows, np.dtype(dtype)
        kind = pa.uint16() if self.dtype.itemsize == 2 else pa.uint32()
        self.kinds = pa.list_(kind, length), pa.list_(pa.bool_(), length)
        self.schema = pa.schema([("ids", self.kinds[0]), ("mask", self.kinds[1])])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.some: list[bytes] = []
        self.held = self.total = 0

    def add(self, ids: bytes) -> None:
        self.some.append(ids)
        n = len(ids) // self.dtype.itemsize
        self.held += n
        self.total += n
        if self.held >= self.full:
            flat = np.frombuffer(b"".join(self.some), self.dtype)
            whole = len(flat) // self.full * self.full
            for k in range(0, whole, self.full):
                self._write(flat[k : k + self.full], self.full)
            self.some, self.held = [flat[whole:].tobytes()], len(flat) - whole

    def _write(self, flat: np.ndarray, n: int) -> None:
        mask = np.arange(len(flat)) < n
        self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(flat), type=self.kinds[0]), pa.FixedSizeListArray.from_arrays(pa.array(mask), type=self.kinds[1])], schema=self.schema))

    def close(self) -> None:
        flat = np.frombuffer(b"".join(self.some), self.dtype)
        if len(flat):
            self._write(np.concatenate([flat, np.zeros(-len(flat) % self.length, self.dtype)]), len(flat))
        self.writer.close()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, length: int = 1024, rows: int = 256) -> DataFrame:
    """Encodes docs (doc_id, text), appends ``end_id`` to each, writes the files below ``path``, returns the manifest.

    Null and empty texts are the end id alone. Null ids come first; rows that repeat an id each have their own ids.
    Further columns are ignored; an empty table gives no rows and no files.
    """

    def encode(parts):
        known, part = encoder(tokenizer), TaskContext.get().partitionId()
        end, out = np.array([end_id], known.dtype).tobytes(), None
        for some in batches(_texts(parts)):
            out = out or _Part(path, part, known.dtype, length, rows)
            for (doc_id, _), ids in zip(some, known.ids([x for _, x in some])):
                out.add(doc_id, ids + end)
        if out is not None:
            yield out.close()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return written(ordered.mapInArrow(encode, MANIFEST), "token-manifest")


def _texts(parts):
    for batch in parts:
        for k in range(0, batch.num_rows, 500):
            ids, texts = (batch.slice(k, 500).column(c).to_pylist() for c in (0, 1))
            yield from ((i, x or "") for i, x in zip(ids, texts))


class _Part:
    """One part being written: its sequences and its documents."""

    def __init__(self, path: str, part: int, dtype, length: int, rows: int) -> None:
        self.fs, root = _open(path)
        self.fs.create_dir(root, recursive=True)
        self.part, self.itemsize = part, np.dtype(dtype).itemsize
        self.file = f"part-{part:05d}-{uuid.uuid4().hex}"
        self.sinks = [self.fs.open_output_stream(f"{root}/{self.file}{x}.arrow") for x in ("", ".docs")]
        self.sequences = _Sequences(self.sinks[0], dtype, length, rows)
        self.index = pa.ipc.new_file(self.sinks[1], DOCS)
        self.rows: list[tuple] = []
        self.n_docs = 0

    def add(self, doc_id, ids: bytes) -> None:
        self.rows.append((doc_id, self.sequences.total, len(ids) // self.itemsize))
        self.sequences.add(ids)
        self.n_docs += 1
        if len(self.rows) >= 4096:
            self._flush()

    def _flush(self) -> None:
        self.index.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*self.rows)], schema=DOCS))
        self.rows = []

    def close(self) -> pa.RecordBatch:
        if self.rows:
            self._flush()
        self.sequences.close()
        self.index.close()
        for sink in self.sinks:
            sink.close()
        return pa.RecordBatch.from_pydict({"part": pa.array([self.part], pa.int32()), "file": [self.file], "n_docs": pa.array([self.n_docs], pa.int64()), "n_tokens": pa.array([self.sequences.total], pa.int64())})


def _reader(fs, name: str):
    """An IPC file: mapped where it is local, else read by ranges."""
    return pa.ipc.open_file(pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name))


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """Reads the files of a manifest back: doc_id, start, n_tokens and ids_crc32 of each document.

    start counts all ids before the document, over all parts; ids_crc32 is the CRC-32 of the ids as little-endian
    unsigned 32-bit integers. A mask that does not fit the documents' lengths raises an error.
    """

    def read(parts):
        fs, root = _open(path)
        for batch in parts:
            for file, base, n_tokens in zip(*(batch.column(c).to_pylist() for c in range(3))):
                index, ids = _reader(fs, f"{root}/{file}.docs.arrow"), _Ids(_reader(fs, f"{root}/{file}.arrow"))
                for k in range(index.num_record_batches):
                    docs = index.get_batch(k)
                    crcs = [ids.crc32(n) for n in docs.column(2).to_pylist()]
                    start = pa.array(docs.column(1).to_numpy() + base)
                    yield pa.RecordBatch.from_arrays([docs.column(0), start, docs.column(2), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                if ids.seen != n_tokens or ids.left():
                    raise ValueError(f"{file}: masks and documents differ")

    # one row for each file: a window over all of them is small, whatever the files hold
    before = F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    files = manifest.select("file", F.coalesce(before, F.lit(0)).cast("long").alias("base"), "n_tokens")
    # a number of partitions that is asked for stays as it is: a task for each file, however small the rows are
    return files.repartition(max(1, files.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


class _Ids:
    """The ids of a file in order, batch by batch."""

    def __init__(self, reader) -> None:
        self.reader, self.k, self.seen = reader, 0, 0
        self.flat, self.at = np.zeros(0, "<u4"), 0

    def _more(self) -> bool:
        if self.k >= self.reader.num_record_batches:
            return False
        batch = self.reader.get_batch(self.k)
        mask = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        self.flat, self.at, self.k = batch.column(0).flatten().to_numpy()[mask].astype("<u4"), 0, self.k + 1
        return True

    def crc32(self, n: int) -> int:
        crc = 0
        while n:
            if self.at == len(self.flat) and not self._more():
                raise ValueError("a file ends within a document")
            some = self.flat[self.at : self.at + n]
            crc = zlib.crc32(some, crc)
            self.at += len(some)
            self.seen += len(some)
            n -= len(some)
        return crc

    def left(self) -> bool:
        return self.at < len(self.flat) or self.k < self.reader.num_record_batches


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    """Encodes all documents, writes the files, and returns what the files hold of each document."""
    return encode_and_read(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def encode_and_read(spark, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-files")
    return read_token_files(write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json")), path)
