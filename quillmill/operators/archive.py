"""A versioned archive: append-only segments, and manifests that say which of them a version holds.

An import writes its rows below ``<table>/seg=<id>`` and commits by putting one manifest, ``_versions/<n>.json``, in one
step. A file that no manifest names is no part of the archive, so that a writer that is cut off anywhere leaves the
last version as it was and can be run again. Rows are never changed: a segment that brings a session anew names the
older segments' rows of it as dead (session_id, seg), and readers leave these out. Segments of like size are merged
when there are several, without the dead rows, so that an archive of n imports has some log(n) segments and each row is
written log(n) times.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmill.storage import estimated_bytes

from .blobs import BLOOM_BITS, bloom

#: Tables whose rows belong to no session: they are never dead.
UNOWNED = ("log", "blobs", "_blooms")
#: So many segments of one size class are merged into one.
FAN = 8


class Conflict(RuntimeError):
    """Another writer has put a version first."""


class Files:
    """What of the file system the archive needs."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.fs = self.at(path).getFileSystem(self.conf)

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        here = self.at(path)
        return [x.getPath().getName() for x in self.fs.listStatus(here)] if self.fs.exists(here) else []

    def size(self, path: str) -> int:
        here = self.at(path)
        return self.fs.getContentSummary(here).getLength() if self.fs.exists(here) else 0

    def age(self, path: str) -> float:
        """Seconds since the folder was changed."""
        return (self.jvm.java.lang.System.currentTimeMillis() - self.fs.getFileStatus(self.at(path)).getModificationTime()) / 1000

    def read(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, path: str, text: str) -> bool:
        """Writes a file beside its place and moves it there in one step; False if the place is taken."""
        aside = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(aside), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at(path).toUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        none = self.gateway.new_array(rename, 1)
        none[0] = rename.NONE
        try:
            context.rename(self.at(aside), self.at(path), none)
            return True
        except Exception as error:
            if "FileAlreadyExistsException" not in str(error):
                raise
            self.delete(aside)
            return False

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)


def owner(columns: list[str]):
    """Whose row it is: its session's, or, of a file without a session, the file's."""
    if "path" not in columns:
        return F.col("session_id")
    return F.coalesce("session_id", F.concat(F.lit("\x00"), F.col("path")))


class Archive:
    """The archive below ``path``. ``version``: one to read, the last one if None; it stays so for this object's life,
    so that its tables belong together."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None, layout: dict[str, tuple[str, ...]] | None = None):
        """layout: of some tables the columns by which they are dealt to files in ranges, and sorted."""
        self.spark, self.path, self.files, self.layout = spark, path.rstrip("/"), Files(spark, path), layout or {}
        known = self.versions()
        if version is not None and version not in known:
            raise ValueError(f"no such version: {version}")
        self.version = version if version is not None else max(known, default=0)
        self.manifest = json.loads(self.files.read(self._named(self.version))) if self.version else {"segments": {}, "dead": [], "last_event_id": 0}

    def versions(self) -> list[int]:
        return sorted(int(x.partition(".")[0]) for x in self.files.names(f"{self.path}/_versions") if x[0].isdigit())

    def _named(self, version: int) -> str:
        return f"{self.path}/_versions/{version:012d}.json"

    @property
    def last_event_id(self) -> int:
        return self.manifest["last_event_id"]

    def segments(self, name: str) -> dict[str, dict]:
        return {s: x["tables"][name] for s, x in self.manifest["segments"].items() if name in x["tables"]}

    def _stored(self, name: str, segments: dict[str, dict]) -> DataFrame | None:
        """Rows of a table in some segments, with seg; columns that older segments do not have are null."""
        if not segments:
            return None
        schema = StructType()
        for x in segments.values():
            for field in StructType.fromJson(x["schema"]).fields:
                if field.name not in schema.names:
                    schema = schema.add(field.name, field.dataType, True)
        reader = self.spark.read.schema(schema.add("seg", "string")).option("basePath", f"{self.path}/{name}")
        return reader.parquet(*[f"{self.path}/{name}/seg={s}" for s in segments])

    def _dead(self) -> DataFrame | None:
        return self.spark.read.schema("owner string, seg string").parquet(*[f"{self.path}/_dead/{x}" for x in self.manifest["dead"]]) if self.manifest["dead"] else None

    def read(self, name: str, segments: list[str] | None = None, with_seg: bool = False) -> DataFrame | None:
        """A table as this version has it; None if it has no segment of it. Only segments with dead rows meet a join."""
        chosen = {s: x for s, x in self.segments(name).items() if segments is None or s in segments}
        rows = self._stored(name, chosen)
        if rows is None:
            return None
        dirty = [s for s in chosen if self.manifest["segments"][s]["dead"]]
        if dirty and name not in UNOWNED:
            dead = self._dead().select(F.col("owner").alias("_owner"), F.col("seg").alias("_seg"))
            some = self._stored(name, {s: chosen[s] for s in dirty})
            key = owner(some.columns) if name != "_owners" else F.col("owner")
            some = some.join(dead, (key == F.col("_owner")) & (F.col("seg") == F.col("_seg")), "left_anti")
            clean = {s: x for s, x in chosen.items() if s not in dirty}
            rows = self._stored(name, clean).unionByName(some, allowMissingColumns=True) if clean else some
        if name == "blobs" and self.manifest.get("blobs_repeat"):
            rows = rows.dropDuplicates(["blob_id"])  # two writers at once may each have stored one
        return rows if with_seg else rows.drop("seg")

    def _put_table(self, df: DataFrame, name: str, seg: str) -> dict:
        """Writes one table of a segment: as many files as its size asks for, each sorted by session."""
        at = f"{self.path}/{name}/seg={seg}"
        by = "session_id" if "session_id" in df.columns else "blob_id" if "blob_id" in df.columns else None
        if name in self.layout:
            by = self.layout[name]
            rows = df.repartitionByRange(max(1, min(estimated_bytes(df) >> 26, 1 << 16)), *by).sortWithinPartitions(*by)
        else:
            rows = df.hint("rebalance", by).sortWithinPartitions(by) if by else df
        rows.write.option("compression", "zstd").parquet(at)
        return {"bytes": self.files.size(at), "schema": df.schema.jsonValue()}

    def _put_segment(self, frames: dict[str, DataFrame], seg: str) -> dict[str, dict]:
        """Writes the tables of a segment; beside blobs, the filter of their hashes."""
        tables = {name: self._put_table(df, name, seg) for name, df in frames.items()}
        if "blobs" in tables:
            ids = self._stored("blobs", {seg: tables["blobs"]}).select("blob_id")
            size = max(64, ids.count() * BLOOM_BITS)
            tables["_blooms"] = self._put_table(bloom(ids, size), "_blooms", seg)
            tables["blobs"]["bloom"] = size
        return tables

    def _put_dead(self, rows: DataFrame) -> tuple[str, dict[str, int]]:
        name = uuid.uuid4().hex
        rows.select("owner", "seg").distinct().coalesce(8).write.parquet(f"{self.path}/_dead/{name}")
        counts = self.spark.read.schema("owner string, seg string").parquet(f"{self.path}/_dead/{name}").groupBy("seg").count().collect()  # a row for each segment
        return name, {r.seg: r["count"] for r in counts}

    def _commit(self, manifest: dict) -> None:
        if not self.files.put(self._named(self.version + 1), json.dumps(manifest)):
            raise Conflict(f"version {self.version + 1} of {self.path} is another writer's; run again")
        self.version, self.manifest = self.version + 1, manifest

    def write(self, frames: dict[str, DataFrame]) -> int:
        """Adds a segment with these tables and commits a version, whose number is returned.

        Sessions in any of the tables replace what the archive holds of them in all tables; so do the files in
        frames["sessions"] with what it holds of them without a session. A writer that finds another one's version in its
        way takes that in and commits behind it, unless their event ids meet: then it raises Conflict, and the archive is
        as the other one left it.
        """
        seg, again = uuid.uuid4().hex, False
        tables = self._put_segment(frames, seg)
        held = {name: self._stored(name, {seg: x}) for name, x in tables.items()}
        owners = [df.select(owner(df.columns).alias("owner")) for name, df in held.items() if name not in UNOWNED]
        if "sessions" in held and "path" in held["sessions"].columns:
            owners.append(held["sessions"].select(F.concat(F.lit("\x00"), F.col("path")).alias("owner")))
        if owners:
            whole = owners[0]
            for x in owners[1:]:
                whole = whole.union(x)
            tables["_owners"] = self._put_table(whole.where("owner is not null").distinct(), "_owners", seg)
        last = held["events"].agg(F.max("event_id"), F.min("event_id")).first() if "events" in held and "event_id" in held["events"].columns else (None, None)
        while True:
            if last[1] is not None and last[1] <= self.last_event_id and self._others_since(last[1]):
                raise Conflict(f"events from {last[1]} on are another writer's; run again")
            manifest = json.loads(json.dumps(self.manifest))
            old = self.read("_owners", with_seg=True)
            if old is not None and "_owners" in tables:
                dead, counts = self._put_dead(old.join(self._stored("_owners", {seg: tables["_owners"]}).select("owner"), "owner", "left_semi"))
                if counts:
                    manifest["dead"].append(dead)
                    for s, n in counts.items():
                        manifest["segments"][s]["dead"] += n
            manifest["segments"][seg] = {"tables": tables, "dead": 0, "first_event_id": last[1]}
            manifest["last_event_id"] = max(self.last_event_id, last[0] or 0)
            manifest["blobs_repeat"] = manifest.get("blobs_repeat", False) or again and "blobs" in tables
            try:
                self._commit(manifest)
                break
            except Conflict:
                self.__init__(self.spark, self.path, None, self.layout)
                again = True
        self.merge_segments()
        return self.version

    def _others_since(self, first: int) -> bool:
        """Whether the archive has events with ids from first on that are not replaced ones: another writer's."""
        return any((x.get("first_event_id") or 0) >= first for x in self.manifest["segments"].values())

    def merge_segments(self, fan: int = FAN) -> None:
        """Merges segments of one size class, of ``fan`` times the size of the class below, where there are ``fan`` of
        them. Rows keep their values; dead ones, and what is known of them, go."""
        while True:
            classes: dict[int, list[str]] = {}
            for s, x in self.manifest["segments"].items():
                size, level = sum(t["bytes"] for t in x["tables"].values()) >> 20, 0
                while size >= fan:
                    size, level = size // fan, level + 1
                classes.setdefault(level, []).append(s)
            some = next((x for _, x in sorted(classes.items()) if len(x) >= fan), None)
            if some is None or not self._merge(some):
                return

    def compact(self) -> None:
        """Makes one segment of all."""
        if len(self.manifest["segments"]) > 1 or self.manifest["dead"]:
            self._merge(list(self.manifest["segments"]))

    def _merge(self, some: list[str]) -> bool:
        """Whether the merged segment is committed; False if another writer was first, whose version is then read."""
        seg = uuid.uuid4().hex
        names = sorted({t for s in some for t in self.manifest["segments"][s]["tables"]} - {"_blooms"})
        tables = self._put_segment({name: self.read(name, some) for name in names}, seg)
        manifest = json.loads(json.dumps(self.manifest))
        gone = [manifest["segments"].pop(s) for s in some]
        manifest["segments"][seg] = {"tables": tables, "dead": 0, "first_event_id": max((x.get("first_event_id") or 0 for x in gone), default=None)}
        if manifest["dead"]:
            name, counts = self._put_dead(self._dead().where(F.col("seg").isin(list(manifest["segments"]))))
            manifest["dead"] = [name] if counts else []
        try:
            self._commit(manifest)
            return True
        except Conflict:
            self.__init__(self.spark, self.path, None, self.layout)
            return False

    def vacuum(self, keep: int = 2, seconds: float = 86_400) -> list[str]:
        """Deletes versions but the last ``keep``, and folders that none of those names and that were not touched for
        some time, which a writer may still need. Returns what it deleted."""
        known = self.versions()
        kept = [json.loads(self.files.read(self._named(v))) for v in known[-keep:]]
        segments = {s for m in kept for s in m["segments"]}
        dead = {x for m in kept for x in m["dead"]}
        out = [self._named(v) for v in known[:-keep]]
        for name in self.files.names(self.path):
            for folder in self.files.names(f"{self.path}/{name}") if name != "_versions" else []:
                used = folder in dead if name == "_dead" else folder.partition("=")[2] in segments
                at = f"{self.path}/{name}/{folder}"
                if not used and self.files.age(at) >= seconds:
                    out.append(at)
        for at in out:
            self.files.delete(at)
        return out
