"""A full-text index that imports keep up to date: immutable segments of postings in a versioned archive.

An update writes the postings of its own sessions as a segment, sorted by term; the sessions' older postings are dead
from then on. Of each session the index knows how many events it has and how long they are, so that totals are sums over
sessions. Segments of like size are merged, as in any archive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archive import Archive
from .search import StoredIndex, postings, terms

FIELDS = ("tool_name", "file_path", "indexed_text")
#: By what tables are dealt to files, in ranges, and sorted: a frequent term has as many files as it needs.
LAYOUT = {"postings": ("term", "event_id")}


class SearchIndex(StoredIndex):
    """The index below ``path``, as its last version is; stands wherever an index of postings does."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.archive = Archive(spark, path, layout=LAYOUT)

    @property
    def totals(self) -> DataFrame:
        """One row: n, mean of the lengths of the events that hold a term."""
        return self.archive.read("documents").agg(F.coalesce(F.sum("docs"), F.lit(0)).cast("long").alias("n"), (F.sum("length") / F.sum("docs")).alias("mean"))

    @property
    def postings(self) -> DataFrame:
        return self.archive.read("postings")

    def of(self, wanted: list[str]) -> DataFrame:
        """The postings of some terms: constants, from which Spark knows the files and row groups to read."""
        return self.postings.where(F.col("term").isin(list(wanted)))


def session_documents(events: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """session_id, docs (events that hold a term), length (their terms), events and last_event of each session."""
    size = sum((F.size(terms(F.col(f))) for f in fields[1:]), F.size(terms(F.col(fields[0]))))
    sized = events.select("session_id", "event_id", size.cast("long").alias("size"))
    return sized.groupBy("session_id").agg(F.count_if(F.col("size") > 0).alias("docs"), F.sum("size").alias("length"), F.count("*").alias("events"), F.max("event_id").alias("last_event"))


def update_index(events: DataFrame, path: str, fields: tuple[str, ...] = FIELDS) -> int:
    """Indexes the events of some sessions (session_id, event_id and the fields), in place of what the index has of these
    sessions, and returns the version. Whole sessions; what is written is in proportion to them."""
    keyed = events.withColumn("key", F.struct("session_id", "event_id"))
    rows = postings(keyed, fields, "key").select("key.*", "term", "field", "tf", "positions", "length")
    return Archive(events.sparkSession, path, layout=LAYOUT).write({"documents": session_documents(events, fields), "postings": rows})


def index_gap(events: DataFrame, path: str) -> DataFrame:
    """session_id of the sessions that the index lacks or has in another state than the archive's events."""
    now = events.groupBy("session_id").agg(F.count("*").alias("events"), F.max("event_id").alias("last_event"))
    known = Archive(events.sparkSession, path, layout=LAYOUT).read("documents")
    return now.select("session_id") if known is None else now.join(known, ["session_id", "events", "last_event"], "left_anti").select("session_id")


def catch_up(events: DataFrame, path: str) -> int:
    """Indexes the sessions of an archive that the index lacks, as after an import that was cut off; how many there were."""
    gap = index_gap(events, path)
    n = gap.count()
    if n:
        update_index(events.join(gap, "session_id", "left_semi"), path)
    return n
