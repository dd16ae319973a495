"""The mapping cache as a stored table, in hash buckets.

Rows lie in ``buckets`` folders by a hash of their fingerprint. A change reads and writes only the
buckets it touches, into a new folder, and then commits: a small file, numbered in sequence, says which folder
holds each bucket now. Readers go by the newest such file, so they see whole changes only. A commit file
is moved into place without overwriting, so of two writers one wins; the other rebases: its buckets
stand if the winner left them alone, else it merges them again. Nothing is lost either way.

A deletion is a row too (``deleted``), with its time: an older mapping that arrives later does not bring the
entry back, a newer one does. ``compact`` takes out deletions that are old enough and folders no commit names.

The shared file system must refuse to rename onto an existing file, as HDFS and local disks do.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordflow.operators.cache import valid_cache
from recordflow.operators.ordered import last_wins
from recordflow.session import materialize

BUCKETS = 64
# How often a writer tries against others before it gives up.
ATTEMPTS = 100


@dataclass(frozen=True)
class Snapshot:
    """State of the store: number of the last commit, bucket count, and the folder of each filled bucket."""
    number: int = 0
    buckets: int = BUCKETS
    folders: dict[int, str] = field(default_factory=dict)


class _Files:
    """Calls of the cluster's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = path
        self.fs = self.path().getFileSystem(self.conf)

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def names(self, *parts: str) -> list[str]:
        at = self.path(*parts)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self.path(*parts))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, text: str, *parts: str) -> bool:
        """Write a file that is not there yet, whole at once; false if another writer was first."""
        draft = self.path("_drafts", uuid.uuid4().hex)
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        self.fs.mkdirs(self.path(*parts[:-1]))
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.isUriPathAbsolute() and draft.toUri().getScheme() else self.fs.getUri(), self.conf)
        no_options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(draft, self.path(*parts), no_options)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            self.fs.delete(draft, False)
            return False

    def delete(self, *parts: str) -> None:
        self.fs.delete(self.path(*parts), True)


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("fingerprint"), F.lit(buckets)).cast("int")


def snapshot(spark: SparkSession, path: str) -> Snapshot | None:
    """The newest state, None if nothing was ever committed."""
    files = _Files(spark, path)
    done = files.names("_commits")
    if not done:
        return None
    kept = json.loads(files.read("_commits", done[-1]))
    return Snapshot(int(done[-1].split(".")[0]), kept["buckets"], {int(k): v for k, v in kept["folders"].items()})


def _rows(spark: SparkSession, path: str, state: Snapshot, only: set[int] | None = None) -> DataFrame | None:
    """Rows of the named buckets (all if None), deletions among them."""
    found = [f"{path}/{folder}/bucket={b}" for b, folder in sorted(state.folders.items()) if only is None or b in only]
    return spark.read.option("mergeSchema", "true").parquet(*found) if found else None


def read_cache(spark: SparkSession, path: str, fingerprints: DataFrame | None = None) -> DataFrame | None:
    """Entries of the newest state; with ``fingerprints`` only the buckets that can hold one of them are read. None if nothing is there."""
    state = snapshot(spark, path)
    if state is None:
        return None
    rows = _rows(spark, path, state, None if fingerprints is None else _touched(fingerprints, state.buckets))
    return None if rows is None else rows.where(~F.col("deleted")).drop("deleted")


def _touched(rows: DataFrame, buckets: int) -> set[int]:
    """At most ``buckets`` numbers."""
    return {r[0] for r in rows.select(bucket_of(buckets)).distinct().collect()}


def _commit(files: _Files, state: Snapshot) -> bool:
    return files.create(json.dumps({"buckets": state.buckets, "folders": state.folders}), "_commits", f"{state.number:012d}.json")


def _change(changes: DataFrame, path: str, buckets: int) -> int:
    """Merge rows (fingerprint, cached_at, deleted, …) into the store; the number of the commit. ``changes`` must be stable."""
    spark = changes.sparkSession
    files, merged_from, written = _Files(spark, path), None, {}
    for _ in range(ATTEMPTS):
        state = snapshot(spark, path) or Snapshot(buckets=buckets)
        touched = _touched(changes, state.buckets)
        if not touched:
            return state.number
        before = {b: state.folders.get(b) for b in touched}
        if before != merged_from:
            folder = f"data-{uuid.uuid4().hex}"
            old = _rows(spark, path, state, touched)
            rows = changes if old is None else old.unionByName(changes, allowMissingColumns=True)
            newest = last_wins(rows, ["fingerprint"], ["cached_at", "deleted"])
            # A bucket is one task: their number is chosen so that one fits.
            newest.withColumn("bucket", bucket_of(state.buckets)).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
            merged_from, written = before, dict.fromkeys(touched, folder)
        if _commit(files, Snapshot(state.number + 1, state.buckets, {**state.folders, **written})):
            return state.number + 1
    raise RuntimeError(f"{path}: other writers were first {ATTEMPTS} times")


def upsert_cache(fresh: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Add entries, the latest per fingerprint wins; only their buckets are written. ``buckets`` counts when the store is new."""
    kept = materialize(fresh.withColumn("deleted", F.lit(False)), "fresh-cache-entries")
    return _change(kept, path, buckets)


def invalidate_store(spark: SparkSession, path: str, now: Column, fingerprints: DataFrame | None = None) -> DataFrame:
    """Delete the listed entries, or all, as of ``now``: the listed ones with ``existed``."""
    there = read_cache(spark, path, fingerprints)
    gone = spark.createDataFrame([], "fingerprint string") if there is None else there.select("fingerprint")
    asked = gone if fingerprints is None else fingerprints.select("fingerprint").distinct()
    known = gone.withColumn("_there", F.lit(True))
    asked = materialize(asked.join(known, "fingerprint", "left").select("fingerprint", F.coalesce("_there", F.lit(False)).alias("existed")), "asked-entries")
    marks = asked.where("existed").select("fingerprint", now.cast("timestamp").alias("cached_at"), F.lit(True).alias("deleted"))
    _change(materialize(marks, "cache-deletions"), path, BUCKETS)
    return asked


def expire(spark: SparkSession, path: str, now: Column, ttl_days: int) -> DataFrame:
    """Delete the entries of another version or older than ``ttl_days``."""
    rows = read_cache(spark, path)
    if rows is None:
        return spark.createDataFrame([], "fingerprint string, existed boolean")
    stale = rows.select("fingerprint").join(valid_cache(rows, now, ttl_days).select("fingerprint"), "fingerprint", "left_anti")
    return invalidate_store(spark, path, now, stale)


def compact(spark: SparkSession, path: str, before: Column) -> int:
    """Take out deletions made before a time, then all that only older states need.

    Readers of older states must have ended. Returns the number of the newest commit.
    """
    for _ in range(ATTEMPTS):
        state = snapshot(spark, path)
        if state is None:
            return 0
        rows = _rows(spark, path, state)
        old = F.col("deleted") & (F.col("cached_at") < before)
        due = set() if rows is None else _touched(rows.where(old), state.buckets)
        if due:
            folder = f"data-{uuid.uuid4().hex}"
            kept = _rows(spark, path, state, due).where(~old).withColumn("bucket", bucket_of(state.buckets))
            kept.repartition(len(due), "bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
            filled = {int(n.split("=")[1]) for n in _Files(spark, path).names(folder) if n.startswith("bucket=")}
            folders = {b: folder if b in due else f for b, f in state.folders.items() if b not in due or b in filled}
            state = Snapshot(state.number + 1, state.buckets, folders)
            if not _commit(_Files(spark, path), state):
                continue
        _sweep(_Files(spark, path), state)
        return state.number
    raise RuntimeError(f"{path}: other writers were first {ATTEMPTS} times")


def _sweep(files: _Files, state: Snapshot) -> None:
    """Remove commits before a state and folders that neither it nor a later commit names. A writer that has not committed yet may lose its
    folder, so sweep when none is at work."""
    later = [n for n in files.names("_commits") if int(n.split(".")[0]) >= state.number]
    used = {f for n in later for f in json.loads(files.read("_commits", n))["folders"].values()}
    for n in files.names("_commits"):
        if n not in later:
            files.delete("_commits", n)
    for name in files.names():
        if name.startswith("data-") and name not in used:
            files.delete(name)
