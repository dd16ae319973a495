"""Streams into tables: audit log, mapping cache, delivery hook."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from recordflow.operators import cache_store as K
from recordflow.plans.fill import PandasMapper, fresh_entries, map_misses
from recordflow.session import checkpoint_root
from recordflow.sources.readers import stream_audit


def _writer(stream: DataFrame, name: str) -> DataStreamWriter:
    root = checkpoint_root(stream.sparkSession)
    return stream.writeStream.option("checkpointLocation", f"{root}/{name}")


def ingest_audit(spark: SparkSession, path: str, sink: str, name: str = "audit") -> StreamingQuery:
    """Append new audit lines to a Parquet table, all that is there and then stop."""
    return _writer(stream_audit(spark, path), name).format("parquet").option("path", sink).outputMode("append").trigger(availableNow=True).start()


def find_audit(audit: DataFrame, audit_id: str) -> DataFrame:
    return audit.where(F.col("audit_id") == audit_id)


def incremental_cache(requests: DataFrame, labeled: DataFrame, cache_path: str, mapper: DataFrame | PandasMapper | None = None,
                      form: str = "doc_id", name: str = "cache") -> StreamingQuery:
    """Map the fingerprints not yet cached and add them to the cache, batch by batch.

    A batch reads and writes only the buckets of its fingerprints. Replayed after a failure, it finds them cached and adds nothing.
    """
    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        misses = batch.dropDuplicates(["fingerprint"])
        cache = K.read_cache(spark, cache_path, misses)
        if cache is not None:
            misses = misses.join(cache.select("fingerprint"), "fingerprint", "left_anti")
        K.upsert_cache(fresh_entries(map_misses(misses, labeled, mapper, form), F.current_timestamp()), cache_path)

    return _writer(requests, name).foreachBatch(add).trigger(availableNow=True).start()


def on_batch(stream: DataFrame, hook: Callable[[DataFrame, int], None], name: str) -> StreamingQuery:
    """Hand every batch to a hook, for example one that posts completion events. Off unless called."""
    return _writer(stream, name).foreachBatch(hook).trigger(availableNow=True).start()
