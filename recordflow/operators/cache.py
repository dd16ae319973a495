"""Mapping cache: one row per fingerprint. ``cache_store`` keeps it on disk.

Cache rows: fingerprint, cached_at TIMESTAMP, version INT, field_labels MAP,
mappings MAP<STRING,STRUCT<value,confidence,source>>.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recordflow.functions import fixed
from recordflow.operators.ordered import last_wins


def valid_cache(cache: DataFrame, now, ttl_days: int = 0, enabled: bool = True) -> DataFrame:
    """Entries of the current version that are not older than ``ttl_days`` (0 for no limit)."""
    kept = cache.where((F.col("version") == fixed.CACHE_VERSION) & F.lit(enabled))
    if ttl_days:
        kept = kept.where(F.col("cached_at") >= now - F.expr(f"INTERVAL {int(ttl_days)} DAYS"))
    return kept


def cached_values(mappings) -> Column:
    """Values of a cache entry that are not empty; confidences stay with the entry."""
    m = F.col(mappings) if isinstance(mappings, str) else mappings
    return F.map_filter(m, lambda _, v: F.coalesce(v["value"] != "", F.lit(False)))


def with_cache(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split requests into (hits with ``mappings``, misses with one row per fingerprint)."""
    known = cache.select("fingerprint", cached_values("mappings").alias("mappings"))
    hits = requests.join(known, "fingerprint")
    misses = requests.join(cache.select("fingerprint"), "fingerprint", "left_anti").dropDuplicates(["fingerprint"])
    return hits, misses


def merge_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cache with fresh rows added: the latest row per fingerprint."""
    return last_wins(cache.unionByName(fresh), ["fingerprint"], "cached_at")


def list_cache(cache: DataFrame) -> DataFrame:
    return cache.select("fingerprint", "cached_at", F.size("mappings").alias("field_count")).orderBy(
        F.col("cached_at").desc_nulls_last(), "fingerprint")


def invalidate_cache(cache: DataFrame, fingerprints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Drop the listed fingerprints, or all: (cache left, the listed ones with ``existed``)."""
    if fingerprints is None:
        return cache.limit(0), cache.select("fingerprint", F.lit(True).alias("existed"))
    asked = fingerprints.select("fingerprint").distinct()
    found = cache.select("fingerprint").join(asked, "fingerprint", "left_semi").select("fingerprint", F.lit(True).alias("_there"))
    return (
        cache.join(asked, "fingerprint", "left_anti"),
        asked.join(found, "fingerprint", "left").select("fingerprint", F.coalesce("_there", F.lit(False)).alias("existed")),
    )
