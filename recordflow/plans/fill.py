"""Mapping and batch fill: bundles to field values, with cache, threshold and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from recordflow.functions import fixed, scalars as S
from recordflow.functions.responses import parse_mapping_response
from recordflow.operators import cache as K, matching, reports
from recordflow.operators.records import stage
from recordflow.plans.bundle import to_bundle
from recordflow.session import materialize

PandasMapper = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
MAPPED = "fingerprint string, field_name string, value string, confidence double"
RECORD_KEY = ("batch_id", "idx")


def labels_digest(labeled: DataFrame, form: str = "doc_id") -> DataFrame:
    """One digest per form over its (field, label) pairs, whatever their order.

    Each pair is hashed alone and the hashes are summed in slices, so a form of
    any size folds into one small row without gathering its fields.
    """
    h = F.sha2(F.concat_ws("\x1f", "field_name", "label"), 256)
    slices = [F.sum(F.conv(F.substring(h, 1 + 14 * i, 14), 16, 10).cast("decimal(28,0)")) for i in range(4)]
    digest = F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *[s.cast("string") for s in slices]), 256)
    return labeled.groupBy(form).agg(digest.alias("labels_digest"), F.count(F.lit(1)).alias("fields_detected"))


def request_fingerprint(digest: str = "labels_digest", flat: str = "flat") -> Column:
    return S.fingerprint(F.create_map(F.lit("labels"), F.col(digest)), flat)


def _match(requests: DataFrame, labeled: DataFrame, form: str, record: str = "fingerprint") -> DataFrame:
    """Default mapper: the best key by text, confidence = score / 100."""
    fields = labeled.select(F.col(form).alias("form_id"), "field_name", F.array("field_name", "label").alias("candidates"))
    entries = requests.select(record, F.col(form).alias("form_id"), F.posexplode("flat").alias("pos", "key", "value"))
    return matching.match_fields(fields, entries, record=record).select(
        record, "field_name", "value", (F.col("score") / 100).alias("confidence"))


def map_misses(misses: DataFrame, labeled: DataFrame, mapper: DataFrame | PandasMapper | None = None, form: str = "doc_id") -> DataFrame:
    """Rows (fingerprint, field_name, value, confidence) for requests not in the cache.

    ``mapper``: None for text matching; a table of model answers (fingerprint,
    response); or a function for ``mapInPandas`` over (fingerprint, form, flat).
    """
    if mapper is None:
        return _match(misses, labeled, form)
    if isinstance(mapper, DataFrame):
        answers = misses.select("fingerprint").join(mapper.select("fingerprint", "response"), "fingerprint")
        parsed = stage(answers, _parsed=parse_mapping_response("response"))
        return parsed.select("fingerprint", F.explode("_parsed").alias("m")).select("fingerprint", "m.*")
    return misses.select("fingerprint", form, "flat").mapInPandas(mapper, MAPPED)


def fresh_entries(mapped: DataFrame, now: Column) -> DataFrame:
    """Cache rows of newly mapped requests. A group is the fields of one filled form."""
    entry = F.struct(F.col("field_name").alias("key"), F.struct("value", "confidence", F.lit("ai").alias("source")).alias("value"))
    return mapped.groupBy("fingerprint").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("mappings")).select(
        "fingerprint", now.cast("timestamp").alias("cached_at"), F.lit(fixed.CACHE_VERSION).alias("version"), "mappings")


def map_fields(bundles: DataFrame, labeled: DataFrame, mapper: DataFrame | PandasMapper | None = None,
               cache: DataFrame | None = None, form: str = "doc_id", by: Sequence[str] = RECORD_KEY, now: Column | None = None,
               ttl_days: int = 0) -> tuple[DataFrame, DataFrame]:
    """Map bundles to fields: (mappings per record and field, newly mapped rows per fingerprint).

    Requests with the same fingerprint are mapped once, and what a mapper or the rest of a cache gives is written once, as
    mappings and new cache rows both read it. Cache entries of another version, or older than ``ttl_days`` at ``now``, do not count.
    Bundles may bring their ``fingerprint`` along, null where their form has no fields.
    """
    if cache is not None:
        cache = K.valid_cache(cache, F.current_timestamp() if now is None else now, ttl_days)
    if "fingerprint" in bundles.columns:
        requests = bundles.where(F.col("fingerprint").isNotNull())
    else:
        requests = bundles.join(labels_digest(labeled, form), form).withColumn("fingerprint", request_fingerprint())
    keys = [*by, form, "fingerprint"]
    if cache is None and mapper is None:
        # Text matching costs less than finding equal requests, so records are matched as they are.
        known = bundles.join(labeled.select(form).distinct(), form, "left_semi").withColumn("_record", F.struct(*by, form))
        found = _match(known, labeled, form, "_record").select("_record.*", "field_name", "value", "confidence", F.lit(False).alias("cache_hit"))
        fresh = found.join(requests.select(*keys), [*by, form]).select("fingerprint", "field_name", "value", "confidence")
        return found, fresh.dropDuplicates(["fingerprint", "field_name"])
    if cache is None:
        misses = requests.select("fingerprint", form, "flat").dropDuplicates(["fingerprint"])
        mapped = materialize(map_misses(misses, labeled, mapper, form), "mapped")
        return requests.select(*keys).join(mapped, "fingerprint").withColumn("cache_hit", F.lit(False)), mapped
    hits, misses = K.with_cache(requests.select(*keys, "flat"), cache)
    mapped = materialize(map_misses(misses, labeled, mapper, form), "mapped")
    known = hits.select(*keys, F.explode("mappings").alias("field_name", "m")).select(
        *keys, "field_name", "m.value", "m.confidence", F.lit(True).alias("cache_hit"))
    new = requests.select(*keys).join(mapped, "fingerprint").withColumn("cache_hit", F.lit(False))
    return known.unionByName(new.select(*known.columns)), mapped


def request_bundles(records: DataFrame, labeled: DataFrame, profiles: DataFrame | None = None, form: str = "doc_id",
                    by: Sequence[str] = RECORD_KEY, shape: str = "auto") -> DataFrame:
    """Bundles of records with the fingerprint of each request (null where the record failed or its form has no fields).

    Bundles feed both the mapping and the results, and may serve several fills, so they and their
    fingerprints are made once and written to the shared folder.
    """
    bundles = to_bundle(records, profiles, with_structured=False, shape=shape).select(*by, form, "flat", "error")
    asked = F.col("error").isNull() & F.col("labels_digest").isNotNull()
    marked = bundles.join(labels_digest(labeled, form).select(form, "labels_digest"), form, "left")
    return materialize(marked.select(*bundles.columns, F.when(asked, request_fingerprint()).alias("fingerprint")), "bundles")


def fill_batch(records: DataFrame, labeled: DataFrame, profiles: DataFrame | None = None, t: float = 0.0,
               mapper: DataFrame | PandasMapper | None = None, cache: DataFrame | None = None, form: str = "doc_id",
               by: Sequence[str] = RECORD_KEY, shape: str = "auto", name_keys: Sequence[str] = fixed.BATCH_NAME_KEYS,
               now: Column | None = None, ttl_days: int = 0) -> dict[str, DataFrame]:
    """Fill forms for whole batches of records, see ``fill_bundles``."""
    if mapper is None and cache is None:
        # Text matching asks for fingerprints only where its ``fresh`` rows are wanted.
        bundles = materialize(to_bundle(records, profiles, with_structured=False, shape=shape).select(*by, form, "flat", "error"), "bundles")
    else:
        bundles = request_bundles(records, labeled, profiles, form, by, shape)
    return fill_bundles(bundles, labeled, t, mapper, cache, form, by, name_keys, now, ttl_days)


def fill_bundles(bundles: DataFrame, labeled: DataFrame, t: float = 0.0, mapper: DataFrame | PandasMapper | None = None,
                 cache: DataFrame | None = None, form: str = "doc_id", by: Sequence[str] = RECORD_KEY,
                 name_keys: Sequence[str] = fixed.BATCH_NAME_KEYS, now: Column | None = None, ttl_days: int = 0) -> dict[str, DataFrame]:
    """Fill forms for bundles, best those of ``request_bundles``.

    Returns ``filled`` (record, field, value), ``results`` (one row per record,
    a failed record included with its error), ``summary`` (per batch) and
    ``fresh`` (newly mapped rows, for the cache).
    """
    good = bundles.where(F.col("error").isNull())
    mappings, fresh = map_fields(good.drop("error"), labeled, mapper, cache, form, by, now, ttl_days)
    filled = reports.apply_threshold(mappings, t)
    stats = reports.record_stats(mappings, t, by)
    forms = labels_digest(labeled, form).select(form, "fields_detected")
    detected = F.coalesce("fields_detected", F.lit(0))
    error = F.coalesce("error", F.when(detected == 0, "No fillable form fields found"))
    results = (
        bundles.join(forms, form, "left").join(stats, list(by), "left")
        .withColumn("error", error).withColumn("success", F.col("error").isNull())
        .select(*by, form, F.when(F.col("success"), S.output_name("flat", by[-1], name_keys)).alias("filename"), "success",
                F.when(F.col("success"), detected).alias("fields_detected"),
                F.when(F.col("success"), F.coalesce("fields_filled", F.lit(0))).alias("fields_filled"),
                F.when(F.col("success"), F.coalesce("fields_skipped", F.lit(0))).alias("fields_skipped"),
                "avg_confidence", F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"), "error")
    )
    summary = reports.batch_outcome(results, [by[0]])
    return {"filled": filled.select(*by, form, "field_name", "value", "confidence"), "results": results, "summary": summary, "fresh": fresh}
