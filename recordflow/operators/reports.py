"""Statistics and reports. All are plain aggregates, combined before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from recordflow.functions import fixed
from recordflow.functions.scalars import strip
from recordflow.operators.ordered import running


def exact_avg(c, digits: int = 3) -> Column:
    """Average rounded the same whatever the order of summing: a decimal sum."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.sum(c.cast("decimal(20,10)")).cast("double") / F.nullif(F.count(c), F.lit(0)), digits)


def apply_threshold(mappings: DataFrame, t: float) -> DataFrame:
    """Mappings with at least confidence ``t`` (missing counts as 1); 0 keeps all."""
    return mappings.where(F.coalesce("confidence", F.lit(1.0)) >= t) if t > 0 else mappings


def record_stats(mappings: DataFrame, t: float = 0.0, by: Sequence[str] = ("batch_id", "idx"),
                 detected: DataFrame | None = None) -> DataFrame:
    """Filled and skipped fields and average confidence per record; the average is taken before the threshold."""
    kept = F.coalesce("confidence", F.lit(1.0)) >= t if t > 0 else F.lit(True)
    hits = [F.bool_or("cache_hit").alias("cache_hit")] if "cache_hit" in mappings.columns else []
    stats = mappings.groupBy(*by).agg(
        *hits,
        F.count_if(kept).alias("fields_filled"), exact_avg("confidence").alias("avg_confidence"),
        (F.count(F.lit(1)) - F.count_if(kept)).alias("fields_skipped"))
    if detected is None:
        return stats
    both = detected.join(stats, list(by), "left")
    return both.withColumn("fields_filled", F.coalesce("fields_filled", F.lit(0))).withColumn(
        "fields_skipped", F.coalesce("fields_skipped", F.lit(0)))


def _summary() -> list[Column]:
    ok = F.count_if(F.coalesce(F.col("success"), F.lit(False)))
    n = F.count(F.lit(1))
    return [n.alias("total_records"), ok.alias("successful"), (n - ok).alias("failed"), F.round(ok / n * 100, 1).alias("success_rate")]


def _confidence(stats: DataFrame) -> list[Column]:
    hits = F.count_if(F.coalesce(F.col("cache_hit"), F.lit(False))) if "cache_hit" in stats.columns else F.lit(0)
    return [exact_avg("avg_confidence").alias("avg_confidence"), hits.alias("cache_hits")]


def batch_summary(results: DataFrame, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    return results.groupBy(*by).agg(*_summary())


def batch_confidence(stats: DataFrame, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Average of the record averages, and cache hits."""
    return stats.groupBy(*by).agg(*_confidence(stats))


def batch_outcome(results: DataFrame, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Summary and confidence in one aggregation."""
    return results.groupBy(*by).agg(*_summary(), *_confidence(results))


def usage_counters(events: DataFrame, as_of) -> DataFrame:
    """Requests in all and on the day of ``as_of``, profiles created, batches processed."""
    return events.agg(
        F.count_if(F.col("kind") == "request").alias("total_requests"),
        F.count_if((F.col("kind") == "request") & (F.to_date("ts") == F.to_date(as_of))).alias("requests_today"),
        F.count_if(F.col("kind") == "profile_created").alias("profiles_created"),
        F.count_if(F.col("kind") == "batch_processed").alias("batches_processed"))


def usage_per_key(events: DataFrame, key: str = "key_id") -> DataFrame:
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("request_count"), F.max("ts").alias("last_used_at"))


def profile_usage(links: DataFrame) -> DataFrame:
    """Uses per profile: ``links`` has profile_ids ARRAY and used_at."""
    return links.select(F.explode("profile_ids").alias("profile_id"), "used_at").groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("usage_count"), F.max("used_at").alias("updated_at"))


def import_summary(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of an import: rows carry ``error``. Ids and error rows stay rows of ``rows``,
    as an import may be too large for one value."""
    return rows.groupBy(*by).agg(F.count_if(F.col("error").isNull()).alias("created"), F.lit(0).alias("skipped"),
                                 F.count_if(F.col("error").isNotNull()).alias("failed"))


def compare_runs(a: DataFrame, b: DataFrame, by: Sequence[str] = ("run", "field_name")) -> DataFrame:
    """Two runs field by field: same, different, only_a, only_b or neither."""
    left = a.select(*by, F.col("value").alias("value_a"), F.col("confidence").alias("confidence_a"))
    right = b.select(*by, F.col("value").alias("value_b"), F.col("confidence").alias("confidence_b"))
    has_a, has_b = [F.coalesce(F.col(c) != "", F.lit(False)) for c in ("value_a", "value_b")]
    outcome = (
        F.when(has_a & has_b, F.when(F.col("value_a") == F.col("value_b"), "same").otherwise("different"))
        .when(has_a, "only_a").when(has_b, "only_b").otherwise("neither"))
    return left.join(right, list(by), "full_outer").withColumn("outcome", outcome)


def ab_verdict(compared: DataFrame, runs: DataFrame, by: str = "run") -> DataFrame:
    """Agreement and winner per run pair.

    ``runs``: by, confidence_a, confidence_b, filled_a, filled_b, elapsed_a, elapsed_b.
    """
    agreed = compared.groupBy(by).agg(
        F.count_if(F.col("outcome").isin("same", "different")).alias("both_filled"),
        F.count_if(F.col("outcome") == "same").alias("same"), F.count_if(F.col("outcome") == "different").alias("different"))
    ca, cb = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("confidence_a", "confidence_b")]
    winner = (
        F.when(ca > cb + 0.05, "A").when(cb > ca + 0.05, "B")
        .when(F.col("filled_a") > F.col("filled_b"), "A").when(F.col("filled_b") > F.col("filled_a"), "B").otherwise("tie"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("both_filled", "same", "different")]
    return runs.join(agreed, by, "left").select(
        by, *zero, winner.alias("winner"), F.when(F.col("elapsed_a") < F.col("elapsed_b"), "A").otherwise("B").alias("faster"),
        ((ca > 0.85) | (cb > 0.85)).alias("usable"))


def rows_to_map(df: DataFrame, key: str, value: str, by: Sequence[str]) -> DataFrame:
    """(key, value) rows to a map per record, keys sorted. For records, not for whole batches."""
    return df.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("mappings"))


def extract_summary(fields: DataFrame, docs: DataFrame, by: str = "doc_id") -> DataFrame:
    """Detected and filled fields per document; ``hint`` where there is nothing to read."""
    counted = fields.groupBy(by).agg(
        F.count(F.lit(1)).alias("fields_detected"), F.count_if(F.coalesce(strip("value"), F.lit("")) != "").alias("non_empty_fields"))
    n, filled = [F.coalesce(c, F.lit(0)) for c in ("fields_detected", "non_empty_fields")]
    return docs.select(by).distinct().join(counted, by, "left").select(
        by, n.alias("fields_detected"), filled.alias("non_empty_fields"),
        F.when(n == 0, "no_fields").when(filled == 0, "all_empty").alias("hint"))


def detection_source(docs: DataFrame, zones: DataFrame, by: str = "doc_id") -> DataFrame:
    """acroform, mixed, ai or none per document."""
    counted = zones.groupBy(by).agg(
        F.bool_and(F.col("source") == "acroform").alias("_all"), F.bool_or(F.col("source") == "acroform").alias("_any"))
    label = F.when(F.col("_all"), "acroform").when(F.col("_any"), "mixed").when(F.col("_any").isNotNull(), "ai").otherwise("none")
    return docs.select(by).distinct().join(counted, by, "left").select(by, label.alias("source"))


def batch_report(results: DataFrame, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Report header per batch. The results are a table beside it, keyed by batch, since a
    batch may hold any number of them; see ``write_batch_report``."""
    s = batch_summary(results, by)
    return s.select(*by, "total_records", "successful", "failed")


# --- plans and limits -----------------------------------------------------------

def plans(spark: SparkSession) -> DataFrame:
    rows = [(*p, i) for i, p in enumerate(fixed.PLANS)]
    return spark.createDataFrame(rows, "tier string, plan_name string, calls_per_day long, profiles long, "
                                       "records_per_job long, signing_sessions long, position int")


def usage_by_key(keys: DataFrame, plan_rows: DataFrame | None = None) -> DataFrame:
    """Each key with its plan and usage; an unknown tier gets the first plan.

    The plan list is a fixed handful of rows, so it is broadcast.
    """
    table = plans(keys.sparkSession) if plan_rows is None else plan_rows
    default = fixed.PLANS[0]
    cols = ["plan_name", "calls_per_day", "profiles", "records_per_job", "signing_sessions"]
    joined = keys.withColumn("tier", F.coalesce("tier", F.lit("free"))).join(
        F.broadcast(table.select("tier", *cols)), "tier", "left")
    return joined.select(*keys.columns, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in zip(cols, default[1:])],
                         (F.col("tier") == "free").alias("upgrade_available"))


def entitlement(requests: DataFrame, existing: DataFrame, by: str = "owner", order: str = "seq",
                limits: dict[str, int] | None = None, hot_rows: int | None = None) -> DataFrame:
    """Requests with ``error`` where the owner's tier allows no more profiles.

    ``requests``: by, tier, order. ``existing``: by, existing. Requests are
    admitted in arrival order; -1 is unlimited; an unknown tier has the free limit.
    """
    limits = fixed.PROFILE_LIMITS if limits is None else limits
    table = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    kwargs = {} if hot_rows is None else {"hot_rows": hot_rows}
    numbered = running(requests, by, [order], index="_nth", **kwargs)
    limit = F.coalesce(table[F.col("tier")], F.lit(limits["free"]))
    over = (limit != -1) & (F.coalesce("existing", F.lit(0)) + F.col("_nth") > limit)
    return numbered.join(existing, by, "left").withColumn(
        "error", F.when(over, F.concat(F.initcap("tier"), F.lit(" tier limit reached ("), limit.cast("string"), F.lit(")")))
    ).drop("_nth", "existing")


def observed(results: DataFrame, metrics: Observation, ok: str = "success") -> DataFrame:
    """The same rows; ``metrics`` gets completed, successful and failed while they pass, without
    another pass over them."""
    good = F.coalesce(F.col(ok), F.lit(False))
    return results.observe(metrics, F.count(F.lit(1)).alias("completed"), F.count_if(good).alias("successful"), F.count_if(~good).alias("failed"))
