"""Usage, rate limits, late events, deliveries: the same code for tables and streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from recordflow.functions import fixed
from recordflow.operators.jobs import delivery_plan

DELAY = "1 hour"


def _timed(events: DataFrame, delay: str) -> DataFrame:
    """Event time as TIMESTAMP; a watermark bounds the state of a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", delay) if events.isStreaming else timed


def stream_usage(events: DataFrame, window: str = "1 day", key: str = "key_id", delay: str = DELAY) -> DataFrame:
    """Requests per key and tumbling window."""
    return _timed(events, delay).groupBy(key, F.window("ts", window)).agg(F.count(F.lit(1)).alias("requests")).select(
        key, F.col("window.start").alias("window_start"), "requests")


def caller() -> Column:
    """key:{key_id} for known callers, ip:{client_ip} for others."""
    return F.when(F.col("key_id").isNotNull(), F.concat(F.lit("key:"), F.col("key_id").cast("string"))).otherwise(
        F.concat(F.lit("ip:"), F.col("client_ip")))


def limit_breaches(events: DataFrame, limits: Sequence[tuple[str, str, int]] = fixed.RATE_LIMITS, delay: str = DELAY) -> DataFrame:
    """Windows in which a caller went over a limit of its tier.

    ``events``: ts, key_id, client_ip, tier; an unknown tier counts as free. Each
    event falls into one minute and one day. The limits are a fixed handful of
    rows, so they are broadcast.
    """
    table = events.sparkSession.createDataFrame(list(limits), "tier string, period string, max_calls long")
    tier = F.when(F.col("tier").isin(sorted({t for t, _, _ in limits})), F.col("tier")).otherwise("free")
    timed = _timed(events.withColumn("caller", caller()).withColumn("tier", tier), delay)
    spans = F.array(*[F.struct(F.lit(p).alias("period"), F.date_trunc(p, "ts").alias("period_start")) for p in ("minute", "day")])
    if not events.isStreaming:
        # A day is the sum of its minutes, so the events are shuffled once.
        minutes = timed.groupBy("caller", "tier", F.date_trunc("minute", "ts").alias("_minute")).agg(F.count(F.lit(1)).alias("_n"))
        counted = minutes.select("caller", "tier", "_n", F.explode(F.array(*[
            F.struct(F.lit(p).alias("period"), F.date_trunc(p, "_minute").alias("period_start")) for p in ("minute", "day")])).alias("s")
        ).groupBy("caller", "tier", "s.period", "s.period_start").agg(F.sum("_n").alias("calls"))
    else:
        counted = timed.select("ts", "caller", "tier", F.explode(spans).alias("s")).groupBy(
            F.window("ts", "1 day"), "caller", "tier", "s.period", "s.period_start").agg(F.count(F.lit(1)).alias("calls")).drop("window")
    return counted.join(F.broadcast(table), ["tier", "period"]).where(F.col("calls") > F.col("max_calls")).select(
        "caller", "tier", "period", "period_start", "calls", "max_calls")


def split_late(events: DataFrame, max_age: int = fixed.REPLAY_SECONDS, event_ts: str = "ts", arrival_ts: str = "arrived_at") -> tuple[DataFrame, DataFrame]:
    """Events within the replay window, and those outside it."""
    age = F.abs(F.unix_micros(F.col(arrival_ts).cast("timestamp")) - F.unix_micros(F.col(event_ts).cast("timestamp")))
    fresh = F.coalesce(age <= max_age * 1_000_000, F.lit(False))
    return events.where(fresh), events.where(~fresh)


def stream_deliveries(attempts: DataFrame, max_attempts: int = 4, base: float = 1.0) -> DataFrame:
    """Delivery outcomes as attempts arrive; a stream needs output mode update or complete."""
    return delivery_plan(attempts, max_attempts, base)
