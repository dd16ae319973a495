"""Signed events as they arrive: each counted once, and only within its replay window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from recordflow.functions import fixed
from recordflow.functions.scalars import strip
from recordflow.functions.secrets import sign_event, within_replay_window
from recordflow.session import checkpoint_root

UNFIT, STALE = "invalid signature", "outside the replay window"


def refusal(secret: str | None = None, own_secret: str | None = None, max_age: int = fixed.REPLAY_SECONDS) -> Column:
    """Why an event (signed_at in seconds, body, signature, arrived_at) does not count, null if it does."""
    fits = F.coalesce(F.sha2(strip("signature"), 256) == F.sha2(sign_event("signed_at", "body", secret, own_secret), 256), F.lit(False))
    return F.when(~fits, UNFIT).when(~within_replay_window("signed_at", F.unix_seconds(F.col("arrived_at").cast("timestamp")), max_age), STALE)


def judge_stream(events: DataFrame, secret: str | None = None, own_secret: str | None = None, max_age: int = fixed.REPLAY_SECONDS, delay: str | None = None) -> DataFrame:
    """Events with ``reason``, each signature once per outcome.

    A replay that the window would still let through comes at most twice ``max_age`` after the first, so the state forgets
    a signature after that (``delay`` allows more for arrivals out of order). A copy with another body does not use the signature up.
    """
    judged = events.withColumn("arrived_at", F.col("arrived_at").cast("timestamp")).withColumn("reason", refusal(secret, own_secret, max_age))
    keyed = judged.withColumn("outcome", F.when(F.col("reason").isNull(), "accepted").otherwise("refused")).withColumn("_why", F.coalesce("reason", F.lit("")))
    return keyed.withWatermark("arrived_at", delay or f"{2 * max_age} seconds").dropDuplicatesWithinWatermark(["signature", "_why"]).drop("_why")


def ingest_events(events: DataFrame, path: str, name: str, **how) -> StreamingQuery:
    """Write judged events to a table in one pass per micro-batch, split by ``outcome``.

    A micro-batch has its own folder and overwrites it, so one that is done again after a failure leaves no second copy.
    """
    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("outcome").parquet(f"{path}/batch={number}")

    out = judge_stream(events, **how)
    return out.writeStream.option("checkpointLocation", f"{checkpoint_root(events.sparkSession)}/{name}").foreachBatch(add).trigger(availableNow=True).start()


def accepted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("outcome = 'accepted'").drop("outcome", "reason", "batch")


def refused(spark: SparkSession, path: str) -> DataFrame:
    """The side table: late, early and forged events with their reasons."""
    return spark.read.parquet(path).where("outcome = 'refused'").drop("outcome", "batch")
