"""Job states and plan tiers as streams, with their batch twins."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, functions as F

from recordflow.operators.jobs import PATCHED, fold_jobs
from recordflow.streaming.state import OrderedProcessor, run_ordered

__all__ = ["fold_jobs", "fold_tiers", "latest_jobs", "latest_tiers", "stream_jobs", "stream_tiers"]


class JobProcessor(OrderedProcessor):
    """State per job as ``fold_jobs`` has it; emits the job as it stands after each event."""

    OUT = ("job_id", "seq", "status")

    def __init__(self, fields: dict[str, str], **bounds):
        super().__init__(**bounds)
        self.fields = list(fields)
        self.EVENT = ", ".join(["seq bigint", "action string", "status string", *(f"{n} {t}" for n, t in fields.items())])
        self.OUT = ("job_id", "seq", "status", *fields)

    def start(self):
        return {"created": False, "cancels": 0, "before": None, "status": None, "after": False, "set": {}}

    def fold(self, key, state, event):
        seq, action, status, *values = event
        s = dict(state, set={**state["set"], **{n: v for n, v in zip(self.fields, values) if v is not None}})
        if action == "cancel":
            if not s["cancels"]:
                s["before"] = s["status"]
            s["cancels"] += 1
            s["after"] = False if s["cancels"] == 1 else s["after"]
        else:
            s["created"] |= action == "create"
            s["status"] = status if status is not None else s["status"]
            s["after"] = True
        gone = s["cancels"] > 1 or s["cancels"] and (s["before"] or "queued") != "queued"
        if not s["created"]:
            return s, []
        now = "deleted" if gone else s["status"] if not s["cancels"] or s["after"] else "cancelled"
        return s, [(key[0], seq, now, *[s["set"].get(n) for n in self.fields])]


def stream_jobs(events: DataFrame, ttl_ms: int | None = None, delay: str | None = None, forget_ms: int | None = None) -> DataFrame:
    """Stream twin of ``fold_jobs``: a job's status and fields after each of its events.

    ``deleted`` marks a job cancelled after it had started. Events may arrive in any order
    and any batches; ``latest_jobs`` reads the jobs as they stand. With ``delay`` events carry ``ts`` and those older than that are sealed,
    and ``forget_ms`` forgets jobs that have been still for so long in event time; without, ``ttl_ms`` does by the clock.
    """
    fields = {f.name: f.dataType.simpleString() for f in events.schema.fields if f.name in PATCHED}
    kinds = "".join(f", {n} {t}" for n, t in fields.items())
    return run_ordered(events, "job_id", partial(JobProcessor, fields), f"job_id string, seq bigint, status string{kinds}", ttl_ms, delay, forget_ms)


def latest_jobs(rows: DataFrame) -> DataFrame:
    """Jobs as they stand, from the output of ``stream_jobs``; deleted ones are left out."""
    rest = [c for c in rows.columns if c not in ("job_id", "seq", "known")]
    last = rows.groupBy("job_id").agg(F.max_by(F.struct(*rest), F.struct("seq", "known")).alias("w"))
    return last.select("job_id", "w.*").where("status <> 'deleted'")


def fold_tiers(events: DataFrame) -> DataFrame:
    """Tier and customer per key from billing events (seq, type, key_id, target_tier, customer_id).

    A checkout sets the tier (pro if none is named) and the customer; a later
    deletion of that customer's subscription sets the tier to free.
    """
    checkouts = events.where("type = 'checkout.session.completed' and key_id is not null").groupBy("key_id").agg(
        F.max_by(F.coalesce("target_tier", F.lit("pro")), "seq").alias("_tier"), F.max("seq").alias("_at"),
        F.max_by("customer_id", F.when(F.col("customer_id").isNotNull(), F.col("seq"))).alias("customer_id"))
    deleted = events.where("type = 'customer.subscription.deleted' and customer_id is not null").groupBy("customer_id").agg(
        F.max("seq").alias("_deleted_at"))
    return checkouts.join(deleted, "customer_id", "left").select(
        "key_id", "customer_id", F.when(F.col("_deleted_at") > F.col("_at"), "free").otherwise(F.col("_tier")).alias("tier"))


class TierProcessor(OrderedProcessor):
    """State per customer: its keys; emits one row per checkout, and per key and deletion.

    A checkout without a customer can meet no deletion, so it needs no state and is kept by its key."""

    EVENT = "seq bigint, type string, key_id string, target_tier string, customer_id string"
    OUT = ("key_id", "customer_id", "seq", "tier", "checkout")

    def start(self):
        return frozenset()

    def fold(self, key, state, event):
        seq, kind, key_id, tier, customer = event
        if kind == "checkout.session.completed" and key_id:
            held = state if customer is None or key_id in state else state | {key_id}
            return held, [(key_id, customer, seq, tier or "pro", True)]
        if kind == "customer.subscription.deleted" and customer is not None:
            return state, [(k, customer, seq, "free", False) for k in sorted(state)]
        return state, []


def stream_tiers(events: DataFrame, ttl_ms: int | None = None, delay: str | None = None, forget_ms: int | None = None) -> DataFrame:
    """Tier changes by customer, as billing events arrive in any order; ``latest_tiers`` reads the tiers that stand.

    Checkouts without a customer go by their key instead, as all of them together would be one state. A deletion gives a row for every key that the customer had until then. That a key has
    moved to another customer since is known only over all rows, so it is resolved on reading. State is bounded as in ``stream_jobs``.
    """
    of = F.when(F.col("customer_id").isNotNull(), F.concat(F.lit("customer "), "customer_id")).otherwise(F.concat(F.lit("key "), "key_id"))
    events = events.where("customer_id is not null or key_id is not null").withColumn("_of", of)
    return run_ordered(events, "_of", TierProcessor, "key_id string, customer_id string, seq bigint, tier string, checkout boolean", ttl_ms, delay, forget_ms)


def latest_tiers(rows: DataFrame) -> DataFrame:
    """(key_id, customer_id, tier) from the output of ``stream_tiers``, as ``fold_tiers`` gives them."""
    bought, at = F.col("checkout"), F.col("seq")
    keys = rows.where(bought).groupBy("key_id").agg(
        F.max("seq").alias("_at"), F.max_by("tier", "seq").alias("_tier"), F.max_by("customer_id", F.when(F.col("customer_id").isNotNull(), at)).alias("_customer"))
    ended = rows.where(~bought).groupBy("key_id", "customer_id").agg(F.max("seq").alias("_deleted_at")).withColumnsRenamed({"key_id": "_key", "customer_id": "_of"})
    joined = keys.join(ended, (F.col("key_id") == F.col("_key")) & (F.col("_customer") == F.col("_of")), "left")
    return joined.select("key_id", F.col("_customer").alias("customer_id"), F.when(F.col("_deleted_at") > F.col("_at"), "free").otherwise(F.col("_tier")).alias("tier"))
