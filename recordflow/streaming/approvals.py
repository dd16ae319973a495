"""Approvals with expiry: pending, then approved, rejected or expired."""

from __future__ import annotations

from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from recordflow.functions.scalars import strip
from recordflow.streaming.state import EPOCH, Buckets, OrderedProcessor, run_ordered

DEFAULT_HOURS, LEAST_HOURS = 168, 1
# States of a stream over which its approvals are dealt.
BUCKETS = 4096


def expires_at(created_at, hours) -> Column:
    c = F.col(created_at) if isinstance(created_at, str) else created_at
    h = F.col(hours) if isinstance(hours, str) else hours
    whole = F.greatest(F.lit(LEAST_HOURS), F.coalesce(h, F.lit(DEFAULT_HOURS)))
    return F.timestamp_micros(F.unix_micros(c.cast("timestamp")) + whole * 3_600_000_000)


def is_expired(expires, now) -> Column:
    """Whether ``now`` has reached an expiry text; a text that is no time never expires."""
    at = F.try_to_timestamp(F.col(expires) if isinstance(expires, str) else expires)
    return F.coalesce((F.col(now) if isinstance(now, str) else now) >= at, F.lit(False))


def prepare_approvals(requests: DataFrame) -> DataFrame:
    """New approvals with defaults, expiry and ``error`` where something is missing."""
    error = (
        F.when(strip(F.coalesce("pdf_filename", F.lit(""))) == "", "pdf_filename is required.")
        .when((F.coalesce("reviewer_email", F.lit("")) == "") & (F.coalesce("reviewer_name", F.lit("")) == ""),
              "At least reviewer_email or reviewer_name is required."))
    return requests.withColumn("error", error).withColumn(
        "title", F.coalesce(F.nullif(strip("title"), F.lit("")), F.lit("Untitled"))).withColumn(
        "expires_at", expires_at("created_at", "expires_in_hours"))


def fold_approvals(approvals: DataFrame, decisions: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(approvals with status, decided_at and comment; decisions with accepted and reason).

    ``approvals``: approval_id, token, expires_at. ``decisions``: approval_id, seq,
    ts, decision, token, comment. The first decision that fits wins: one aggregate,
    combined before the shuffle.
    """
    known = decisions.alias("d").join(approvals.alias("a"), "approval_id", "left").select(
        "approval_id", "d.seq", "d.ts", "d.decision", "d.comment", F.col("a.token").isNotNull().alias("_known"),
        F.coalesce((F.col("d.token") != "") & (F.col("d.token") == F.col("a.token")), F.lit(False)).alias("_token"),
        F.coalesce(F.col("d.ts") >= F.col("a.expires_at"), F.lit(False)).alias("_late"))
    first = known.where("_token and not _late").groupBy("approval_id").agg(
        F.min_by(F.struct("seq", "ts", "decision", "comment"), "seq").alias("w"))
    states = approvals.join(first, "approval_id", "left").select(
        "approval_id", F.coalesce("w.decision", F.when(as_of >= F.col("expires_at"), "expired").otherwise("pending")).alias("status"),
        F.col("w.ts").alias("decided_at"), F.nullif(strip("w.comment"), F.lit("")).alias("comment"))
    reason = (
        F.when(~F.col("_known"), "approval not found").when(~F.col("_token"), "invalid token")
        .when(F.col("seq") > F.col("w.seq"), F.concat(F.lit("already decided: "), F.col("w.decision")))
        .when(F.col("_late"), "expired"))
    judged = known.join(first, "approval_id", "left").select(
        "approval_id", "seq", "decision", reason.isNull().alias("accepted"), reason.alias("reason"))
    return states, judged


class ApprovalProcessor(OrderedProcessor):
    """State per approval: token, expiry and status; an event-time timer marks expiry."""

    EVENT = "seq bigint, ts timestamp, action string, token string, expires_in_hours int"
    OUT = ("approval_id", "seq", "status", "accepted", "reason")

    def start(self):
        return None, None, None

    def fold(self, key, state, event):
        token, expires, status = state
        seq, ts, action, given, hours = event
        at = (pd.NaT.value if ts is None else (ts - EPOCH) // timedelta(microseconds=1) * 1000) // 1_000_000
        if action == "create":
            return (given, at + max(LEAST_HOURS, DEFAULT_HOURS if hours is None else int(hours)) * 3_600_000, "pending"), []
        reason = None
        if status is None:
            reason = "approval not found"
        elif not given or given != token:
            reason = "invalid token"
        elif status in ("approved", "rejected"):
            reason = f"already decided: {status}"
        elif at >= expires:
            reason = "expired"
        else:
            status = action
        return (token, expires, status), [(key[0], seq, status, reason is None, reason)]

    def deadline(self, state) -> int | None:
        return state[1] if state[2] == "pending" else None

    def expired(self, key, state) -> list[tuple]:
        return [(key[0], -1, "expired", True, None)]


class ApprovalBuckets(Buckets, ApprovalProcessor):
    """Approvals have an event or two each, so many share a state."""

    KEY = "approval_id"


def stream_approvals(events: DataFrame, delay: str = "1 hour", forget_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Stream twin: events approval_id, seq, ts, action (create / approved / rejected), token, expires_in_hours.

    Emits judged decisions, and an ``expired`` row (seq -1) when the watermark passes the expiry of a
    pending approval. Events may arrive in any order within ``delay``: a create that comes late sets the timer, a
    decision that does deletes it. ``state.settled`` reads the rows that stand, by approval and seq. Older events are sealed, and
    ``forget_ms`` forgets approvals that have been still for so long in event time. Approvals lie in ``buckets``, each one state that a batch with
    any of its approvals reads and writes whole; their number stays as it is with a checkpoint.
    """
    return run_ordered(events, "approval_id", ApprovalBuckets, "approval_id string, seq bigint, status string, accepted boolean, reason string", None, delay, forget_ms, buckets)
