"""Job log: listing, summaries, folding of job events, delivery plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordflow.functions.scalars import progress_pct

PATCHED = ["error", "download_url", "avg_confidence", "cache_hits", "started_at", "completed_at",
           "progress_completed", "progress_successful", "progress_failed"]
TERMINAL = ["done", "failed", "cancelled"]


def list_recent(jobs: DataFrame, status: str | None = None, kind: str | None = None, limit: int = 50,
                ts: str = "created_at") -> DataFrame:
    """The newest jobs that fit. Callers that must hold ``limit`` within bounds do so themselves."""
    found = jobs
    if status is not None:
        found = found.where(F.col("status") == status)
    if kind is not None:
        found = found.where(F.col("kind") == kind)
    return found.orderBy(F.col(ts).desc(), F.col("id").desc()).limit(limit)


def job_summary(jobs: DataFrame) -> DataFrame:
    """Jobs with their progress as columns."""
    rest = [c for c in jobs.columns if c not in ("progress", "payload")]
    return jobs.select(*rest, progress_pct("progress.completed", "progress.total").alias("progress_pct"),
                       "progress.completed", "progress.successful", "progress.failed")


def completion_payload(jobs: DataFrame, event: str = "job.completed") -> Column:
    """JSON body of a completion event."""
    names = [c for c in ("kind", "status", "template_id", "record_count", "download_url", "avg_confidence", "cache_hits",
                         "error", "created_at", "started_at", "completed_at") if c in jobs.columns]
    return F.to_json(F.struct(F.lit(event).alias("event"), F.col("id").alias("job_id"), *[F.col(c) for c in names],
                              "progress.completed", "progress.total", "progress.successful", "progress.failed",
                              progress_pct("progress.completed", "progress.total").alias("progress_pct")))


def fold_jobs(events: DataFrame) -> DataFrame:
    """State of each job from its events (job_id, seq, action, status and fields to set).

    ``action`` is create, update or cancel. A null field sets nothing. Cancelling
    a queued job marks it, cancelling any other deletes it. One aggregate, combined
    before the shuffle; the group itself is never gathered.
    """
    fields = [c for c in PATCHED if c in events.columns]
    at = F.col("seq")
    # Status just before the first cancel decides between marking and deleting.
    cancel = events.groupBy("job_id").agg(F.min(F.when(F.col("action") == "cancel", at)).alias("_cancel_at"))
    marked = events.join(cancel, "job_id")
    before = F.col("_cancel_at").isNull() | (at < F.col("_cancel_at"))
    upto = before & F.col("status").isNotNull()
    state = marked.groupBy("job_id").agg(
        F.max_by(F.when(upto, F.col("status")), F.when(upto, at)).alias("_before"),
        F.max_by("status", F.when(F.col("status").isNotNull() & (F.col("action") != "cancel"), at)).alias("_last"),
        F.first("_cancel_at").alias("_cancel_at"), F.count_if(F.col("action") == "cancel").alias("_cancels"),
        F.max(F.when(F.col("action") != "cancel", at)).alias("_last_at"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in fields],
        F.min(F.when(F.col("action") == "create", at)).alias("_created"),
    )
    # A second cancel finds the job cancelled already, so it deletes it.
    gone = (F.col("_cancels") > 1) | (F.col("_cancel_at").isNotNull() & (F.coalesce("_before", F.lit("queued")) != "queued"))
    status = F.when(F.col("_cancel_at").isNull() | (F.col("_last_at") > F.col("_cancel_at")), F.col("_last")).otherwise("cancelled")
    return state.where(F.col("_created").isNotNull() & ~gone).select("job_id", status.alias("status"), *fields)


def delivery_plan(attempts: DataFrame, max_attempts: int = 4, base: float = 1.0) -> DataFrame:
    """Outcome of each delivery (job_id, attempt 1.., ok, error).

    Tries end at the first success or after ``max_attempts``; the wait before try
    n + 1 is base · 2^(n-1).
    """
    tried = attempts.where(F.col("attempt") <= max_attempts)
    first_ok = F.min(F.when(F.col("ok"), F.col("attempt")))
    folded = tried.groupBy("job_id").agg(
        first_ok.alias("_ok_at"), F.max("attempt").alias("_last"), F.max_by("error", F.when(~F.col("ok"), F.col("attempt"))).alias("_error"))
    n = F.coalesce("_ok_at", "_last")
    return folded.select(
        "job_id", n.alias("attempts"), F.col("_ok_at").isNotNull().alias("delivered"),
        (F.lit(base) * (F.pow(F.lit(2.0), n - 1) - 1)).alias("waited_sec"),
        F.when(F.col("_ok_at").isNull(), F.coalesce("_error", F.lit("delivery failed"))).alias("error"),
        F.when(F.col("_ok_at").isNull() & (n < max_attempts), F.lit(base) * F.pow(F.lit(2.0), n - 1)).alias("next_delay_sec"))


def redeliverable(jobs: DataFrame) -> DataFrame:
    """Jobs whose delivery may be queued again; others carry the reason."""
    reason = F.when(~F.col("status").isin(TERMINAL), F.concat(F.lit("still "), "status")).when(
        F.coalesce("webhook_url", F.lit("")) == "", "no webhook_url")
    return jobs.withColumn("reason", reason)
