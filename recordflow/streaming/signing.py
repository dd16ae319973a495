"""Ordered signing: sessions fold their events, in batch and as a stream.

Sessions: session_id, signers (their number or an array of them). Events:
session_id, seq, action (sign / cancel), signer_index. A signature counts only
if it is the turn of its signer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordflow.operators.ordered import CHUNK, Window, hot_cuts, with_chunks
from recordflow.streaming.state import OrderedProcessor, run_ordered

MAX_SIGNERS = 10
HOT_EVENTS = 200_000


def check_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions with ``error`` where they have no, too many or nameless signers."""
    nameless = F.filter(F.transform("signers", lambda s, i: F.when(
        (F.coalesce(s["name"], F.lit("")) == "") & (F.coalesce(s["email"], F.lit("")) == ""), i + 1)), lambda i: i.isNotNull())
    n = F.coalesce(F.size("signers"), F.lit(0))
    return sessions.withColumn("error", F.when(n == 0, "At least one signer is required.")
                               .when(n > MAX_SIGNERS, "Maximum 10 signers per session.")
                               .when(F.size(nameless) > 0, F.concat(F.lit("Signer "), F.get(nameless, F.lit(0)), F.lit(" must have at least a name or email."))))


def _advance(state: Column, e: Column, n: Column) -> Column:
    return F.when((e["signer_index"] == state) & (state < n), state + 1).otherwise(state)


def _accepted(signs: DataFrame, hot_rows: int) -> DataFrame:
    """(session_id, accepted ARRAY<seq>): which signatures count, at most one per signer.

    A stretch of events maps each possible turn to the turn after it. Hot sessions
    are cut into stretches, each is folded on its own for every turn that its number of
    signers allows, and the maps are chained, so no task holds a whole session.
    """
    chunked = with_chunks(signs, ["session_id"], ["seq"], hot_cuts(signs, ["session_id"], ["seq"], hot_rows))
    stretches = chunked.groupBy("session_id", CHUNK).agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("seq", "signer_index"))).alias("events"))
    turns = F.sequence(F.lit(0), F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)))
    step = F.aggregate("events", turns, lambda acc, e: F.transform(acc, lambda s: _advance(s, e, F.col("n"))))
    earlier = Window.partitionBy("session_id").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    start = F.aggregate(F.collect_list(step).over(earlier), F.lit(0), lambda s, m: F.get(m, s))
    started = stretches.withColumn("start", start)

    def take(acc: Column, e: Column) -> Column:
        hit = (e["signer_index"] == acc["turn"]) & (acc["turn"] < F.col("n"))
        return F.struct(F.when(hit, acc["turn"] + 1).otherwise(acc["turn"]).alias("turn"),
                        F.when(hit, F.concat(acc["seqs"], F.array(e["seq"]))).otherwise(acc["seqs"]).alias("seqs"))

    zero = F.struct(F.col("start").alias("turn"), F.array().cast("array<bigint>").alias("seqs"))
    taken = started.select("session_id", F.aggregate("events", zero, take)["seqs"].alias("seqs"))
    return taken.where(F.size("seqs") > 0).groupBy("session_id").agg(F.array_sort(F.flatten(F.collect_list("seqs"))).alias("accepted"))


def fold_signing(events: DataFrame, sessions: DataFrame, hot_rows: int = HOT_EVENTS) -> tuple[DataFrame, DataFrame]:
    """(sessions with status and current_signer_index, events with accepted and reason)."""
    sized = sessions.select("session_id", F.col("signers").alias("n") if not dict(sessions.dtypes)["signers"].startswith("array")
                            else F.size("signers").alias("n"))
    cancels = events.where("action = 'cancel'").groupBy("session_id").agg(F.min("seq").alias("cancel_at"))
    known = sized.join(cancels, "session_id", "left")
    signs = events.where("action = 'sign'").select("session_id", F.col("seq").cast("bigint").alias("seq"), F.col("signer_index").cast("int").alias("signer_index"))
    live = signs.join(known, "session_id").where(F.col("cancel_at").isNull() | (F.col("seq") < F.col("cancel_at")))
    state = known.join(_accepted(live.select("session_id", "seq", "signer_index", "n"), hot_rows), "session_id", "left").withColumn(
        "accepted", F.coalesce("accepted", F.array().cast("array<bigint>")))
    turn = F.size("accepted")
    states = state.select(
        "session_id", F.when(F.col("cancel_at").isNotNull(), "cancelled").when((F.col("n") > 0) & (turn >= F.col("n")), "complete")
        .when(turn > 0, "in_progress").otherwise("pending").alias("status"), turn.alias("current_signer_index"), "accepted")
    judged = signs.join(state, "session_id", "left")
    before = F.size(F.filter("accepted", lambda s: s < F.col("seq")))
    reason = (
        F.when(F.col("n").isNull(), "session not found")
        .when(F.col("cancel_at").isNotNull() & (F.col("seq") > F.col("cancel_at")), "session cancelled")
        .when(F.array_contains("accepted", F.col("seq")), F.lit(None).cast("string"))
        .when(before >= F.col("n"), "session complete")
        .otherwise(F.concat(F.lit("out of order: expected "), before, F.lit(", got "), F.col("signer_index"))))
    return states, judged.select("session_id", "seq", "signer_index", reason.isNull().alias("accepted"), reason.alias("reason"))


def session_summary(sessions: DataFrame) -> DataFrame:
    """Sessions with their current signer, links and sizes."""
    url = F.concat(F.lit("/ui/multisign.html?session_id="), "session_id")
    download = F.concat(F.lit("/api/v1/signing-sessions/"), F.col("session_id"), F.lit("/download"))
    return sessions.select(
        "*", F.size("signers").alias("total_signers"), F.get("signers", F.col("current_signer_index")).alias("current_signer"),
        F.when(F.col("status") != "complete", url).alias("sign_url"),
        F.when(F.coalesce("final_pdf_filename", F.lit("")) != "", download).alias("download_url"))


def notifications(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows of who is to be told what; nothing is sent.

    ``events``: judged events of ``fold_signing``. ``sessions``: session_id, title,
    signers ARRAY<STRUCT<name,email>>. Only people with an e-mail are told.
    """
    def to(s: Column, kind: str, step: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), s["email"].alias("to_email"), s["name"].alias("to_name"), step.cast("int").alias("step"))

    def present(rows: Column) -> Column:
        return F.filter(rows, lambda r: F.coalesce(r["to_email"], F.lit("")) != "")

    total = F.size("signers")
    created = sessions.select("session_id", F.lit(-1).cast("bigint").alias("seq"), total.alias("total"),
                              F.explode(present(F.array(to(F.get("signers", F.lit(0)), "your_turn", F.lit(1))))).alias("m"))
    i = F.col("signer_index")
    me = F.get("signers", i)
    others = F.transform(F.filter("signers", lambda s: F.coalesce(s["email"], F.lit("")) != F.coalesce(me["email"], F.lit(""))),
                         lambda s: to(s, "complete", total))
    after = F.when(i + 1 >= total, others).otherwise(F.array(to(F.get("signers", i + 1), "your_turn", i + 2)))
    signed = events.where("accepted").join(sessions, "session_id").select(
        "session_id", "seq", total.alias("total"), F.explode(present(F.concat(F.array(to(me, "step_done", i + 1)), after))).alias("m"))
    return created.unionByName(signed).select("session_id", "seq", "m.*", F.greatest(F.lit(0), F.col("total") - F.col("m.step")).alias("remaining"))


def decision_notices(approvals: DataFrame) -> DataFrame:
    """Rows telling the requester of a decided approval."""
    return approvals.where(F.col("status").isin("approved", "rejected") & (F.coalesce("requester_email", F.lit("")) != "")).select(
        "approval_id", F.col("requester_email").alias("to_email"), "title", F.col("status").alias("decision"), "comment")


class SigningProcessor(OrderedProcessor):
    """State per session: turn, number of signers, cancelled. Emits every judged signature."""

    EVENT = "seq bigint, action string, signer_index int, signers int"
    OUT = ("session_id", "seq", "signer_index", "accepted", "reason", "status", "current_signer_index")

    def start(self):
        return 0, None, False

    def fold(self, key, state, event):
        turn, n, cancelled = state
        seq, action, signer, signers = event
        if action == "create":
            return (turn, int(signers), cancelled), []
        if action == "cancel":
            return (turn, n, True), []
        reason = None
        if n is None:
            reason = "session not found"
        elif cancelled:
            reason = "session cancelled"
        elif turn >= n:
            reason = "session complete"
        elif signer != turn:
            reason = f"out of order: expected {turn}, got {signer}"
        else:
            turn += 1
        status = "cancelled" if cancelled else "complete" if n and turn >= n else "in_progress" if turn else "pending"
        return (turn, n, cancelled), [(key[0], seq, signer, reason is None, reason, status, turn)]


def stream_signing(events: DataFrame, ttl_ms: int | None = None, delay: str | None = None, forget_ms: int | None = None) -> DataFrame:
    """Stream twin of ``fold_signing``: events carry ``create`` rows with the number of ``signers``.

    Events may arrive in any order and any batches; ``state.settled`` reads the rows that
    stand, by session and seq. With ``delay`` events carry ``ts`` and those older than that are sealed, and ``forget_ms`` forgets sessions
    that have been still for so long in event time; without, ``ttl_ms`` does by the clock.
    """
    return run_ordered(
        events, "session_id", SigningProcessor,
        "session_id string, seq bigint, signer_index int, accepted boolean, reason string, status string, current_signer_index int", ttl_ms, delay, forget_ms)
