"""Streams against brute force and against their batch twins."""

import json
import random

import pandas as pd
from pyspark.sql import Row, functions as F

from recordflow.operators import jobs as J
from recordflow.registry.storage import run_stream
from recordflow.session import STATE_STORE
from recordflow.streaming import approvals as AP, jobs as SJ, signing as SG, usage as U
from recordflow.streaming.state import run_ordered, settled


def signing_events(spark):
    rnd = random.Random(2)
    signs = [(f"s{rnd.choice([0, 0, 0, 1, 2, 3])}", i, "cancel" if rnd.random() < 0.01 else "sign", rnd.randrange(-1, 4)) for i in range(300)]
    signs.append(("lost", 999, "sign", 0))
    sizes = {"s0": 3, "s1": 4, "s2": 1, "s3": 2}
    return signs, sizes


def brute(signs, sizes):
    turn, cancelled, out = {}, set(), []
    for s, seq, action, i in sorted(signs, key=lambda e: e[1]):
        if action == "cancel":
            cancelled.add(s)
            continue
        t = turn.get(s, 0)
        ok = s in sizes and s not in cancelled and t < sizes[s] and i == t
        turn[s] = t + ok
        out.append((s, seq, ok))
    return sorted(out)


def test_signing_batch_cut_or_whole_and_stream(spark):
    signs, sizes = signing_events(spark)
    want = brute(signs, sizes)
    ev = spark.createDataFrame(signs, "session_id string, seq bigint, action string, signer_index int")
    sessions = spark.createDataFrame(list(sizes.items()), "session_id string, signers int")
    for hot in (10_000, 7):
        _, judged = SG.fold_signing(ev, sessions, hot)
        assert sorted(map(tuple, judged.select("session_id", "seq", "accepted").collect())) == want
    created = sessions.select("session_id", F.lit(-1).cast("bigint").alias("seq"), F.lit("create").alias("action"), F.lit(-1).alias("signer_index"), "signers")
    out = run_stream(spark, ev.withColumn("signers", F.lit(None).cast("int")).unionByName(created), SG.stream_signing)
    assert sorted(map(tuple, out.select("session_id", "seq", "accepted").collect())) == want


def test_signing_does_not_depend_on_group_size(spark):
    """Sessions of 1 to 30 signers, signed in order with noise, cut at several sizes."""
    rnd = random.Random(7)
    sizes = {f"s{n}": n for n in (1, 2, 9, 10, 11, 24, 30)}
    signs, seq = [], 0
    for s, n in sizes.items():
        for i in range(n):
            for who in [i] + [rnd.randrange(n)] * (i % 3 == 0):
                signs.append((s, seq, "sign", who))
                seq += 1
    want = brute(signs, sizes)
    ev = spark.createDataFrame(signs, "session_id string, seq bigint, action string, signer_index int")
    sessions = spark.createDataFrame(list(sizes.items()), "session_id string, signers int")
    for hot in (1, 3, 1_000_000):
        states, judged = SG.fold_signing(ev, sessions, hot)
        assert sorted(map(tuple, judged.select("session_id", "seq", "accepted").collect())) == want
        assert {r["status"] for r in states.collect()} == {"complete"}


def test_signing_stream_in_any_order_and_batches(spark):
    """Files that arrive last-first, one per micro-batch, give what the whole gives."""
    signs, sizes = signing_events(spark)
    want = brute(signs, sizes)
    rows = [(s, i, a, w, None) for s, i, a, w in signs] + [(s, -1, "create", -1, n) for s, n in sizes.items()]
    ev = spark.createDataFrame(rows, "session_id string, seq bigint, action string, signer_index int, signers int")
    for batches in (1, 6):
        out = settled(run_stream(spark, ev, SG.stream_signing, batches=batches), "session_id", "seq")
        assert sorted(map(tuple, out.select("session_id", "seq", "accepted").collect())) == want


def test_job_and_tier_streams_equal_their_batch_twins(spark):
    rnd = random.Random(5)
    jobs = [(f"j{rnd.randrange(12)}", i, rnd.choice(["create", "update", "update", "update", "cancel"]) if i > 11 else "update", rnd.choice([None, "queued", "running", "done"]),
             rnd.choice([None, "e1", "e2"]), rnd.choice([None, i])) for i in range(160)]
    d = spark.createDataFrame([(j, i, a, s if a != "cancel" else None, e, p) for j, i, a, s, e, p in jobs], "job_id string, seq bigint, action string, status string, error string, progress_completed int")
    want = sorted(map(str, J.fold_jobs(d).collect()))
    assert sorted(map(str, SJ.latest_jobs(run_stream(spark, d, SJ.stream_jobs, batches=6)).collect())) == want
    co, de = "checkout.session.completed", "customer.subscription.deleted"
    moved = [(1, co, "k1", "business", "A"), (2, co, "k1", "business", "B"), (3, de, None, None, "A"), (4, co, "k2", None, "A"), (5, de, None, None, "A"), (6, co, "k3", "pro", None)]
    moved += [(10 + i, rnd.choice([co, co, de]), f"m{rnd.randrange(6)}", rnd.choice([None, "business"]), rnd.choice(["X", "Y", "Z", None])) for i in range(80)]
    t = spark.createDataFrame([(i, k, key if k == co else None, tier, c) for i, k, key, tier, c in moved], "seq bigint, type string, key_id string, target_tier string, customer_id string")
    want = sorted(map(str, SJ.fold_tiers(t).select("key_id", "customer_id", "tier").collect()))
    for batches in (1, 5):
        assert sorted(map(str, SJ.latest_tiers(run_stream(spark, t, SJ.stream_tiers, batches=batches)).collect())) == want


def test_session_checks(spark):
    rows = [("a", []), ("b", [("", "")]), ("c", [("N", "")] * 11), ("d", [("", "m@example.com")])]
    d = spark.createDataFrame(rows, "session_id string, signers array<struct<name:string,email:string>>")
    assert [r["error"] for r in SG.check_sessions(d).orderBy("session_id").collect()] == [
        "At least one signer is required.", "Signer 1 must have at least a name or email.", "Maximum 10 signers per session.", None]


def test_approvals(spark):
    ts = lambda h: f"2024-01-01 {h:02d}:00:00"
    a = spark.createDataFrame([("a", "t", ts(5)), ("b", "t", ts(5)), ("c", "t", ts(5))], "approval_id string, token string, expires_at string").withColumn("expires_at", F.to_timestamp("expires_at"))
    d = spark.createDataFrame([("a", 1, ts(1), "approved", "bad", None), ("a", 2, ts(2), "rejected", "t", " no "), ("a", 3, ts(3), "approved", "t", None), ("b", 4, ts(5), "approved", "t", None), ("x", 5, ts(1), "approved", "t", None)],
                              "approval_id string, seq bigint, ts string, decision string, token string, comment string").withColumn("ts", F.to_timestamp("ts"))
    states, judged = AP.fold_approvals(a, d, F.to_timestamp(F.lit(ts(4))))
    assert sorted(map(tuple, states.select("approval_id", "status", "comment").collect())) == [("a", "rejected", "no"), ("b", "pending", None), ("c", "pending", None)]
    reasons = [r["reason"] for r in judged.orderBy("seq").collect()]
    assert reasons == ["invalid token", None, "already decided: rejected", "expired", "approval not found"]
    created = a.select("approval_id", F.lit(0).cast("bigint").alias("seq"), F.to_timestamp(F.lit(ts(0))).alias("ts"), F.lit("create").alias("action"), "token", F.lit(5).alias("expires_in_hours"))
    ev = d.select("approval_id", "seq", "ts", F.col("decision").alias("action"), "token", F.lit(None).cast("int").alias("expires_in_hours")).unionByName(created)
    out = run_stream(spark, ev, lambda s: AP.stream_approvals(s, "0 seconds"))
    streamed = {r["seq"]: r["reason"] for r in out.where("seq > 0").collect()}
    assert [streamed[i] for i in range(1, 6)] == reasons
    # The last event reaches 05:00, so the watermark passes the expiry of b and c.
    assert sorted(r["approval_id"] for r in out.where("status = 'expired' and seq = -1").collect()) == ["b", "c"]


def test_tiers(spark):
    co, de = "checkout.session.completed", "customer.subscription.deleted"
    ev = [(1, co, "k1", None, "c1"), (2, co, "k2", "business", "c2"), (3, de, None, None, "c1"), (4, de, None, None, "c2"), (5, co, "k2", "pro", None), (6, co, None, "pro", "c9")]
    d = spark.createDataFrame(ev, "seq bigint, type string, key_id string, target_tier string, customer_id string")
    assert sorted(map(tuple, SJ.fold_tiers(d).select("key_id", "customer_id", "tier").collect())) == [("k1", "c1", "free"), ("k2", "c2", "pro")]


def test_checkouts_without_a_customer_are_no_single_state(spark, tmp_path):
    co, de = "checkout.session.completed", "customer.subscription.deleted"
    ev = [(i, co, f"k{i % 50}", None, None) for i in range(200)] + [(200, co, "k0", "business", "c"), (201, de, None, None, "c"), (202, de, None, None, None)]
    d = spark.createDataFrame(ev, "seq bigint, type string, key_id string, target_tier string, customer_id string")
    out, state = _in_batches(spark, tmp_path, [d], SJ.stream_tiers)
    assert sorted(map(str, SJ.latest_tiers(out).collect())) == sorted(map(str, SJ.fold_tiers(d).select("key_id", "customer_id", "tier").collect()))
    assert _state(spark, state, "snapshot").count() == 51


def test_usage_stream_equals_batch(spark):
    d = spark.range(500).select((F.col("id") % 7).alias("key_id"), F.timestamp_seconds(1704067200 + F.col("id") * 1000).alias("ts"))
    streamed = run_stream(spark, d, lambda s: U.stream_usage(s, delay="0 seconds"))
    batch = U.stream_usage(d)
    closed = batch.where("window_start < timestamp'2024-01-06'")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, closed.collect()))


def _in_batches(spark, tmp_path, frames, build):
    """Output and checkpoint of a stream that reads one frame per micro-batch."""
    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert len(list((tmp_path / "in").glob("part-*"))) == i + 1
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    out = build(spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    out.writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", path).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path), state


def _state(spark, path, name):
    return spark.read.format("statestore").option("stateVarName", name).load(path)


def test_sealed_state_stays_small(spark, tmp_path):
    """Twenty batches an hour apart, each with events half an hour late: the answer is that of the whole, the
    state holds the events of the last hours only, and jobs still for half a day are forgotten."""
    rnd = random.Random(11)
    rows = [(f"j{i % 3 if i < 240 else 9}", i, "create" if i < 3 or i == 240 else "update", rnd.choice(["queued", "running", "done"]), 600 * i) for i in range(400)]
    frames = []
    for b in range(20):
        # Every fifth event waits for the next batch.
        now = [r for r in rows if (r[1] // 20 == b and r[1] % 5) or (r[1] // 20 == b - 1 and r[1] % 5 == 0) or (b == 19 and r[1] // 20 == 19)]
        frames.append(spark.createDataFrame(now, "job_id string, seq bigint, action string, status string, s bigint").select(
            "job_id", "seq", "action", "status", F.timestamp_seconds(F.col("s") + 1704067200).alias("ts")))
    whole = spark.createDataFrame(rows, "job_id string, seq bigint, action string, status string, s bigint").drop("s")
    out, state = _in_batches(spark, tmp_path, frames, lambda s: SJ.stream_jobs(s, delay="6 hours", forget_ms=12 * 3_600_000))
    assert sorted(map(str, SJ.latest_jobs(out).collect())) == sorted(map(str, J.fold_jobs(whole).collect()))
    assert _state(spark, state, "open").count() <= 3 * 20 * 3
    assert [r["k"] for r in _state(spark, state, "snapshot").select("key.job_id").toDF("k").collect()] == ["j9"]


def test_timers_move(spark, tmp_path):
    """A create that comes after its decision, a later expiry that replaces an earlier one, and a decision that takes a timer away."""
    ts = lambda h: f"2024-01-01 {h:02d}:00:00"
    schema = "approval_id string, seq bigint, ts string, action string, token string, expires_in_hours int"
    batches = [
        [("a", 0, ts(0), "create", "t", 2), ("b", 0, ts(0), "create", "t", 2), ("d", 2, ts(1), "approved", "t", None)],
        [("a", 1, ts(1), "approved", "t", None), ("b", 1, ts(1), "create", "t", 9), ("c", 0, ts(0), "create", "t", 3), ("d", 0, ts(0), "create", "t", 2)],
        [("z", 0, ts(8), "create", "t", 50)],
        [("z", 1, ts(9), "approved", "wrong", None)],
        [("z", 2, ts(20), "approved", "t", None)],
        [("z", 3, ts(21), "approved", "t", None)],
    ]
    frames = [spark.createDataFrame(b, schema).withColumn("ts", F.to_timestamp("ts")) for b in batches]
    out, state = _in_batches(spark, tmp_path, frames, lambda s: AP.stream_approvals(s, "4 hours"))
    rows = settled(out, "approval_id", "seq")
    assert sorted(r["approval_id"] for r in rows.where("seq = -1").collect()) == ["b", "c"]
    assert {r["approval_id"]: r["status"] for r in rows.where("seq > 0 AND accepted").collect()} == {"a": "approved", "d": "approved", "z": "approved"}
    assert out.where("seq = -1").count() == 2


def test_sealed_twins_in_any_order(spark):
    signs, sizes = signing_events(spark)
    want = brute(signs, sizes)
    rows = [(s, i, a, w, None, i) for s, i, a, w in signs] + [(s, -1, "create", -1, n, 0) for s, n in sizes.items()]
    ev = spark.createDataFrame(rows, "session_id string, seq bigint, action string, signer_index int, signers int, ts bigint").withColumn("ts", F.timestamp_seconds(F.col("ts") + 1704067200))
    out = settled(run_stream(spark, ev, lambda s: SG.stream_signing(s, delay="20 minutes"), batches=6), "session_id", "seq")
    assert sorted(map(tuple, out.select("session_id", "seq", "accepted").collect())) == want


class Counted:
    """State of one key in memory; counts the calls."""

    def __init__(self):
        self.calls, self.value, self.chunks, self.timers = 0, None, {}, set()

    def getMapState(self, *_):
        return self

    getValueState = getMapState

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def updateValue(self, key, value):
        self.calls += 1
        self.chunks[key] = value

    def values(self):
        self.calls += 1
        return iter(self.chunks.values())

    def clear(self):
        self.calls += 1
        self.chunks = {}

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return 0


def test_state_calls_do_not_grow_with_events():
    """A key and batch take one read and one write, also with many events; open events beyond the snapshot are found again."""
    p, state = SJ.JobProcessor({}, seal=True), Counted()
    p.init(state)
    event = lambda i: Row(job_id="j", seq=i, action="create" if i == 0 else "update", status=f"s{i}", event_ms=1000 + i)
    for first in range(0, 1000, 250):
        state.calls = 0
        out = list(p.handleInputRows(("j",), iter([event(i) for i in range(first, first + 250) if i != 7]), state))
        assert len(out) == 250 - (first == 0) and out[-1].known == first + 249 and state.calls <= 4
    assert len(state.timers) == 1 and len(state.chunks) == 4
    late = list(p.handleInputRows(("j",), iter([event(7)]), state))
    assert [(r.seq, r.status, r.known) for r in late] == [(7, "s7", 1000)]


def test_buckets_give_what_a_state_per_key_gives(spark, tmp_path):
    """Approvals in few buckets, with late creates and decisions, expiries, ties, nulls and odd texts."""
    rnd = random.Random(4)
    day = lambda h: f"2024-01-{1 + h // 24:02d} {h % 24:02d}:30:00.123456"
    rows = [(f"a{i}", 10 * i, day(i), "create", rnd.choice(["t", "\"t\n\u00e9\\", ""]), rnd.choice([None, 1, 5, 40])) for i in range(60)]
    rows += [(f"a{k}", 10 * k + 1 + rnd.randrange(8), day(k + rnd.randrange(9)), rnd.choice(["approved", "rejected"]), rnd.choice(["t", "\"t\n\u00e9\\", None]), None) for k in [rnd.randrange(62) for _ in range(150)]]
    rows += [(None, 5, day(3), "approved", "t", None), ("", 2 ** 62, day(4), "create", "t", 3), ("b", 0, None, "create", "t", 3), ("b", 1, day(9), "approved", "t", None)]
    batches = [sorted(rows, key=lambda r: (r[2] or "", r[1]))[i::4] for i in range(4)]
    batches.append([("z", 0, day(200), "create", "t", 1)])
    batches.append([("z", 1, day(300), "approved", "no", None)])
    frames = [spark.createDataFrame(b, "approval_id string, seq bigint, ts string, action string, token string, expires_in_hours int").withColumn("ts", F.to_timestamp("ts")) for b in batches]
    (tmp_path / "keys").mkdir(), (tmp_path / "buckets").mkdir()
    for forget in (None, 20 * 3_600_000):
        one, many = tmp_path / "keys" / str(forget), tmp_path / "buckets" / str(forget)
        one.mkdir(), many.mkdir()
        by_key, _ = _in_batches(spark, one, frames, lambda s: run_ordered(s, "approval_id", AP.ApprovalProcessor, "approval_id string, seq bigint, status string, accepted boolean, reason string", None, "4 days", forget))
        by_bucket, state = _in_batches(spark, many, frames, lambda s: AP.stream_approvals(s, "4 days", forget, buckets=3))
        assert by_bucket.schema == by_key.schema and _state(spark, state, "bucket").count() <= 3
        got, want = (sorted(map(str, d.collect())) for d in (by_bucket, by_key))
        assert got == want and sum("expired" in r for r in want) > 5


class Shared(Counted):
    """State of one bucket in memory."""

    def getValue(self, key):
        self.calls += 1
        return self.chunks[key]

    def removeKey(self, key):
        self.calls += 1
        del self.chunks[key]


def test_a_bucket_takes_one_read_and_one_write():
    p, state = AP.ApprovalBuckets(seal=True), Shared()
    p.init(state)

    def take(*rows):
        state.calls = 0
        rows = [json.dumps({"k": k, "v0": seq, "v1": 1_000_000 * at, "v2": action, "v3": "t", "v4": 10, "v5": 1000 * at}) for k, seq, at, action in rows]
        return [tuple(r) for t in p.handleInputRows((1,), iter([pd.DataFrame({"row": rows})]), state) for r in t.itertuples(index=False)]

    assert take(*[(f"a{i}", 0, 1 + i, "create") for i in range(300)]) == [] and state.calls <= 3
    out = take(*[(f"a{i}", 1, 500, "approved") for i in range(300)])
    assert [r[:2] + r[3:] for r in out] == [(f"a{i}", 1, True, None, 2) for i in range(300)] and state.calls <= 3
    assert len(state.timers) == 1
    # Many open events of one approval lie in chunks of its own, and are found again.
    take(*[("hot", i, 600, "rejected") for i in range(200) if i > 1])
    assert state.calls <= 4 and set(state.chunks) == {("hot", 0)}
    late = take(("hot", 0, 600, "create"), ("hot", 1, 600, "approved"))
    assert len(late) == 199 and {r[4] for r in late} == {None, "already decided: approved"} and late[0][:4] == ("hot", 1, "approved", True)
    assert take(("a7", 2, 601, "approved")) == [("a7", 2, "approved", False, "already decided: approved", 3)]
