"""Queries of jobs, usage, workflows, ordering and run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordflow.functions import fixed
from recordflow.operators import jobs as J, ordered as O, reports as A
from recordflow.plans.profiles import import_profiles
from recordflow.registry.base import bind, pick, query, table
from recordflow.streaming import approvals as AP, jobs as SJ, signing as SG, usage as U

# Orders as record results: batch = priority.
RESULTS = "SELECT o_orderpriority AS batch_id, o_orderkey AS position, o_orderstatus <> 'P' AS success FROM {orders}"
HOT = 500  # rows above which a group is cut, so that the test tables have hot groups


@query("""SELECT batch_id, count(*) AS total_records, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed,
round(count(*) FILTER (success) / CAST(count(*) AS DOUBLE) * 100, 1) AS success_rate FROM (""" + RESULTS + ") GROUP BY batch_id")
def batch_summary(spark, sf):
    return A.batch_summary(bind(spark, sf, RESULTS))


@query("SELECT batch_id, count(*) AS total_records, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed FROM (" + RESULTS + ") GROUP BY batch_id")
def batch_report(spark, sf):
    return A.batch_report(bind(spark, sf, RESULTS))


@query(f"SELECT batch_id, position, row_number() OVER (PARTITION BY batch_id ORDER BY position) AS idx FROM ({RESULTS})")
def with_index(spark, sf):
    return O.with_index(bind(spark, sf, RESULTS), "batch_id", ["position"], hot_rows=HOT).select("batch_id", "position", "idx")


@query(f"""SELECT batch_id, position, row_number() OVER w AS completed, count(*) FILTER (success) OVER w AS successful, count(*) FILTER (NOT success) OVER w AS failed FROM ({RESULTS})
WINDOW w AS (PARTITION BY batch_id ORDER BY position)""")
def running_progress(spark, sf):
    d = O.running_progress(bind(spark, sf, RESULTS), "batch_id", ["position"], hot_rows=HOT)
    return d.select("batch_id", "position", "completed", "successful", "failed")


@query("SELECT event_type, user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM {events} GROUP BY event_type, user_id")
def last_wins(spark, sf):
    return O.last_wins(table(spark, sf, "events").select("event_type", "user_id", "event_id", "value"), ["event_type", "user_id"], "event_id")


@query("SELECT event_id, event_type FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 100")
def newest(spark, sf):
    return O.newest(table(spark, sf, "events"), "ts", 100, tie="event_id").select("event_id", "event_type")


@query("SELECT event_type, event_id FROM {events} QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 20")
def newest_per_key(spark, sf):
    return O.newest(table(spark, sf, "events"), "ts", 20, ["event_type"], "event_id").select("event_type", "event_id")


@query("SELECT event_id FROM {events} ORDER BY event_id DESC LIMIT 9999")
def tail(spark, sf):
    return O.tail(table(spark, sf, "events"), "event_id", 9999).select("event_id")


TURNS = "(SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS item, count(*) OVER (PARTITION BY conv_id) AS n FROM {conversations})"


@query(f"SELECT conv_id, turn, 'page_' || lpad(CAST(item AS VARCHAR), 3, '0') AS label FROM {TURNS}")
def split_pages(spark, sf):
    return O.split_segments(table(spark, sf, "conversations"), "conv_id", ["turn"], "pages").select("conv_id", "turn", "label")


@query(f"SELECT conv_id, turn, CASE WHEN item <= n // 2 THEN 'part1' ELSE 'part2' END AS label FROM {TURNS}")
def split_half(spark, sf):
    return O.split_segments(table(spark, sf, "conversations"), "conv_id", ["turn"], "half").select("conv_id", "turn", "label")


RANGES = "(VALUES ('pages_1-3', 1, 3), ('pages_2-4', 2, 4), ('page_001', 1, 1)) r(label, a, b)"


@query(f"""SELECT conv_id, turn, label, NULL AS error FROM {TURNS}, {RANGES} WHERE b <= n AND item BETWEEN a AND b
UNION ALL SELECT DISTINCT conv_id, NULL, label, 'out of bounds: ' || label FROM {TURNS}, {RANGES} WHERE b > n""")
def split_ranges(spark, sf):
    return O.split_segments(table(spark, sf, "conversations"), "conv_id", ["turn"], "range", "1-3, 2-4,1").select("conv_id", "turn", "label", "error")


@query("SELECT role, conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS item FROM {conversations}")
def concat_groups(spark, sf):
    return O.concat_groups(table(spark, sf, "conversations"), "role", "conv_id", "turn", hot_rows=HOT).select("role", "conv_id", "turn", "item")


@query("""WITH d AS (SELECT user_id, event_type AS name, min(event_id) AS position FROM {events} WHERE value > 20 GROUP BY ALL), r AS (SELECT DISTINCT user_id, event_type AS name FROM {events})
SELECT user_id, name, CASE WHEN position IS NULL THEN 1 ELSE 0 END AS source, coalesce(position, 0) AS position FROM r LEFT JOIN d USING (user_id, name)""")
def ordered_union(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("event_type", "name")
    return O.ordered_union(e.where("value > 20"), e, "user_id", "name", "event_id")


@query("SELECT DISTINCT l_partkey AS key FROM {lineitem} UNION SELECT p_partkey FROM {part}")
def key_union(spark, sf):
    return O.key_union(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("key")), table(spark, sf, "part").select(F.col("p_partkey").alias("key")), "key")


# Orders as jobs.
STATUS = "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'failed' END"
KIND = "CASE WHEN o_custkey % 2 = 0 THEN 'batch_fill' ELSE 'extract_pdf' END"
DAY_TEXT = "CAST(CAST(o_orderdate AS DATE) AS STRING)"


def jobs(spark, sf):
    o = table(spark, sf, "orders")
    n = (F.col("o_custkey") % 20).cast("int")
    done = F.least(n, (F.col("o_orderkey") % 20).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("id"), F.expr(STATUS).alias("status"), F.expr(KIND).alias("kind"), n.alias("record_count"),
        F.struct(n.alias("total"), done.alias("completed"), (done - done % 2).alias("successful"), (done % 2).alias("failed")).alias("progress"),
        F.expr(DAY_TEXT).alias("created_at"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("https://h.example/"), F.col("o_custkey").cast("string"))).alias("webhook_url"))


@query(f"SELECT o_orderkey AS id, {DAY_TEXT} AS created_at FROM {{orders}} WHERE {STATUS} = 'done' AND {KIND} = 'batch_fill' ORDER BY created_at DESC, id DESC LIMIT 500")
def list_recent(spark, sf):
    return J.list_recent(jobs(spark, sf), "done", "batch_fill", 500).select("id", "created_at")


PROGRESS = "(SELECT o_orderkey AS id, o_custkey % 20 AS total, least(o_custkey % 20, o_orderkey % 20) AS done, " + STATUS + " AS status, o_orderkey, o_custkey FROM {orders})"
PCT = "CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE round(done / CAST(total AS DOUBLE) * 100, 1) END"


@query(f"SELECT id, status, {PCT} AS progress_pct, done AS completed, done - done % 2 AS successful, done % 2 AS failed FROM {PROGRESS}")
def job_summary(spark, sf):
    return J.job_summary(jobs(spark, sf)).select("id", "status", "progress_pct", "completed", "successful", "failed")


@query(f"SELECT id, 'job.completed' AS event, CAST(total AS BIGINT) AS total, {PCT} AS progress_pct FROM {PROGRESS}")
def completion_payload(spark, sf):
    j = jobs(spark, sf)
    body = J.completion_payload(j)
    return j.select(F.get_json_object(body, "$.job_id").cast("bigint").alias("id"), F.get_json_object(body, "$.event").alias("event"),
                    F.get_json_object(body, "$.total").cast("bigint").alias("total"), F.get_json_object(body, "$.progress_pct").cast("double").alias("progress_pct"))


@query(f"SELECT id, CASE WHEN status = 'running' THEN 'still running' WHEN o_orderkey % 3 = 0 THEN 'no webhook_url' END AS reason FROM {PROGRESS}")
def redeliverable(spark, sf):
    return J.redeliverable(jobs(spark, sf)).select("id", "reason")


# Job events: every user's events, the first one creating the job.
JOB_EVENTS = """SELECT user_id AS job_id, event_id AS seq, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 'create'
WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'cancel' ELSE 'update' END AS action, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 'queued'
WHEN event_type = 'click' THEN 'running' WHEN event_type = 'purchase' THEN 'done' END AS status, CASE WHEN event_type = 'signup' THEN CAST(user_id AS STRING) || event_type END AS error,
CASE WHEN event_type = 'view' THEN CAST(event_id % 100 AS INT) END AS progress_completed FROM {events}"""


@query(f"""WITH e AS ({JOB_EVENTS}), c AS (SELECT job_id, min(seq) AS cancel_at, count(*) AS cancels FROM e WHERE action = 'cancel' GROUP BY job_id),
b AS (SELECT job_id, arg_max(e.status, seq) FILTER (e.status IS NOT NULL AND seq < cancel_at) AS before FROM e JOIN c USING (job_id) GROUP BY job_id)
SELECT job_id, CASE WHEN any_value(cancel_at) IS NULL OR max(seq) FILTER (action <> 'cancel') > any_value(cancel_at) THEN arg_max(status, seq) FILTER (status IS NOT NULL AND action <> 'cancel') ELSE 'cancelled' END AS status,
arg_max(error, seq) FILTER (error IS NOT NULL) AS error, arg_max(progress_completed, seq) FILTER (progress_completed IS NOT NULL) AS progress_completed
FROM e LEFT JOIN c USING (job_id) LEFT JOIN b USING (job_id) GROUP BY job_id HAVING any_value(cancel_at) IS NULL OR (any_value(cancels) = 1 AND any_value(before) = 'queued')""")
def fold_jobs(spark, sf):
    return J.fold_jobs(bind(spark, sf, JOB_EVENTS)).select("job_id", "status", "error", "progress_completed")


ATTEMPTS = "SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS attempt, CAST(ts AS DATE) AS day, event_type = 'purchase' AS ok, event_type AS error FROM {events}"
ATTEMPTS_ID = f"SELECT CAST(job_id AS STRING) || '-' || CAST(day AS STRING) AS job_id, attempt, ok, CASE WHEN NOT ok THEN error END AS error FROM ({ATTEMPTS})"


@query(f"""WITH a AS (SELECT * FROM ({ATTEMPTS_ID}) WHERE attempt <= 4), g AS (SELECT job_id, min(attempt) FILTER (ok) AS ok_at, max(attempt) AS last, arg_max(error, attempt) FILTER (NOT ok) AS error FROM a GROUP BY job_id)
SELECT job_id, coalesce(ok_at, last) AS attempts, ok_at IS NOT NULL AS delivered, pow(2.0, coalesce(ok_at, last) - 1) - 1 AS waited_sec, CASE WHEN ok_at IS NULL THEN error END AS error,
CASE WHEN ok_at IS NULL AND last < 4 THEN pow(2.0, last - 1) END AS next_delay_sec FROM g""")
def delivery_plan(spark, sf):
    return J.delivery_plan(bind(spark, sf, ATTEMPTS_ID))


# Events as requests.
USAGE = "SELECT CASE WHEN user_id % 7 > 0 THEN user_id END AS key_id, '10.0.0.' || CAST(user_id AS STRING) AS client_ip, " + pick(["free", "pro", "gold", "free"], "user_id") + " AS tier, event_id, ts FROM {events}"
KINDS = "CASE event_type WHEN 'signup' THEN 'profile_created' WHEN 'purchase' THEN 'batch_processed' ELSE 'request' END"


@query(f"""SELECT count(*) FILTER (k = 'request') AS total_requests, count(*) FILTER (k = 'request' AND CAST(ts AS DATE) = DATE '2024-01-15') AS requests_today,
count(*) FILTER (k = 'profile_created') AS profiles_created, count(*) FILTER (k = 'batch_processed') AS batches_processed FROM (SELECT {KINDS} AS k, ts FROM {{events}})""")
def usage_counters(spark, sf):
    return A.usage_counters(table(spark, sf, "events").withColumn("kind", F.expr(KINDS)), F.lit("2024-01-15"))


@query(f"SELECT key_id, count(*) AS request_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_used_at FROM ({USAGE}) GROUP BY key_id")
def usage_per_key(spark, sf):
    return A.usage_per_key(bind(spark, sf, USAGE)).withColumn("last_used_at", F.date_format("last_used_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"SELECT key_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS requests FROM ({USAGE}) GROUP BY ALL")
def stream_usage(spark, sf):
    d = U.stream_usage(bind(spark, sf, USAGE))
    return d.select("key_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "requests")


SMALL_LIMITS = [("free", "minute", 1), ("free", "day", 3), ("pro", "minute", 2), ("pro", "day", 5)]
LIMIT_ROWS = ", ".join(f"('{t}', '{p}', {n})" for t, p, n in SMALL_LIMITS)


@query(f"""WITH e AS (SELECT CASE WHEN key_id IS NOT NULL THEN 'key:' || CAST(key_id AS VARCHAR) ELSE 'ip:' || client_ip END AS caller, CASE WHEN tier = 'pro' THEN 'pro' ELSE 'free' END AS tier, ts FROM ({USAGE})),
c AS (SELECT caller, tier, period, date_trunc(period, ts) AS start, count(*) AS calls FROM e, (VALUES ('minute'), ('day')) p(period) GROUP BY ALL)
SELECT caller, tier, period, strftime(start, '%Y-%m-%d %H:%M') AS period_start, calls, max_calls FROM c JOIN (VALUES {LIMIT_ROWS}) l(tier, period, max_calls) USING (tier, period) WHERE calls > max_calls""")
def limit_breaches(spark, sf):
    d = U.limit_breaches(bind(spark, sf, USAGE), SMALL_LIMITS)
    return d.withColumn("period_start", F.date_format("period_start", "yyyy-MM-dd HH:mm"))


@query("SELECT event_id, CASE WHEN event_id % 1300 <= 600 THEN 'fresh' ELSE 'late' END AS kind FROM {events}")
def split_late(spark, sf):
    e = table(spark, sf, "events").withColumn("arrived_at", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 1300 * 1_000_000))
    fresh, late = U.split_late(e)
    return fresh.select("event_id", F.lit("fresh").alias("kind")).unionByName(late.select("event_id", F.lit("late").alias("kind")))


@query("SELECT user_id AS profile_id, count(*) AS usage_count, max(event_id) AS updated_at FROM (SELECT user_id, event_id FROM {events} UNION ALL SELECT user_id + 1, event_id FROM {events} WHERE event_id % 3 = 0) GROUP BY user_id")
def profile_usage(spark, sf):
    e = table(spark, sf, "events")
    ids = F.when(F.col("event_id") % 3 == 0, F.array("user_id", F.col("user_id") + 1)).otherwise(F.array("user_id"))
    return A.profile_usage(e.select(ids.alias("profile_ids"), F.col("event_id").alias("used_at")))


PLAN_ROWS = ", ".join(str(p) for p in fixed.PLANS)


@query(f"""WITH k AS (SELECT c_custkey AS key_id, {pick(['free', 'pro', 'gold', 'business'], 'c_custkey')} AS tier FROM {{customer}}), p(id, plan_name, calls, profiles, records, sessions) AS (VALUES {PLAN_ROWS})
SELECT key_id, tier, plan_name, calls AS calls_per_day, tier = 'free' AS upgrade_available FROM k JOIN p ON p.id = CASE WHEN tier = 'gold' THEN 'free' ELSE tier END""")
def usage_by_key(spark, sf):
    k = bind(spark, sf, f"SELECT c_custkey AS key_id, {pick(['free', 'pro', 'gold', 'business'], 'c_custkey')} AS tier FROM {{customer}}")
    return A.usage_by_key(k).select("key_id", "tier", "plan_name", "calls_per_day", "upgrade_available")


@query("""SELECT o_custkey AS owner, o_orderkey AS seq, CASE WHEN o_custkey % 3 < 2 AND row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + o_custkey % 2 > CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 4 END
THEN CASE WHEN o_custkey % 3 = 0 THEN 'Free tier limit reached (1)' ELSE 'Trial tier limit reached (4)' END END AS error FROM {orders}""")
def entitlement(spark, sf):
    tier = F.when(F.col("o_custkey") % 3 == 0, "free").when(F.col("o_custkey") % 3 == 1, "trial").otherwise("pro")
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("seq"), tier.alias("tier"))
    have = r.select("owner").distinct().where("owner % 2 = 1").withColumn("existing", F.lit(1))
    return A.entitlement(r, have, limits={"free": 1, "trial": 4, "pro": -1}, hot_rows=HOT).select("owner", "seq", "error")


IMPORT = "SELECT c_mktsegment AS import_id, c_custkey AS row, CASE WHEN c_custkey % 6 = 0 THEN ' ' ELSE ' ' || c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN ' Care Provider ' WHEN c_custkey % 4 = 1 THEN '' END AS ptype, CASE WHEN c_custkey % 5 > 0 THEN CAST(c_acctbal AS STRING) ELSE '' END AS balance FROM {customer}"


def _import_rows(spark, sf):
    d = bind(spark, sf, IMPORT)
    return d.select("import_id", "row", F.map_from_arrays(F.array(*[F.lit(k) for k in ("name", "profile_type", "balance")]), F.array("name", "ptype", "balance")).alias("data"))


@query(f"""SELECT import_id, row, trim(name) AS name, CASE WHEN trim(ptype) <> '' THEN 'care_provider' ELSE 'personal' END AS profile_type, nullif(balance, '') AS balance,
CASE WHEN trim(name) = '' THEN 'Missing ''name'' column' END AS error FROM ({IMPORT})""", "import_profiles")
def imported(spark, sf):
    d = import_profiles(_import_rows(spark, sf), "patient")
    return d.select("import_id", "row", "name", "profile_type", F.col("data")["balance"].alias("balance"), "error")


@query(f"SELECT import_id, count(*) FILTER (trim(name) <> '') AS created, 0 AS skipped, count(*) FILTER (trim(name) = '') AS failed FROM ({IMPORT}) GROUP BY import_id")
def import_summary(spark, sf):
    return A.import_summary(import_profiles(_import_rows(spark, sf)), ["import_id"])


# Two runs over the same orders, by line.
RUN = ("SELECT o_orderpriority AS run, CAST(o_orderkey AS STRING) AS field_name, CASE WHEN o_orderkey % {n} = 0 THEN '' WHEN o_custkey % {m} = 0 THEN o_orderstatus ELSE 'v' END AS value, "
       "CAST(o_orderkey % 7 AS DOUBLE) / 10 AS confidence FROM {{orders}} WHERE o_orderkey % {k} > 0")
RUN_A, RUN_B = RUN.format(n=5, m=3, k=4).replace("{{", "{").replace("}}", "}"), RUN.format(n=7, m=2, k=9).replace("{{", "{").replace("}}", "}")
COMPARED = f"""(SELECT run, field_name, a.value AS value_a, b.value AS value_b, CASE WHEN a.value <> '' AND b.value <> '' THEN CASE WHEN a.value = b.value THEN 'same' ELSE 'different' END
WHEN a.value <> '' THEN 'only_a' WHEN b.value <> '' THEN 'only_b' ELSE 'neither' END AS outcome FROM ({RUN_A}) a FULL OUTER JOIN ({RUN_B}) b USING (run, field_name))"""


def _compared(spark, sf):
    return A.compare_runs(bind(spark, sf, RUN_A), bind(spark, sf, RUN_B))


@query(f"SELECT * FROM {COMPARED}")
def compare_runs(spark, sf):
    return _compared(spark, sf).select("run", "field_name", "value_a", "value_b", "outcome")


@query(f"""SELECT run, count(*) FILTER (outcome IN ('same', 'different')) AS both_filled, count(*) FILTER (outcome = 'same') AS same, count(*) FILTER (outcome = 'different') AS different,
CASE WHEN left(run, 1) = '1' THEN 'A' WHEN left(run, 1) = '2' THEN 'B' WHEN count(value_a) > count(value_b) THEN 'A' WHEN count(value_b) > count(value_a) THEN 'B' ELSE 'tie' END AS winner,
'A' AS faster, left(run, 1) IN ('1', '2') AS usable FROM {COMPARED} GROUP BY run""")
def ab_verdict(spark, sf):
    c = _compared(spark, sf)
    first = F.substring("run", 1, 1)
    runs = c.groupBy("run").agg(F.count("value_a").alias("filled_a"), F.count("value_b").alias("filled_b")).select(
        "run", F.when(first == "1", 0.9).otherwise(0.5).alias("confidence_a"), F.when(first == "2", 0.9).otherwise(0.5).alias("confidence_b"),
        "filled_a", "filled_b", F.lit(1.0).alias("elapsed_a"), F.lit(2.0).alias("elapsed_b"))
    return A.ab_verdict(c, runs)


# Sessions: users with 1 to 4 signers sign in the order of their events.
SIGNS = "SELECT user_id AS session_id, event_id AS seq, CASE WHEN event_type = 'error' AND user_id % 4 = 0 AND event_id % 5 = 0 THEN 'cancel' ELSE 'sign' END AS action, CAST(CAST(floor(value) AS BIGINT) % 5 AS INT) AS signer_index FROM {events}"


def _sessions(spark, sf):
    e = table(spark, sf, "events").select("user_id").distinct()
    return e.select(F.col("user_id").alias("session_id"), (F.col("user_id") % 4 + 1).cast("int").alias("signers"))


SIGN_CHAIN = f"""e AS (SELECT * FROM ({SIGNS})), c AS (SELECT session_id, min(seq) AS cancel_at FROM e WHERE action = 'cancel' GROUP BY session_id),
live AS (SELECT e.* FROM e LEFT JOIN c USING (session_id) WHERE action = 'sign' AND (cancel_at IS NULL OR seq < cancel_at)),
t0 AS (SELECT session_id, min(seq) AS t FROM live WHERE signer_index = 0 GROUP BY session_id),
""" + ",\n".join(f"t{i} AS (SELECT session_id, min(seq) AS t FROM live JOIN t{i - 1} USING (session_id) WHERE signer_index = {i} AND seq > t AND session_id % 4 + 1 > {i} GROUP BY session_id)" for i in range(1, 4)) + """,
acc AS (SELECT session_id, t AS seq FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3)"""


@query(f"""WITH {SIGN_CHAIN}, s AS (SELECT DISTINCT session_id FROM e), n AS (SELECT session_id, count(acc.seq) AS k FROM s LEFT JOIN acc USING (session_id) GROUP BY session_id)
SELECT session_id, CASE WHEN cancel_at IS NOT NULL THEN 'cancelled' WHEN k >= session_id % 4 + 1 THEN 'complete' WHEN k > 0 THEN 'in_progress' ELSE 'pending' END AS status, k AS current_signer_index
FROM n LEFT JOIN c USING (session_id)""")
def fold_signing(spark, sf):
    return SG.fold_signing(bind(spark, sf, SIGNS), _sessions(spark, sf), hot_rows=30)[0].select("session_id", "status", "current_signer_index")


@query(f"""WITH {SIGN_CHAIN}, j AS (SELECT e.session_id, e.seq, e.signer_index, cancel_at, acc.seq IS NOT NULL AS accepted, count(acc.seq) OVER (PARTITION BY e.session_id ORDER BY e.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k
FROM e LEFT JOIN acc USING (session_id, seq) LEFT JOIN c USING (session_id) WHERE action = 'sign')
SELECT session_id, seq, accepted, CASE WHEN accepted THEN NULL WHEN seq > cancel_at THEN 'session cancelled' WHEN k >= session_id % 4 + 1 THEN 'session complete'
ELSE 'out of order: expected ' || CAST(k AS VARCHAR) || ', got ' || CAST(signer_index AS VARCHAR) END AS reason FROM j""")
def judge_signatures(spark, sf):
    return SG.fold_signing(bind(spark, sf, SIGNS), _sessions(spark, sf), hot_rows=30)[1].select("session_id", "seq", "accepted", "reason")


def _people(spark, sf):
    i = F.sequence(F.lit(0), F.col("signers") - 1)
    mail = lambda k: F.when((F.col("session_id") + k) % 5 > 0, F.concat(F.lit("p"), k.cast("string"), F.lit("@example.com"))).otherwise("")
    return _sessions(spark, sf).withColumn("signers", F.transform(i, lambda k: F.struct(k.alias("index"), F.concat(F.lit("P"), k.cast("string")).alias("name"), mail(k).alias("email")))).withColumn("title", F.lit("T"))


MAIL = "CASE WHEN (session_id + {k}) % 5 > 0 THEN 'p' || CAST({k} AS VARCHAR) || '@example.com' END"


@query(f"""WITH {SIGN_CHAIN}, s AS (SELECT DISTINCT session_id, session_id % 4 + 1 AS n FROM e), a AS (SELECT acc.session_id, acc.seq, signer_index AS i, n FROM acc JOIN e USING (session_id, seq) JOIN s USING (session_id)),
m AS (SELECT session_id, -1 AS seq, 'your_turn' AS kind, 0 AS who, 1 AS step, n FROM s UNION ALL SELECT session_id, seq, 'step_done', i, i + 1, n FROM a
UNION ALL SELECT session_id, seq, 'your_turn', i + 1, i + 2, n FROM a WHERE i + 1 < n UNION ALL SELECT session_id, seq, 'complete', w, n, n FROM a, range(0, 4) t(w) WHERE i + 1 = n AND w < n AND w <> i)
SELECT session_id, seq, kind, {MAIL.format(k='who')} AS to_email, 'P' || CAST(who AS VARCHAR) AS to_name, step, greatest(0, n - step) AS remaining FROM m WHERE (session_id + who) % 5 > 0""")
def notifications(spark, sf):
    people = _people(spark, sf)
    return SG.notifications(SG.fold_signing(bind(spark, sf, SIGNS), people, hot_rows=30)[1], people)


@query("""SELECT c_custkey AS id, c_custkey % 5 + 1 AS total_signers, CASE WHEN c_custkey % 3 = 0 THEN 'S0' || c_mktsegment END AS current_name,
CASE WHEN c_custkey % 4 > 0 THEN '/ui/multisign.html?session_id=s' || CAST(c_custkey AS VARCHAR) END AS sign_url, CASE WHEN c_custkey % 4 = 0 THEN '/api/v1/signing-sessions/s' || CAST(c_custkey AS VARCHAR) || '/download' END AS download_url
FROM {customer}""")
def session_summary(spark, sf):
    k = F.col("c_custkey")
    signers = F.transform(F.sequence(F.lit(0), (k % 5).cast("int")), lambda i: F.struct(i.alias("index"), F.concat(F.lit("S"), i.cast("string"), "c_mktsegment").alias("name")))
    s = table(spark, sf, "customer").select(
        k.alias("id"), F.concat(F.lit("s"), k.cast("string")).alias("session_id"), signers.alias("signers"), F.when(k % 4 == 0, "complete").otherwise("pending").alias("status"),
        F.when(k % 3 == 0, 0).otherwise(99).alias("current_signer_index"), F.when(k % 4 == 0, "f.pdf").alias("final_pdf_filename"))
    return SG.session_summary(s).select("id", "total_signers", F.col("current_signer.name").alias("current_name"), "sign_url", "download_url")


# Approvals: one per user and day, decided by that day's events.
APPROVALS = "SELECT CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS approval_id, event_id AS seq, ts, CASE WHEN event_type IN ('click', 'view') THEN 'approved' ELSE 'rejected' END AS decision, CASE WHEN event_type = 'error' THEN 'bad' ELSE 'tok' END AS token, ' ' || event_type || ' ' AS comment FROM {events}"


def _approvals(spark, sf):
    d = bind(spark, sf, APPROVALS).withColumn("ts", F.col("ts").cast("timestamp"))
    a = d.groupBy("approval_id").agg(F.min(F.date_trunc("day", "ts")).alias("day")).select(
        "approval_id", F.lit("tok").alias("token"), AP.expires_at("day", F.lit(18)).alias("expires_at"))
    return AP.fold_approvals(a, d, F.lit("2024-01-20").cast("timestamp"))


FIRST = f"d AS ({APPROVALS}), v AS (SELECT approval_id, min(seq) AS w, arg_min(decision, seq) AS decision, arg_min(trim(comment), seq) AS comment FROM d WHERE token = 'tok' AND hour(ts) < 18 GROUP BY approval_id)"


@query(f"""WITH {FIRST} SELECT approval_id, coalesce(v.decision, CASE WHEN any_value(d.ts) < TIMESTAMP '2024-01-19' OR CAST(any_value(d.ts) AS DATE) = DATE '2024-01-19' THEN 'expired' ELSE 'pending' END) AS status, v.comment
FROM d LEFT JOIN v USING (approval_id) GROUP BY approval_id, v.decision, v.comment""")
def fold_approvals(spark, sf):
    return _approvals(spark, sf)[0].select("approval_id", "status", "comment")


@query(f"""WITH {FIRST} SELECT approval_id, seq, token = 'tok' AND seq = w AND w IS NOT NULL AS accepted, CASE WHEN token <> 'tok' THEN 'invalid token' WHEN seq > w THEN 'already decided: ' || v.decision WHEN hour(ts) >= 18 THEN 'expired' END AS reason
FROM d LEFT JOIN v USING (approval_id)""")
def judge_decisions(spark, sf):
    return _approvals(spark, sf)[1].select("approval_id", "seq", "accepted", "reason")


@query("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) <= DATE '1998-06-01' AND o_orderkey % 5 > 0 AS expired FROM {orders}")
def is_expired(spark, sf):
    text = F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), AP.is_expired(text, F.lit("1998-06-01").cast("timestamp")).alias("expired"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'Untitled' ELSE c_name END AS title, 1700000000 + 3600 * CASE WHEN c_custkey % 4 = 0 THEN 168 ELSE greatest(1, c_custkey % 50) END AS expires_at,
CASE WHEN c_custkey % 7 = 0 THEN 'pdf_filename is required.' WHEN c_custkey % 5 = 0 THEN 'At least reviewer_email or reviewer_name is required.' END AS error FROM {customer}""")
def prepare_approvals(spark, sf):
    k = F.col("c_custkey")
    r = table(spark, sf, "customer").select(
        k.alias("id"), F.when(k % 3 == 0, " ").otherwise(F.col("c_name")).alias("title"), F.when(k % 7 == 0, " ").otherwise("a.pdf").alias("pdf_filename"),
        F.when(k % 5 > 0, "r@example.com").alias("reviewer_email"), F.lit(None).cast("string").alias("reviewer_name"),
        F.timestamp_seconds(F.lit(1700000000)).alias("created_at"), F.when(k % 4 > 0, k % 50).alias("expires_in_hours"))
    return AP.prepare_approvals(r).select("id", "title", F.unix_seconds("expires_at").alias("expires_at"), "error")


BILLING = """SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'customer.subscription.deleted' ELSE 'checkout.session.completed' END AS type, CASE WHEN event_type <> 'error' THEN user_id END AS key_id,
CASE WHEN event_type = 'purchase' THEN 'business' END AS target_tier, CASE WHEN event_type <> 'view' THEN 'cus' || CAST(user_id + CASE WHEN event_id % 11 = 0 THEN 1000 ELSE 0 END AS STRING) END AS customer_id FROM {events}"""


@query(f"""WITH b AS ({BILLING}), k AS (SELECT key_id, arg_max(coalesce(target_tier, 'pro'), seq) AS tier, max(seq) AS s, arg_max(customer_id, seq) FILTER (customer_id IS NOT NULL) AS customer_id FROM b WHERE key_id IS NOT NULL GROUP BY key_id),
d AS (SELECT customer_id, max(seq) AS gone FROM b WHERE type LIKE '%deleted' GROUP BY customer_id) SELECT key_id, customer_id, CASE WHEN gone > s THEN 'free' ELSE tier END AS tier FROM k LEFT JOIN d USING (customer_id)""")
def fold_tiers(spark, sf):
    return SJ.fold_tiers(bind(spark, sf, BILLING)).select("key_id", "customer_id", "tier")
