"""Queries of sources, sinks and streams: tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from recordflow.functions import secrets
from recordflow.operators import cache_store as K
from recordflow.registry.activity import APPROVALS, JOB_EVENTS, SIGN_CHAIN, SIGNS, SMALL_LIMITS, USAGE, BILLING
from recordflow.registry.base import SQL, bind, query, table
from recordflow.registry.forms import CACHE_ROWS, _cache
from recordflow.session import STATE_STORE, work_folder
from recordflow.sources import readers as R, sinks as W
from recordflow.streaming import approvals as AP, ingest as I, jobs as SJ, progress as PG, replay as RP, signing as SG, usage as U
from recordflow.streaming.state import settled


def _entries(d: DataFrame) -> DataFrame:
    return d.select("idx", F.posexplode("entries").alias("pos", "e")).select("idx", "pos", "e.key", F.col("e.value").cast("string").alias("value"))


RECORD_ROWS = """SELECT CAST(p_partkey AS BIGINT) AS part, n.pos, n.key, CASE n.pos WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN p_name || ', "x"' || chr(10) || p_brand ELSE CASE WHEN p_size > 25 THEN p_type ELSE '' END END AS value
FROM {part}, (VALUES (0, 'partKey'), (1, 'partName'), (2, 'kind')) n(pos, key)"""


def _by_part(d: DataFrame) -> DataFrame:
    keyed = d.select(F.get("entries", F.lit(0))["value"].cast("bigint").alias("part"), F.posexplode("entries").alias("pos", "e"))
    return keyed.select("part", "pos", "e.key", F.coalesce(F.col("e.value").cast("string"), F.lit("")).alias("value"))


def _part_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("partKey"), F.concat("p_name", F.lit(', "x"\n'), "p_brand").alias("partName"),
                                           F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("").alias("kind"))


@query(RECORD_ROWS)
def read_csv_records(spark, sf):
    path = work_folder(spark, "csv")
    _part_texts(spark, sf).write.csv(path, header=True, escape='"', emptyValue="")
    return _by_part(R.read_csv_records(spark, path))


@query("SELECT part, key, value FROM (" + RECORD_ROWS + """) UNION ALL SELECT CAST(p_partkey AS BIGINT), 'brand', p_brand FROM {part} WHERE p_partkey % 3 = 0""")
def read_csv_headers(spark, sf):
    """Files with columns in another order and one more column."""
    path = work_folder(spark, "csv")
    parts = _part_texts(spark, sf)
    third = F.col("partKey").cast("long") % 3 == 0
    brand = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("partKey"), F.col("p_brand").alias("brand"))
    parts.where(~third).write.csv(f"{path}/a", header=True, escape='"', emptyValue="")
    parts.where(third).join(brand, "partKey").select("kind", "brand", "partKey", "partName").write.csv(f"{path}/b", header=True, escape='"', emptyValue="")
    rows = R.read_csv_records(spark, f"{path}/*").select(F.filter("entries", lambda e: e["key"] == "partKey")[0]["value"].cast("string").cast("bigint").alias("part"), F.explode("entries").alias("e"))
    return rows.select("part", "e.key", F.coalesce(F.col("e.value").cast("string"), F.lit("")).alias("value"))


@query("SELECT part, key, value FROM (" + RECORD_ROWS + ")")
def read_profile_import(spark, sf):
    path = work_folder(spark, "import")
    _part_texts(spark, sf).write.csv(path, header=True, escape='"', emptyValue="")
    return R.read_profile_import(spark, path).select(F.col("data")["partKey"].cast("bigint").alias("part"), F.explode("data").alias("key", "value"))


@query("SELECT part, key, value, NULL AS error FROM (" + RECORD_ROWS + ") UNION ALL SELECT NULL, NULL, NULL, 'not a JSON array' FROM {part} WHERE p_partkey <= 2")
def read_json_array(spark, sf):
    """One array per file; two more files are cut off or hold no array."""
    path = work_folder(spark, "json-array")
    rows = _part_texts(spark, sf).withColumn("k", F.col("partKey").cast("long") % 20)
    arrays = rows.groupBy("k").agg(F.to_json(F.collect_list(F.struct("partKey", "partName", "kind"))).alias("value"))
    bad = table(spark, sf, "part").where("p_partkey <= 2").select((F.col("p_partkey") + 100).alias("k"), F.when(F.col("p_partkey") == 1, '[{"partKey": 1').otherwise('{"partKey": 2}').alias("value"))
    arrays.unionByName(bad).write.partitionBy("k").text(path)
    got = R.read_json_records(spark, f"{path}/*")
    rows = got.select(F.filter("entries", lambda e: e["key"] == "partKey")[0]["value"].cast("string").cast("bigint").alias("part"), F.explode_outer("entries").alias("e"), "error")
    return rows.select("part", "e.key", F.when(F.col("error").isNull(), F.coalesce(F.col("e.value").cast("string"), F.lit(""))).alias("value"), "error")


@query(RECORD_ROWS)
def read_json_records(spark, sf):
    path = work_folder(spark, "json")
    _part_texts(spark, sf).write.json(path)
    return _by_part(R.read_json_records(spark, path, lines=True))


EXTRACT_ROWS = "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS name, NULLIF(l_returnflag, 'N') AS label, CAST(l_suppkey AS VARCHAR) AS value, CAST(l_linenumber AS INTEGER) AS page, l_linestatus AS field_type FROM {lineitem}"


def _extracts(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("name"), F.nullif("l_returnflag", F.lit("N")).alias("label"),
                     F.col("l_suppkey").cast("string").alias("value"), F.col("l_linenumber").alias("page"), F.col("l_linestatus").alias("field_type"))


EXTRACT = "name string, label string, value string, page int, field_type string"


@query(EXTRACT_ROWS)
def write_extract_csv(spark, sf):
    path = work_folder(spark, "extract-csv")
    W.write_extract_csv(_extracts(spark, sf), path)
    return spark.read.schema(EXTRACT).csv(path, header=True)


@query(EXTRACT_ROWS)
def write_extract_json(spark, sf):
    path = work_folder(spark, "extract-json")
    W.write_extract_json(_extracts(spark, sf), path)
    return spark.read.schema(EXTRACT).json(path)


@query("""SELECT o_orderpriority AS batch_id, 'header' AS kind, NULL AS idx, count(*) AS total_records, count(*) FILTER (o_orderstatus <> 'P') AS successful FROM {orders} GROUP BY o_orderpriority
UNION ALL SELECT o_orderpriority, 'result', o_orderkey, NULL, CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END FROM {orders}""")
def write_batch_report(spark, sf):
    path = work_folder(spark, "report")
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("batch_id"), F.col("o_orderkey").alias("idx"), (F.col("o_orderstatus") != "P").alias("success"))
    W.write_batch_report(o, path)
    head = spark.read.schema("batch_id string, total_records bigint, successful bigint").json(f"{path}/header")
    rows = spark.read.schema("batch_id string, idx bigint, success boolean").json(f"{path}/results")
    return head.select("batch_id", F.lit("header").alias("kind"), F.lit(None).cast("bigint").alias("idx"), "total_records", "successful").unionByName(
        rows.select("batch_id", F.lit("result").alias("kind"), "idx", F.lit(None).cast("bigint").alias("total_records"), F.col("success").cast("bigint").alias("successful")))


def _audit(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.concat(F.lit("sig_"), F.col("event_id").cast("string")).alias("audit_id"), F.lit("signature.applied").alias("event"),
                    F.col("user_id").cast("string").alias("api_key_id"), F.create_map(F.lit("x"), "value").alias("placement_pct"))


AUDIT_ROWS = "SELECT 'sig_' || CAST(event_id AS VARCHAR) AS audit_id, CAST(user_id AS VARCHAR) AS api_key_id, value AS x FROM {events}"


@query(AUDIT_ROWS)
def append_audit(spark, sf):
    """Two appends, read back; broken and blank lines are skipped."""
    path = work_folder(spark, "audit")
    a = _audit(spark, sf)
    W.append_audit(a.where("length(api_key_id) < 2"), path)
    W.append_audit(a.where("length(api_key_id) >= 2"), path)
    spark.range(3).select(F.when(F.col("id") == 0, "").otherwise("{broken").alias("value")).write.mode("append").text(path)
    return R.read_audit(spark, path).select("audit_id", "api_key_id", F.col("placement_pct")["x"].alias("x"))


@query(AUDIT_ROWS)
def ingest_audit(spark, sf):
    path, sink = work_folder(spark, "audit-in"), work_folder(spark, "audit-out")
    W.append_audit(_audit(spark, sf), path)
    I.ingest_audit(spark, path, sink, sink.rsplit("/", 1)[1]).awaitTermination()
    return spark.read.parquet(sink).select("audit_id", "api_key_id", F.col("placement_pct")["x"].alias("x"))


@query(f"SELECT fingerprint, max(tm) AS cached_at, arg_max(o_orderstatus, tm) AS status FROM {CACHE_ROWS} GROUP BY fingerprint")
def upsert_cache(spark, sf):
    path = work_folder(spark, "cache")
    c = _cache(spark, sf)
    half = F.col("n") % 2 == 0
    K.upsert_cache(c.where(half).drop("n"), path)
    K.upsert_cache(c.where(~half).drop("n"), path)
    return K.read_cache(spark, path).select("fingerprint", F.unix_seconds("cached_at").alias("cached_at"), F.col("mappings")["status"]["value"].alias("status"))


@query(f"""WITH first AS (SELECT fingerprint, max(tm) AS tm, arg_max(o_orderstatus, tm) AS status, min(c) AS c FROM {CACHE_ROWS} WHERE n % 2 = 0 GROUP BY fingerprint),
late AS (SELECT fingerprint, max(tm) AS tm, arg_max(o_orderstatus, tm) AS status FROM {CACHE_ROWS} WHERE n % 2 = 1 GROUP BY fingerprint),
gone AS (SELECT fingerprint, 852076800 AS tm FROM first WHERE c < 5)
SELECT fingerprint, CASE WHEN l.tm IS NULL OR f.tm > l.tm THEN f.status ELSE l.status END AS status, greatest(f.tm, l.tm) AS cached_at
FROM first f FULL JOIN late l USING (fingerprint) LEFT JOIN gone g USING (fingerprint) WHERE g.tm IS NULL OR greatest(f.tm, l.tm) > g.tm""")
def invalidate_store(spark, sf):
    """Half of the entries, deletions of some as of 1997, then the other half: a deletion takes out what is older than it, whenever that arrives."""
    path, c = work_folder(spark, "cache"), _cache(spark, sf)
    half, asked = F.col("n") % 2 == 0, F.substring("fingerprint", 3, 20).cast("bigint") % 10 < 5
    K.upsert_cache(c.where(half).drop("n"), path)
    K.invalidate_store(spark, path, F.timestamp_seconds(F.lit(852076800)), c.where(asked).select("fingerprint"))
    K.upsert_cache(c.where(~half).drop("n"), path)
    K.compact(spark, path, F.timestamp_seconds(F.lit(0)))
    return K.read_cache(spark, path).select("fingerprint", F.col("mappings")["status"]["value"].alias("status"), F.unix_seconds("cached_at").alias("cached_at"))


@query("SELECT DISTINCT 'fp' || CAST(o_custkey AS VARCHAR) AS fingerprint, 'Zip' AS field_name, CAST(o_custkey AS VARCHAR) AS value, 1.0::DOUBLE AS confidence FROM {orders}")
def incremental_cache(spark, sf):
    """Orders as a stream of requests, one per customer key."""
    path, cache = work_folder(spark, "requests"), work_folder(spark, "cache")
    o = table(spark, sf, "orders").select(F.concat(F.lit("fp"), F.col("o_custkey").cast("string")).alias("fingerprint"), F.lit("form").alias("doc_id"),
                                          F.create_map(F.lit("zip"), F.col("o_custkey").cast("string")).alias("flat"))
    o.repartition(2).write.parquet(path)
    labeled = spark.createDataFrame([("form", "Zip", "zip code")], "doc_id string, field_name string, label string")
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(path)
    I.incremental_cache(stream, labeled, cache, name=cache.rsplit("/", 1)[1]).awaitTermination()
    return K.read_cache(spark, cache).select("fingerprint", F.explode("mappings").alias("field_name", "m")).select("fingerprint", "field_name", "m.value", "m.confidence")


DOCUMENTS = "SELECT CAST(s_suppkey AS STRING) AS id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'done' ELSE 'queued' END AS status, CAST(s_nationkey AS INTEGER) AS record_count FROM {supplier}"


@query(DOCUMENTS.replace("s_name AS name, ", ""))
def read_jobs(spark, sf):
    """One document per file; a payload beside them and a file that cannot be read are left out."""
    path = work_folder(spark, "jobs")
    d = bind(spark, sf, DOCUMENTS)
    W.write_documents(d.select("id", "status", "record_count"), path)
    spark.range(1).select(F.lit("{broken").alias("value")).write.text(f"{path}/k=broken")
    return R.read_jobs(spark, path).select("id", "status", "record_count")


@query(DOCUMENTS.replace(", CAST(s_nationkey AS INTEGER) AS record_count", "").replace("CASE WHEN s_suppkey % 3 = 0 THEN 'done' ELSE 'queued' END AS status", "s_suppkey % 7 AS used"))
def read_profiles(spark, sf):
    path = work_folder(spark, "profiles")
    d = bind(spark, sf, DOCUMENTS)
    data = F.create_map(F.lit("used"), (F.col("id").cast("long") % 7).cast("string"))
    W.write_documents(d.select("id", "name", data.alias("data")), path)
    return R.read_profiles(spark, path).select("id", "name", F.col("data")["used"].cast("bigint").alias("used"))


def _one_file_each(d: DataFrame, path: str, folders: bool = False) -> str:
    """Every row as a document, with ``folders`` in a folder of its id, and one more file that cannot be read."""
    W.write_documents(d.withColumn("k", d[d.columns[0]]) if folders else d, path, "k" if folders else None)
    d.sparkSession.range(1).select(F.lit("{broken").alias("value")).write.text(f"{path}/k=broken")
    return path


@query("""SELECT 't' || CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, CASE WHEN s_suppkey % 3 > 0 THEN 'brand ' || CAST(s_nationkey AS VARCHAR) END AS payer, CAST(s_suppkey % 3 AS INTEGER) AS question_count,
'k=t' || CAST(s_suppkey AS VARCHAR) AS folder FROM {supplier} WHERE s_suppkey % 7 > 0""")
def read_catalog(spark, sf):
    """Manifests in folders; those without a name, and a broken one, are left out."""
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    question = F.struct(F.lit("k").alias("key"), F.lit("t").alias("text"))
    m = s.select(F.concat(F.lit("t"), k.cast("string")).alias("id"), F.when(k % 7 > 0, F.col("s_name")).alias("name"), F.array_repeat(question, (k % 3).cast("int")).alias("questions"),
                 F.when(k % 3 > 0, F.struct(F.concat(F.lit("brand "), F.col("s_nationkey").cast("string")).alias("name"))).alias("payer"))
    got = R.read_catalog(spark, _one_file_each(m, work_folder(spark, "catalog"), folders=True), "*.json")
    return got.select("id", "name", F.col("payer.name").alias("payer"), F.size("questions").alias("question_count"), "folder")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS session_id, s_name AS title, CAST(s_suppkey % 2 AS INTEGER) AS current_signer_index, n AS signer, 'signer ' || CAST(s_nationkey + n AS VARCHAR) AS name, CAST(n * 12.5 AS DOUBLE) AS x_pct
FROM {supplier}, (VALUES (0), (1), (2)) v(n) WHERE n <= s_suppkey % 3""")
def read_sessions(spark, sf):
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    signers = F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda n: F.struct(n.alias("index"), F.concat(F.lit("signer "), (F.col("s_nationkey") + n).cast("string")).alias("name"), (n * 12.5).alias("x_pct")))
    d = s.select(k.cast("string").alias("session_id"), F.col("s_name").alias("title"), (k % 2).cast("int").alias("current_signer_index"), signers.alias("signers"))
    got = R.read_sessions(spark, _one_file_each(d, work_folder(spark, "sessions")), "*.json")
    return got.select("session_id", "title", "current_signer_index", F.explode("signers").alias("g")).select(
        "session_id", "title", "current_signer_index", F.col("g.index").alias("signer"), "g.name", "g.x_pct")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS approval_id, s_name AS title, CASE s_suppkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'rejected' END AS status, CASE WHEN s_suppkey % 2 = 0 THEN 'no "x"' || chr(10) || s_name END AS comment FROM {supplier}""")
def read_approvals(spark, sf):
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    status = F.when(k % 3 == 0, "pending").when(k % 3 == 1, "approved").otherwise("rejected")
    d = s.select(k.cast("string").alias("approval_id"), F.col("s_name").alias("title"), status.alias("status"), F.when(k % 2 == 0, F.concat(F.lit('no "x"\n'), "s_name")).alias("comment"))
    return R.read_approvals(spark, _one_file_each(d, work_folder(spark, "approvals")), "*.json").select("approval_id", "title", "status", "comment")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 4 > 0 THEN 'pro' END AS tier, CAST(s_nationkey AS BIGINT) * 10000000000 AS request_count FROM {supplier}")
def read_api_keys(spark, sf):
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    d = s.select(k.cast("string").alias("id"), F.when(k % 4 > 0, "pro").alias("tier"), (F.col("s_nationkey").cast("long") * 10_000_000_000).alias("request_count"))
    return R.read_api_keys(spark, _one_file_each(d, work_folder(spark, "keys"))).select("id", "tier", "request_count")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS fingerprint, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey * 86400 END AS cached_at, 'Zip' AS field_name, CAST(s_nationkey AS VARCHAR) AS value, CAST(s_suppkey % 4 AS DOUBLE) / 4 AS confidence FROM {supplier}")
def read_cache_documents(spark, sf):
    """Cached mappings; a time that cannot be read is null."""
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    at = F.when(k % 5 > 0, F.date_format(F.timestamp_seconds(k.cast("long") * 86400), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    mapped = F.create_map(F.lit("Zip"), F.struct(F.col("s_nationkey").cast("string").alias("value"), (k % 4 / 4).cast("double").alias("confidence"), F.lit("model").alias("source")))
    d = s.select(k.cast("string").alias("fingerprint"), F.lit(1).alias("version"), at.alias("cached_at"), mapped.alias("mappings"))
    got = R.read_cache_documents(spark, _one_file_each(d, work_folder(spark, "cached")))
    return got.select("fingerprint", F.unix_seconds("cached_at").alias("cached_at"), F.explode("mappings").alias("field_name", "m")).select("fingerprint", "cached_at", "field_name", "m.value", "m.confidence")


@query("""SELECT o_orderkey AS job_id, o_orderkey % 3 AS micro_batch, CASE o_orderstatus WHEN 'F' THEN 'job.done' ELSE 'job.failed' END AS event FROM {orders} WHERE o_orderstatus IN ('F', 'P')""")
def on_batch(spark, sf):
    """A hook that gets every micro-batch of finished jobs and posts their events: here to a table, one folder per batch, so that a replayed batch replaces itself."""
    o = table(spark, sf, "orders")
    source, posted = work_folder(spark, "finished"), work_folder(spark, "posted")
    for i in range(3):
        o.where(F.col("o_orderkey") % 3 == i).select("o_orderkey", "o_orderstatus").coalesce(1).write.mode("append").parquet(source)

    def post(batch: DataFrame, number: int) -> None:
        event = F.when(F.col("o_orderstatus") == "F", "job.done").otherwise("job.failed")
        batch.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderkey") % 3, event.alias("event")).toDF("job_id", "micro_batch", "event").write.mode("overwrite").parquet(f"{posted}/number={number}")

    stream = spark.readStream.schema("o_orderkey long, o_orderstatus string").option("maxFilesPerTrigger", 1).parquet(source).where("o_orderstatus IN ('F', 'P')")
    I.on_batch(stream, post, posted.rsplit("/", 1)[1] + "-state").awaitTermination()
    return spark.read.parquet(posted).select("job_id", "micro_batch", "event")


@query("SELECT count(*) AS completed, count(*) FILTER (o_orderstatus = 'F') AS successful, count(*) FILTER (o_orderstatus IS DISTINCT FROM 'F') AS failed FROM {orders}")
def observed(spark, sf):
    """Metrics gathered while the rows pass on to a sink."""
    from pyspark.sql import Observation
    from recordflow.operators.reports import observed
    seen = Observation("progress")
    o = table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").alias("success"))
    observed(o, seen).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([seen.get], "completed bigint, successful bigint, failed bigint")


@query("""SELECT o_orderkey AS approval_id, 'r' || CAST(o_custkey AS VARCHAR) || '@example.com' AS to_email, o_orderpriority AS title, CASE o_orderstatus WHEN 'F' THEN 'approved' ELSE 'rejected' END AS decision
FROM {orders} WHERE o_orderstatus IN ('F', 'O') AND o_custkey % 4 > 0""")
def decision_notices(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "rejected").otherwise("pending")
    mail = F.when(F.col("o_custkey") % 4 > 0, F.concat(F.lit("r"), F.col("o_custkey").cast("string"), F.lit("@example.com"))).when(F.col("o_custkey") % 8 == 0, "")
    a = o.select(F.col("o_orderkey").alias("approval_id"), status.alias("status"), mail.alias("requester_email"), F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("comment"))
    return SG.decision_notices(a).select("approval_id", "to_email", "title", "decision")


def run_stream(spark: SparkSession, events: DataFrame, build, mode: str = "append", batches: int = 0, then: DataFrame | None = None) -> DataFrame:
    """Write events to a folder, stream them through and read the output table.

    With ``batches`` the events are shuffled over that many files, one per micro-batch; ``then`` are events of a last one.
    """
    if batches:
        events = events.repartition(batches, F.xxhash64(*[c for c in events.columns if c == "seq"], F.lit(7)))
    source, sink = work_folder(spark, "in"), work_folder(spark, "out")
    events.write.parquet(source)
    if then is not None:
        then.coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    reader = spark.readStream.schema(spark.read.parquet(source).schema)
    out = build((reader.option("maxFilesPerTrigger", 1) if batches else reader).parquet(source))
    writer = out.writeStream.option("checkpointLocation", f"{sink}-state").outputMode(mode).trigger(availableNow=True)
    writer.format("parquet").option("path", sink).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


@query(f"""WITH {SIGN_CHAIN} SELECT CAST(e.session_id AS VARCHAR) AS session_id, e.seq, acc.seq IS NOT NULL AS accepted FROM e LEFT JOIN acc USING (session_id, seq) WHERE action = 'sign'""")
def stream_signing(spark, sf):
    signs = bind(spark, sf, SIGNS).withColumn("session_id", F.col("session_id").cast("string")).withColumn("signers", F.lit(None).cast("int"))
    n = (F.col("session_id").cast("int") % 4 + 1).cast("int")
    created = signs.select("session_id").distinct().select("session_id", F.lit(-1).cast("bigint").alias("seq"), F.lit("create").alias("action"), F.lit(-1).alias("signer_index"), n.alias("signers"))
    out = run_stream(spark, signs.unionByName(created), SG.stream_signing, batches=5)
    return settled(out, "session_id", "seq").select("session_id", "seq", "accepted")


@query(SQL["judge_decisions"])
def stream_approvals(spark, sf):
    d = bind(spark, sf, APPROVALS).select("approval_id", "seq", F.col("ts").cast("timestamp").alias("ts"), F.col("decision").alias("action"), "token", F.lit(None).cast("int").alias("expires_in_hours"))
    created = d.groupBy("approval_id").agg(F.min(F.date_trunc("day", "ts")).alias("ts")).select(
        "approval_id", F.lit(-1).cast("bigint").alias("seq"), "ts", F.lit("create").alias("action"), F.lit("tok").alias("token"), F.lit(18).alias("expires_in_hours"))
    out = settled(run_stream(spark, d.unionByName(created), lambda s: AP.stream_approvals(s, "100 days"), batches=5), "approval_id", "seq")
    return out.where("seq >= 0").select("approval_id", "seq", "accepted", "reason")


EXPIRING = """SELECT s_suppkey AS id, TIMESTAMP '2024-01-01 00:00:00' + CAST(s_suppkey AS INT) * INTERVAL '1' HOUR AS created, 1 + CAST(s_nationkey AS INT) AS hours FROM {supplier}"""


@query(f"""WITH a AS (SELECT id, created, hours, created + hours * INTERVAL 1 HOUR AS ends FROM ({EXPIRING})),
e AS (SELECT created AS ts FROM a UNION ALL SELECT created + INTERVAL 1 MINUTE FROM a WHERE id % 3 = 0 UNION ALL SELECT ends + INTERVAL 10 MINUTE FROM a WHERE id % 3 = 2)
SELECT CAST(id AS VARCHAR) AS approval_id FROM a WHERE id % 3 <> 0 AND ends <= (SELECT max(ts) - INTERVAL 90 MINUTE FROM e)""")
def stream_expiry(spark, sf):
    """Approvals that the watermark finds open at their end: never decided, or too late.

    Events come shuffled over five batches, so decisions may come before what they decide; the watermark moves when a last one has come."""
    a = bind(spark, sf, EXPIRING).withColumn("created", F.col("created").cast("timestamp"))
    kind = F.col("id") % 3
    named = [F.col("id").cast("string").alias("approval_id")]
    none = F.lit(None).cast("int").alias("expires_in_hours")
    ends = F.timestamp_micros(F.unix_micros("created") + F.col("hours").cast("long") * 3_600_000_000)
    create = a.select(*named, F.lit(0).cast("long").alias("seq"), F.col("created").alias("ts"), F.lit("create").alias("action"), F.lit("tok").alias("token"), F.col("hours").cast("int").alias("expires_in_hours"))
    early = a.where(kind == 0).select(*named, F.lit(1).cast("long").alias("seq"), (F.col("created") + F.expr("INTERVAL '1' MINUTE")).alias("ts"), F.lit("approved").alias("action"), F.lit("tok").alias("token"), none)
    late = a.where(kind == 2).select(*named, F.lit(1).cast("long").alias("seq"), (ends + F.expr("INTERVAL '10' MINUTE")).alias("ts"), F.lit("approved").alias("action"), F.lit("tok").alias("token"), none)
    all_ = create.unionByName(early).unionByName(late)
    clock = all_.agg(F.max("ts").alias("ts")).select(F.lit("clock").alias("approval_id"), F.lit(9).cast("long").alias("seq"), (F.col("ts") - F.expr("INTERVAL '90' MINUTE") + F.expr("INTERVAL '100' DAY")).alias("ts"),
                                                     F.lit("approved").alias("action"), F.lit("").alias("token"), none)
    out = run_stream(spark, all_, lambda s: AP.stream_approvals(s, "100 days"), batches=5, then=clock)
    return out.where("seq = -1 AND status = 'expired'").select("approval_id")


@query(SQL["fold_jobs"].replace("SELECT job_id, CASE", "SELECT CAST(job_id AS VARCHAR) AS job_id, CASE", 1))
def stream_jobs(spark, sf):
    """Jobs as a stream of their events, shuffled over micro-batches, leaves them."""
    e = bind(spark, sf, JOB_EVENTS)
    e = e.select(F.col("job_id").cast("string").alias("job_id"), *[c for c in e.columns if c != "job_id"])
    out = run_stream(spark, e, SJ.stream_jobs, batches=5)
    return SJ.latest_jobs(out)


@query(SQL["fold_tiers"].replace("SELECT key_id,", "SELECT CAST(key_id AS VARCHAR) AS key_id,", 1))
def stream_tiers(spark, sf):
    """Tier and customer per key as a stream of billing events, shuffled over micro-batches, leaves them."""
    e = bind(spark, sf, BILLING).withColumn("key_id", F.col("key_id").cast("string"))
    return SJ.latest_tiers(run_stream(spark, e, SJ.stream_tiers, batches=5))


@query(SQL["limit_breaches"] + " AND date_trunc('day', start) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_breaches(spark, sf):
    """Breaches of the days that the watermark, an hour behind the last event, has closed."""
    e = bind(spark, sf, USAGE).withColumn("ts", F.col("ts").cast("timestamp"))
    out = run_stream(spark, e, lambda s: U.limit_breaches(s, SMALL_LIMITS))
    return out.withColumn("period_start", F.date_format("period_start", "yyyy-MM-dd HH:mm"))


ARRIVALS = """SELECT event_id, event_id % 1300 AS after, event_id % 7 = 1 AS forged, again FROM {events}, (VALUES (0), (1)) r(again) WHERE again = 0 OR event_id % 4 = 0"""


@query(f"""SELECT event_id, CASE WHEN forged THEN 'invalid signature' WHEN after + 30 * again > 600 THEN 'outside the replay window' ELSE 'accepted' END AS outcome FROM ({ARRIVALS}) GROUP BY ALL""")
def stream_replay(spark, sf):
    """Every fourth event is sent once more half a minute later, every seventh with a changed body; arrivals are shuffled over micro-batches."""
    e = table(spark, sf, "events")
    signed = e.select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("signed_at"), F.concat("props", F.col("event_id").cast("string")).alias("body"), (F.col("event_id") % 7 == 1).alias("forged"),
                      F.explode(F.when(F.col("event_id") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("seq"))
    sent = signed.withColumn("signature", secrets.sign_event("signed_at", "body", "s3cret")).withColumn("arrived_at", F.timestamp_seconds(F.col("signed_at") + F.col("event_id") % 1300 + 30 * F.col("seq")))
    sent = sent.withColumn("body", F.when(F.col("forged"), F.concat("body", F.lit("!"))).otherwise(F.col("body"))).select("event_id", "seq", "signed_at", "body", "signature", "arrived_at")
    source, path = work_folder(spark, "arrivals"), work_folder(spark, "judged")
    sent.repartition(4, F.xxhash64("event_id", "seq")).write.parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(source)
    RP.ingest_events(stream, path, path.rsplit("/", 1)[1] + "-state", secret="s3cret", delay="60 days").awaitTermination()
    fresh = RP.accepted(spark, path).select("event_id", F.lit("accepted").alias("outcome"))
    return fresh.unionByName(RP.refused(spark, path).select("event_id", F.col("reason").alias("outcome")))


@query("""WITH b AS (SELECT o_orderkey % 3 AS micro_batch, count(*) AS completed, count(*) FILTER (o_orderstatus = 'F') AS successful FROM {orders} GROUP BY o_orderkey % 3)
SELECT micro_batch, completed, successful, completed - successful AS failed, CAST(sum(completed) OVER (ORDER BY micro_batch) AS BIGINT) AS so_far FROM b""")
def live_progress(spark, sf):
    """Counts of each micro-batch as a listener hears them while results stream through."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"), (F.col("o_orderstatus") == "F").alias("success"))
    source, sink = work_folder(spark, "results"), work_folder(spark, "reported")
    for i in range(3):
        o.where(F.col("idx") % 3 == i).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(source)
    listener = PG.LiveProgress("records")
    spark.streams.addListener(listener)
    try:
        run = PG.with_progress(stream, "records").writeStream.option("checkpointLocation", f"{sink}-state").trigger(availableNow=True).format("parquet").option("path", sink).start()
        run.awaitTermination()
        listener.wait(run.runId)
    finally:
        spark.streams.removeListener(listener)
    ticks = listener.table(spark)
    return ticks.select("micro_batch", "completed", "successful", "failed", F.sum("completed").over(Window.orderBy("micro_batch")).alias("so_far"))
