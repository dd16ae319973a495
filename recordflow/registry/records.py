"""Queries of record overlay, canonical parsing and bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordflow.functions import fixed
from recordflow.operators import records as R
from recordflow.operators.reports import batch_summary
from recordflow.plans import bundle as B, canonical as C
from recordflow.registry.base import bind, query, table
from recordflow.registry.scalars import bool_sql, value_sql
from recordflow.session import spread

# One row per customer: what its record and its profile say.
RAW = """SELECT c_custkey AS id, c_mktsegment AS batch_id, c_custkey % 120 AS profile_id, c_name AS patient_name,
CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'F' || CAST(c_custkey % 50 AS STRING) END AS first_name, 'L' || CAST(c_nationkey AS STRING) AS last_name,
'19' || CAST(50 + c_custkey % 50 AS STRING) || '-07-' || CAST(10 + c_custkey % 18 AS STRING) AS dob, 'M' || CAST(c_custkey AS STRING) AS member_id,
lpad(CAST(c_custkey AS STRING), 10, '5') AS phone, CASE WHEN c_custkey % 3 > 0 THEN 'Town' || CAST(c_custkey % 9 AS STRING) END AS city, n_name AS state,
CASE WHEN c_custkey % 5 > 0 THEN CAST(10000 + c_custkey AS STRING) END AS zip, CASE WHEN c_custkey % 6 > 0 THEN 'M54.' || CAST(c_custkey % 9 AS STRING) END AS icd,
CASE WHEN c_custkey % 2 = 0 THEN 'low back pain' END AS diagnosis, CASE WHEN c_custkey % 7 > 1 THEN 'drug' || CAST(c_custkey % 30 AS STRING) END AS drug,
CASE WHEN c_custkey % 8 > 3 THEN '9' || CAST(c_custkey % 900 AS STRING) END AS cpt, CASE WHEN c_custkey % 5 = 1 THEN '2024-05-' || CAST(10 + c_custkey % 19 AS STRING) END AS start_day,
CASE WHEN c_custkey % 5 < 3 THEN '2024-06-30' END AS end_day, CASE WHEN c_custkey % 11 = 3 THEN 'bogus' WHEN c_custkey % 11 > 6 THEN 'pharmacy' END AS benefit,
CASE WHEN c_custkey % 3 = 1 THEN 'Oab Wet' END AS indication, CASE WHEN c_custkey % 2 = 0 THEN 'y' ELSE 'Maybe' END AS answer, CAST(c_acctbal AS STRING) AS balance,
CASE WHEN c_custkey % 9 = 5 THEN '01-02-2024' END AS signed FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""

# Input key -> column of RAW, in record order; spellings vary on purpose.
ENTRIES = {
    "patientName": "patient_name", "enrollee_first_name": "first_name", "lastName": "last_name", "dateOfBirth": "dob", "plan_id": "member_id",
    "patient_phone_number": "phone", "city": "city", "state": "state", "zipCode": "zip", "icd10_code": "icd", "diagnosis_description": "diagnosis",
    "medication": "drug", "cpt_code": "cpt", "start_date_of_service": "start_day", "service_end_date": "end_day", "benefit": "benefit",
    "indication_for_use": "indication", "oab_wet_initial__urgency": "answer", "migraine__days": "answer", "universal__other": "answer", "q1": "answer",
    "accountBalance": "balance", "date_of_signature": "signed",
}
BASE_ENTRIES = {"phone": "s_phone", "name": "s_name", "prescriber_name": "s_name", "office_phone": "s_phone"}


RECORDS_A_TASK = 5000


def records(spark, sf):
    """Customers as records (id, batch_id, profile_id, entries), spread over tasks by their number."""
    raw = spread(bind(spark, sf, RAW), table(spark, sf, "customer").count(), RECORDS_A_TASK)
    return raw.select("id", "batch_id", "profile_id", R.entries_of({k: F.col(c) for k, c in ENTRIES.items()}).alias("entries"))


def profiles(spark, sf):
    """Suppliers as profiles (profile_id, profile_type, data)."""
    s = table(spark, sf, "supplier").withColumn("s_phone", F.concat(F.lit("1"), F.lpad(F.col("s_suppkey").cast("string"), 10, "6")))
    data = F.map_from_arrays(F.array(*[F.lit(k) for k in BASE_ENTRIES]), F.array(*[F.col(c) for c in BASE_ENTRIES.values()]))
    return s.select(F.col("s_suppkey").alias("profile_id"), F.when(F.col("s_nationkey") % 3 == 0, "provider").otherwise("payer").alias("profile_type"), data.alias("data"))


PROFILE_SQL = "SELECT s_suppkey AS profile_id, s_name, '1' || lpad(CAST(s_suppkey AS VARCHAR), 10, '6') AS s_phone, CASE WHEN s_nationkey % 3 = 0 THEN 'provider' ELSE 'payer' END AS profile_type FROM {supplier}"
ALIAS_PAIRS = ", ".join(f"('{k}', '{n}')" for k, names in fixed.ALIASES.items() for n in dict.fromkeys([k, *names]))


def puts_sql(row: str, provider: tuple[tuple[str, str], ...] = ()) -> str:
    """SQL of all emissions of the flat records in ``row``; ``provider`` adds those of a provider."""
    csz = "nullif(concat_ws(', ', city, state, zip), '')"
    dates = "nullif(concat_ws(' – ', start_day, end_day), '')"
    wanted = "indication IS NULL"
    emitted = [
        ("patient_name", "patient_name"), ("patient_first_name", "first_name"), ("patient_last_name", "last_name"), ("patient_dob", "dob"),
        ("patient_member_id", "member_id"), ("patient_id", "member_id"), ("patient_phone", "phone"), ("patient_city", "city"), ("patient_state", "state"),
        ("patient_zip", "zip"), ("patient_city_state_zip", csz), ("primary_city_state_zip", csz), *provider,
        ("benefit_type", "benefit"), ("indication", "indication"), ("dates_of_service", dates), ("icd_code", "icd"),
        ("diagnosis", "CASE WHEN icd IS NOT NULL THEN diagnosis END"), ("drug_name", "drug"), ("cpt_code_1", "cpt"),
        ("primary_icd_code", "icd"), ("primary_diagnosis", "CASE WHEN icd IS NOT NULL THEN diagnosis END"), ("primary_drug_name", "drug"),
        ("service_dates_display", dates), ("oab_wet_initial__urgency", "answer"), ("urgency", "answer"), ("migraine__days", f"CASE WHEN {wanted} THEN answer END"),
        ("days", f"CASE WHEN {wanted} THEN answer END"), ("universal__other", "answer"), ("other", "answer"), ("q1", "answer"),
        ("signature_date", "signed"), ("account_balance", "balance"), ("signature_date", "signed"),
    ]
    yes_no = bool_sql("answer")
    selects = [f"SELECT id, {i} AS seq, '{k}' AS key, {v.replace('answer', yes_no)} AS value FROM {row}" for i, (k, v) in enumerate(emitted)]
    return " UNION ALL ".join(selects)


def flat_sql(puts: str) -> str:
    """SQL of the flat bundles: normalised, with synonyms, the last emission of a key winning."""
    return f"""SELECT id, key, arg_max(value, seq) AS value FROM (SELECT p.id, coalesce(a.syn, p.key) AS key, p.seq, p.value
FROM (SELECT id, seq, key, {value_sql('key', 'value')} AS value FROM ({puts})) p LEFT JOIN (VALUES {ALIAS_PAIRS}) a(canon, syn) ON p.key = a.canon
WHERE p.value IS NOT NULL) GROUP BY id, key"""


GOOD = f"(SELECT * FROM ({RAW}) WHERE benefit IS DISTINCT FROM 'bogus')"


@query(f"SELECT id, k, n FROM ({RAW}), (VALUES ('placed', 18), ('question', 4), ('custom', 1)) t(k, n)")
def split_entries(spark, sf):
    d = C.split_entries(records(spark, sf))
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.size(c).alias("n")) for k, c in (("placed", "placed"), ("question", "questions"), ("custom", "custom"))])
    return d.select("id", F.explode(kinds).alias("e")).select("id", "e.*")


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderpriority, o_orderstatus FROM {orders}), a(canon, syn) AS (VALUES """ + ALIAS_PAIRS + """),
e AS (SELECT id, 'drug_name' AS key, o_orderpriority AS value FROM r UNION ALL SELECT id, 'zzz', o_orderstatus FROM r)
SELECT id, coalesce(syn, key) AS key, value FROM e LEFT JOIN a ON canon = key""")
def emit_aliases(spark, sf):
    o = table(spark, sf, "orders")
    e = R.entries_of({"drug_name": F.col("o_orderpriority"), "zzz": F.col("o_orderstatus")})
    return o.select(F.col("o_orderkey").alias("id"), F.explode(R.emit_aliases(e)).alias("e")).select("id", "e.key", F.col("e.value").cast("string").alias("value"))


def _overlay_sql() -> str:
    base = [f"SELECT r.id, {i} AS pos, '{k}' AS key, p.{c} AS base, NULL AS own FROM r JOIN p USING (profile_id)" for i, (k, c) in enumerate(BASE_ENTRIES.items())]
    own = [f"SELECT id, {100 + i}, '{k}', NULL, {c} FROM r" for i, (k, c) in enumerate({"name": "patient_name", "zip": "zip"}.items())]
    return (f"WITH r AS ({RAW}), p AS ({PROFILE_SQL}), e AS ({' UNION ALL '.join(base + own)}) "
            "SELECT id, key, CAST(row_number() OVER (PARTITION BY id ORDER BY min(pos)) AS INTEGER) AS position, "
            "CASE WHEN bool_or(pos >= 100) THEN max(own) ELSE max(base) END AS value FROM e GROUP BY id, key")


@query(_overlay_sql())
def overlay(spark, sf):
    r = bind(spark, sf, RAW).select("id", "profile_id", R.entries_of({"name": F.col("patient_name"), "zip": F.col("zip")}).alias("entries"))
    d = R.overlay(r, profiles(spark, sf))
    return d.select("id", F.posexplode("entries").alias("pos", "e")).select(
        "id", "e.key", (F.col("pos") + 1).alias("position"), F.col("e.value").cast("string").alias("value"))


LINKS = "SELECT o_orderkey AS record_id, o_custkey % 110 AS a, o_orderkey % 110 AS b, o_orderkey % 3 AS kind FROM {orders}"


@query(f"""WITH l AS ({LINKS}), ids AS (SELECT record_id, a AS profile_id, 0 AS pos, kind > 0 AS many FROM l UNION ALL SELECT record_id, b, 1, true FROM l WHERE kind > 0),
p AS ({PROFILE_SQL}), d AS (SELECT profile_id, profile_type, 'phone' AS key, s_phone AS value FROM p UNION ALL SELECT profile_id, profile_type, 'name', s_name FROM p
UNION ALL SELECT profile_id, profile_type, 'prescriber_name', s_name FROM p UNION ALL SELECT profile_id, profile_type, 'office_phone', s_phone FROM p),
e AS (SELECT record_id, pos, key, value FROM ids JOIN d USING (profile_id) UNION ALL SELECT record_id, pos, profile_type || '_' || key, value FROM ids JOIN d USING (profile_id) WHERE many)
SELECT record_id, key, arg_max(value, pos) AS value FROM e GROUP BY record_id, key""")
def merge_profiles(spark, sf):
    d = bind(spark, sf, LINKS)
    ids = F.when(F.col("kind") > 0, F.array("a", "b")).otherwise(F.array("a"))
    return R.merge_profiles(d.select("record_id", ids.alias("profile_ids")), profiles(spark, sf))


@query(f"""SELECT id, patient_name AS full_name, first_name, dob, member_id, CASE WHEN icd IS NULL THEN 0 ELSE 1 END AS diagnoses, CASE WHEN drug IS NULL THEN 0 ELSE 1 END AS medications,
start_day AS service_start, 4 AS questions, CASE WHEN signed IS NULL THEN 0 ELSE 1 END AS signatures, balance FROM {GOOD}""")
def parse(spark, sf):
    d = C.parse(records(spark, sf)).where("error IS NULL")
    c = "canonical"
    return d.select(
        "id", f"{c}.primary.full_name", f"{c}.primary.first_name", f"{c}.primary.dob", F.col(f"{c}.primary.identifiers")["member_id"].alias("member_id"),
        F.size(f"{c}.medical.diagnoses").alias("diagnoses"), F.size(f"{c}.medical.medications").alias("medications"),
        F.col(f"{c}.medical.service_dates.start").alias("service_start"), F.size(f"{c}.questions").alias("questions"),
        F.size(f"{c}.signatures").alias("signatures"), F.col(f"{c}.custom")["account_balance"].cast("string").alias("balance"))


NESTED_SQL = """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'nested' ELSE 'flat' END AS shape,
CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority || ' Lee' WHEN 1 THEN o_orderpriority WHEN 2 THEN 'N' || o_orderpriority WHEN 3 THEN NULL END AS full_name,
CASE WHEN o_orderkey % 4 = 3 THEN 'medical.benefit_type' END AS error FROM {orders}"""


@query(NESTED_SQL)
def parse_nested(spark, sf):
    """Nested, invalid nested with a flat name, flat, and invalid flat records."""
    o = table(spark, sf, "orders")
    kind = F.col("o_orderkey") % 4
    person = F.concat(F.lit('{"primary": {"first_name": "'), "o_orderpriority", F.lit('", "last_name": "Lee"}}'))
    wrong = F.concat(F.lit('{"primary": {"first_name": 7}, "patientName": "'), "o_orderpriority", F.lit('"}'))
    flat = F.concat(F.lit('{"member_name": "N'), "o_orderpriority", F.lit('"}'))
    bad = F.lit('{"benefit": "none of these"}')
    text = F.when(kind == 0, person).when(kind == 1, wrong).when(kind == 2, flat).otherwise(bad)
    d = C.parse(o.select(F.col("o_orderkey").alias("id"), R.entries_of_json(text).alias("entries")))
    shape = F.when(F.col("canonical.provider").isNull() & F.col("canonical").isNotNull(), "nested").otherwise("flat")
    return d.select("id", shape.alias("shape"), "canonical.primary.full_name", "error")


@query(f"SELECT id, 'medical.benefit_type' AS error FROM ({RAW}) WHERE benefit = 'bogus'")
def validate(spark, sf):
    return C.validate(records(spark, sf))[1].select("id", "error")


@query(f"""SELECT id, nullif(concat_ws(', ', city, state, zip), '') AS csz, icd AS primary_icd_code, CASE WHEN icd IS NOT NULL THEN diagnosis END AS primary_diagnosis, drug AS primary_drug_name,
nullif(concat_ws(' – ', start_day, end_day), '') AS service_dates, signed AS signature_date FROM {GOOD}""")
def derive(spark, sf):
    d = C.derive(C.parse(records(spark, sf)).where("error IS NULL"))
    med = F.col("canonical.medical.custom")
    return d.select(
        "id", F.col("canonical.primary.custom")["primary_city_state_zip"].cast("string").alias("csz"), med["primary_icd_code"].cast("string").alias("primary_icd_code"),
        med["primary_diagnosis"].cast("string").alias("primary_diagnosis"), med["primary_drug_name"].cast("string").alias("primary_drug_name"),
        med["service_dates_display"].cast("string").alias("service_dates"), F.col("canonical.custom")["signature_date"].cast("string").alias("signature_date"))


@query(f"""SELECT id, q AS question FROM {GOOD}, (VALUES ('urgency'), ('days'), ('other'), ('q1')) t(q) WHERE q <> 'days' OR indication IS NULL""")
def gate_questions(spark, sf):
    d = C.gate_questions(C.parse(records(spark, sf)).where("error IS NULL"))
    return d.select("id", F.explode(F.map_keys("canonical.questions")).alias("question"))


@query(flat_sql(puts_sql(GOOD)))
def flatten(spark, sf):
    d = B.flatten(C.gate_questions(C.derive(C.parse(records(spark, sf)).where("error IS NULL"))))
    return d.select("id", F.explode("flat"))


BASED = f"(SELECT r.*, p.s_name, p.s_phone FROM {GOOD} r LEFT JOIN ({PROFILE_SQL}) p USING (profile_id))"


@query(flat_sql(puts_sql(BASED, (("physician_name", "s_name"), ("physician_phone", "s_phone")))
                + f" UNION ALL SELECT id, 32 AS seq, 'prescriber_signature_name' AS key, CASE WHEN signed IS NOT NULL THEN s_name END AS value FROM {BASED}"))
def to_bundle(spark, sf):
    """Records over profiles: a profile's own ``phone`` and ``name`` come first, the record's spellings of them later, so these win."""
    d = B.to_bundle(records(spark, sf), profiles(spark, sf), with_structured=False, shape="flat").where("error IS NULL")
    return d.select("id", F.explode("flat"))


@query(f"SELECT id, CAST(NULL AS VARCHAR) AS code_system, patient_name AS full_name, icd AS code FROM {GOOD}", "structured")
def structured_json(spark, sf):
    d = B.to_bundle(records(spark, sf)).where("error IS NULL")
    return d.select("id", F.get_json_object("structured", "$.medical.diagnoses[0].code_system").alias("code_system"),
                    F.get_json_object("structured", "$.primary.full_name").alias("full_name"), F.get_json_object("structured", "$.medical.diagnoses[0].code").alias("code"))


@query("""SELECT s.c_custkey AS id, 'diagnosis' || CASE WHEN i = 1 THEN '' ELSE '_' || CAST(i AS VARCHAR) END AS key, 'd' || CAST(i AS VARCHAR) || c_mktsegment AS value
FROM {customer} s, range(1, 6) t(i) WHERE i <= 1 + c_custkey % 5""")
def number_items(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey AS id", "transform(sequence(1, int(1 + c_custkey % 5)), i -> named_struct('description', 'd' || i || c_mktsegment)) AS items")
    return c.select("id", F.explode(F.expr(B.number_items("items", ("diagnosis", "description")))).alias("e")).select("id", "e.key", "e.value")


@query(f"""SELECT batch_id, count(*) AS total_records, count(*) FILTER (benefit IS DISTINCT FROM 'bogus') AS successful, count(*) FILTER (benefit = 'bogus') AS failed,
round(count(*) FILTER (benefit IS DISTINCT FROM 'bogus') / CAST(count(*) AS DOUBLE) * 100, 1) AS success_rate FROM ({RAW}) GROUP BY batch_id""")
def segment_summary(spark, sf):
    """Flagship: records over profiles to bundles, and the outcome per market segment."""
    d = B.to_bundle(records(spark, sf), profiles(spark, sf), with_structured=False, shape="flat", with_flat=False)
    return batch_summary(d.select("batch_id", F.col("error").isNull().alias("success")))


@query("""SELECT o_orderkey, o_orderstatus, o_orderpriority FROM {orders} WHERE trim(CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE o_orderstatus END) <> '' OR o_custkey % 5 > 0""")
def drop_blank_rows(spark, sf):
    o = table(spark, sf, "orders")
    d = o.withColumn("_a", F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderstatus"))).withColumn("_b", F.when(F.col("o_custkey") % 5 > 0, F.col("o_orderpriority")))
    return R.drop_blank_rows(d, ["_a", "_b"]).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("""SELECT o_orderkey AS id, 'b' AS key, o_orderstatus AS value FROM {orders} UNION ALL SELECT o_orderkey, 'c', ' ' FROM {orders} WHERE o_orderkey % 2 = 0""")
def non_empty(spark, sf):
    o = table(spark, sf, "orders")
    data = F.create_map(F.lit(""), F.lit("x"), F.lit("a"), F.lit(""), F.lit("b"), F.col("o_orderstatus"), F.lit("c"), F.when(F.col("o_orderkey") % 2 == 0, " "))
    return o.select(F.col("o_orderkey").alias("id"), F.explode(R.non_empty(data)))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 1 THEN 'patched' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 3 = 0 THEN 1.5 ELSE o_totalprice END AS price FROM {orders}""")
def apply_patch(spark, sf):
    state = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    patch = state.where("id % 4 = 1").select("id", F.lit("patched").alias("status"), F.when(F.col("id") % 3 == 0, 1.5).alias("price"))
    return R.apply_patch(state, patch, "id")


@query("""SELECT o_custkey AS batch_id, count(*) AS rows, 'Maximum 12 rows per batch' AS error FROM {orders} GROUP BY o_custkey HAVING count(*) > 12""")
def check_batch_size(spark, sf):
    return R.check_batch_size(table(spark, sf, "orders").select(F.col("o_custkey").alias("batch_id")), "batch_id", 12)[1]
