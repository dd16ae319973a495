"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordflow.functions import fixed, geometry as G, scalars as S, secrets
from recordflow.functions.responses import parse_mapping_response, parse_zone_response
from recordflow.operators import records as R
from recordflow.registry.base import bind, pick, project, query, quoted, table

SNAKE = (r"lower(regexp_replace(regexp_replace(s, '(.)([A-Z][a-z]+)', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g'))")
project("to_snake", "SELECT doc_id AS id, text AS s FROM {documents}", lambda: S.to_snake("s"), SNAKE)

KEYS = [*sorted(fixed.CANONICAL_OF), "patient_zip", "unheard_of", "drug_sig", "other key"]
KEY = pick(KEYS, "o_orderkey")
ALIAS_ROWS = ", ".join(f"('{s}', '{c}')" for s, c in fixed.CANONICAL_OF.items())
project("canonical_key", f"SELECT o_orderkey AS id, {KEY} AS k FROM {{orders}}", lambda: S.canonical_key("k"),
        f"coalesce((SELECT c FROM (VALUES {ALIAS_ROWS}) a(s, c) WHERE a.s = k), k)")

DIGITS = "lpad(CAST(c_custkey AS STRING), 10, '5')"
PHONE = (f"CASE c_custkey % 6 WHEN 0 THEN {DIGITS} WHEN 1 THEN '1' || {DIGITS} WHEN 2 THEN '+1 (' || substr({DIGITS}, 1, 3) || ') ' || substr({DIGITS}, 4, 7) "
         f"WHEN 3 THEN c_name WHEN 4 THEN '2' || {DIGITS} ELSE substr({DIGITS}, 1, 3) || '.' || substr({DIGITS}, 4, 3) || '.' || substr({DIGITS}, 7, 4) END")


def phone_sql(s: str) -> str:
    d = f"regexp_replace({s}, '[^0-9]', '', 'g')"
    last = f"right({d}, 10)"
    return (f"CASE WHEN length({d}) = 10 OR (length({d}) = 11 AND left({d}, 1) = '1') "
            f"THEN '(' || substr({last}, 1, 3) || ') ' || substr({last}, 4, 3) || '-' || substr({last}, 7, 4) ELSE {s} END")


# ``trim`` with these blanks, as both engines read them.
BLANKS = " || ".join(f"chr({ord(c)})" for c in fixed.WHITE_SPACE)
TAB, END = "chr(9)", "chr(10)"


def strip_sql(s: str) -> str:
    return f"trim({s}, {BLANKS})"


def date_sql(s: str) -> str:
    s = strip_sql(s)
    d2, d4 = "[0-9]" * 2, "[0-9]" * 4
    return (rf"CASE WHEN regexp_full_match({s}, '{d4}-{d2}-{d2}') THEN regexp_replace({s}, '(....)-(..)-(..)', '\2/\3/\1') "
            rf"WHEN regexp_full_match({s}, '{d2}-{d2}-{d4}') THEN regexp_replace({s}, '(..)-(..)-(....)', '\2/\1/\3') "
            f"ELSE {s} END")


def bool_sql(s: str) -> str:
    return (f"CASE WHEN lower({strip_sql(s)}) IN ({quoted(fixed.YES_WORDS)}) THEN 'Yes' "
            f"WHEN lower({strip_sql(s)}) IN ({quoted(fixed.NO_WORDS)}) THEN 'No' ELSE {s} END")


def value_sql(k: str, s: str) -> str:
    def has(words) -> str:
        return "(" + " OR ".join(f"contains({k}, '{w}')" for w in words) + ")"
    t = f"nullif({strip_sql(s)}, '')"
    return f"CASE WHEN {has(fixed.PHONE_HINTS)} THEN {phone_sql(t)} WHEN {has(fixed.DATE_HINTS)} THEN {date_sql(t)} ELSE {t} END"


project("normalise_phone", f"SELECT c_custkey AS id, {PHONE} AS s FROM {{customer}}", lambda: S.normalise_phone("s"), phone_sql("s"))
DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
DATE = (f"CASE o_orderkey % 5 WHEN 0 THEN {DAY} WHEN 1 THEN {TAB} || {DAY} || {END} WHEN 2 THEN substr({DAY}, 9, 2) || '-' || substr({DAY}, 6, 2) || '-' || substr({DAY}, 1, 4) "
        f"WHEN 3 THEN '3/9/' || substr({DAY}, 1, 4) ELSE 'on ' || {DAY} END")
project("normalise_date", f"SELECT o_orderkey AS id, {DATE} AS s FROM {{orders}}", lambda: S.normalise_date("s"), date_sql("s"))
WORDS = [" TRUE ", "\tyes\n", "Y", "1\r\n", "x", "False", "\u00a0no", " n", "0", "Maybe", "", " on\t"]
project("normalise_bool", f"SELECT event_id AS id, {pick(WORDS, 'event_id')} AS s FROM {{events}}", lambda: S.normalise_bool("s"), bool_sql("s"))
VALUE_KEYS = ["phone", "hotel", "update", "patient_dob", "fax_date", "name", "start_date", "note"]
project("normalise_value", f"SELECT o_orderkey AS id, {pick(VALUE_KEYS, 'o_orderkey')} AS k, CASE o_orderkey % 7 WHEN 0 THEN lpad(CAST(o_orderkey AS STRING), 10, '4') "
        f"WHEN 1 THEN ' ' || {TAB} WHEN 2 THEN {END} || o_orderpriority ELSE {DAY} END AS s FROM {{orders}}", lambda: S.normalise_value(F.col("k"), "s"), value_sql("k", "s"))

NAMES = ("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 9 = 1 THEN 'Given Name' END AS given, CASE WHEN c_custkey % 3 = 0 THEN 'Dr.' END AS title, "
         "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS first, CASE WHEN c_custkey % 7 > 2 THEN c_mktsegment END AS last, CASE WHEN c_nationkey > 12 THEN 'Jr.' ELSE '' END AS suffix FROM {customer}")
project("full_name", NAMES, lambda: S.full_name("given", "first", "last", F.col("title"), None, F.col("suffix")),
        "CASE WHEN coalesce(given, '') = '' AND (coalesce(first, '') <> '' OR coalesce(last, '') <> '') "
        "THEN concat_ws(' ', nullif(title, ''), nullif(first, ''), nullif(last, ''), nullif(suffix, '')) ELSE given END")
PLACES = ("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE '' END AS city, CASE WHEN c_custkey % 4 > 0 THEN n_name END AS state, "
          "CASE WHEN c_custkey % 5 > 0 THEN CAST(10000 + c_custkey AS STRING) END AS zip FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey")
project("city_state_zip", PLACES, lambda: S.city_state_zip("city", "state", "zip"), "nullif(concat_ws(', ', nullif(city, ''), state, zip), '')")
project("date_range_display", f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN {DAY} END AS s, CASE WHEN o_orderkey % 4 > 0 THEN {DAY} ELSE '' END AS e FROM {{orders}}",
        lambda: S.date_range_display("s", "e"), "nullif(concat_ws(' – ', s, nullif(e, '')), '')")

@query("""WITH e AS (SELECT event_id AS id, user_id, event_type, props FROM {events})
SELECT id, 'a__k' AS key, json_extract_string(props, '$.k') AS value FROM e UNION ALL SELECT id, 'l_1', CAST(user_id AS VARCHAR) FROM e
UNION ALL SELECT id, 'l_2__m', event_type FROM e UNION ALL SELECT id, 'l_4', '[1]' FROM e UNION ALL SELECT id, 't', 'True' FROM e""")
def flatten_nested(spark, sf):
    e = table(spark, sf, "events")
    doc = F.concat(F.lit('{"a":'), "props", F.lit(',"l":['), F.col("user_id").cast("string"), F.lit(',{"m":"'), "event_type", F.lit('","z":null},null,[1]],"t":true}'))
    return R.flatten_nested(e.select(F.col("event_id").alias("id"), F.parse_json(doc).alias("raw")), ["id"])


@query("""WITH e AS (SELECT event_id AS id, user_id, event_type, event_id % 10 AS k FROM {events})
SELECT id, key, value, CAST(NULL AS VARCHAR) AS error FROM e, LATERAL (VALUES ('u__id', CAST(user_id AS VARCHAR)), ('u__more_1__deep__er__still__on', event_type), ('u__more_2', 'é')) v(key, value) WHERE k > 1
UNION ALL SELECT id, NULL, NULL, 'Invalid JSON' FROM e WHERE k = 0""")
def flatten_json(spark, sf):
    """A tenth of the texts cannot be parsed, another tenth is null."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", (F.col("event_id") % 10).alias("k"))
    good = F.concat(F.lit('{"u":{"id":'), F.col("user_id").cast("string"), F.lit(',"more":[{"deep":{"er":{"still":{"on":"'), "event_type", F.lit('"}}}},"é",[]],"none":null}}'))
    text = F.when(F.col("k") == 0, F.concat(F.lit("{"), "event_type")).when(F.col("k") > 1, F.regexp_replace(good, r",\[\]", ""))
    return R.flatten_json(e.select("id", text.alias("raw")), ["id"])



FLAT = ("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_name ELSE '' END AS first_name, CASE WHEN c_custkey % 4 > 1 THEN c_mktsegment || ' é/' || n_name END AS last_name, "
        "CASE WHEN c_custkey % 5 = 4 THEN n_name END AS full_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey")


@query(f"""SELECT id, regexp_replace(coalesce(nullif(concat_ws('_', nullif(replace(first_name, ' ', '_'), ''), replace(last_name, ' ', '_'), replace(full_name, ' ', '_')), ''),
'record_' || CAST(id AS VARCHAR)), '[^\\pL\\pN_-]', '', 'g') || '.pdf' AS file FROM ({FLAT})""")
def output_name(spark, sf):
    d = bind(spark, sf, FLAT)
    flat = F.map_from_arrays(F.array(*[F.lit(k) for k in ("first_name", "last_name", "full_name")]), F.array("first_name", "last_name", "full_name"))
    return d.select("id", S.output_name(flat, "id").alias("file"))


project("cell_to_text", "SELECT p_partkey AS id, CASE WHEN p_partkey % 6 > 0 THEN p_retailprice END AS x FROM {part}", lambda: S.cell_to_text("x", "double"),
        "CASE WHEN x IS NULL THEN '' WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END")
SENSITIVE_KEYS = ["ssn", "ITIN", "shipping_zip", "employer", "routing_number", "email", "birthdate", "zip", "PassportNo", "tax_year", "skein", "city"]
project("is_sensitive", f"SELECT o_orderkey AS id, {pick(SENSITIVE_KEYS, 'o_orderkey')} AS k FROM {{orders}}", lambda: S.is_sensitive("k"),
        f"regexp_matches(lower(k), '{'|'.join(fixed.SENSITIVE_PARTS)}')")

SECRET = "a password for tests"


def _supplier_profiles(spark, sf):
    s = table(spark, sf, "supplier")
    data = F.create_map(F.lit("name"), "s_name", F.lit("ssn"), F.lpad(F.col("s_suppkey").cast("string"), 9, "7"),
                        F.lit("account"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_acctbal").cast("string")))
    return s.select(F.col("s_suppkey").alias("id"), data.alias("data"))


def _protected(spark, sf):
    from recordflow.plans.profiles import protect_profiles
    salt = F.substring(F.unhex(F.sha2(F.col("id").cast("string"), 256)), 1, 16)
    return protect_profiles(_supplier_profiles(spark, sf), SECRET, salt, F.col("id").cast("string"))


SUPPLIER_DATA = ("(SELECT s_suppkey AS id, 'name' AS key, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 'ssn', lpad(CAST(s_suppkey AS VARCHAR), 9, '7') FROM supplier "
                 "UNION ALL SELECT s_suppkey, 'account', CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE CAST(s_acctbal AS VARCHAR) END FROM supplier)")


@query(f"""SELECT id, key || CASE WHEN key = 'name' THEN '' ELSE '_encrypted' END AS key,
CAST(CASE WHEN key = 'name' OR value = '' THEN length(value) ELSE 4 * ceil((44 + length(value)) / 3.0) END AS INTEGER) AS value_length FROM {SUPPLIER_DATA}""")
def protect_map(spark, sf):
    return _protected(spark, sf).select("id", F.explode("data")).select("id", "key", F.length("value").alias("value_length"))


@query(f"SELECT id, key, value FROM {SUPPLIER_DATA}")
def reveal_map(spark, sf):
    from recordflow.plans.profiles import reveal_profiles
    return reveal_profiles(_protected(spark, sf), SECRET).select("id", F.explode("data"))


@query("""SELECT c_custkey AS id, 'name' AS key, c_name AS value FROM {customer} UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM {customer}""")
def data_preview(spark, sf):
    c = table(spark, sf, "customer")
    data = F.create_map(F.lit("name"), "c_name", F.lit("ssn_encrypted"), F.base64(F.col("c_name").cast("binary")), F.lit("segment"), "c_mktsegment")
    return c.select(F.col("c_custkey").alias("id"), F.explode(S.data_preview(data)))


@query("""SELECT o_orderkey AS id, substr(sha256('FieldA' || chr(31) || o_orderpriority || chr(30) || 'FieldB' || chr(31) || o_orderstatus || chr(0)
|| 'custkey' || chr(31) || CAST(o_custkey AS VARCHAR) || chr(30) || 'status' || chr(31) || o_orderstatus), 1, 32) AS fingerprint FROM {orders}""")
def fingerprint(spark, sf):
    o = table(spark, sf, "orders")
    labels = F.create_map(F.lit("FieldB"), "o_orderstatus", F.lit("FieldA"), "o_orderpriority")
    data = F.create_map(F.lit("status"), "o_orderstatus", F.lit("custkey"), F.col("o_custkey").cast("string"))
    return o.select(F.col("o_orderkey").alias("id"), S.fingerprint(labels, data).alias("fingerprint"))


project("progress_pct", "SELECT l_orderkey AS id, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS done, CAST(l_quantity AS BIGINT) + l_linenumber - 3 AS total FROM {lineitem}",
        lambda: S.progress_pct("done", "total"), "CASE WHEN total = 0 THEN 0.0 ELSE round(done / CAST(total AS DOUBLE) * 100, 1) END", keep=("id", "n", "done"))
project("band", "SELECT p_partkey AS id, p_size AS v, 10 + p_partkey % 5 AS lo, CASE WHEN p_partkey % 6 = 0 THEN 10 + p_partkey % 5 ELSE 45 END AS hi FROM {part}",
        lambda: G.band("v", "lo", "hi"), "CASE WHEN (v - lo) / CAST(CASE WHEN hi = lo THEN 1 ELSE hi - lo END AS DOUBLE) < 0.33 THEN 'low' "
        "WHEN (v - lo) / CAST(CASE WHEN hi = lo THEN 1 ELSE hi - lo END AS DOUBLE) < 0.67 THEN 'mid' ELSE 'high' END")
TYPES = ["/Tx", "/Btn", "/Sig", "/Ch"]
project("field_kind", f"SELECT p_partkey AS id, {pick(TYPES, 'p_partkey')} AS t FROM {{part}}", lambda: S.field_kind("t"),
        "CASE t WHEN '/Tx' THEN 'text' WHEN '/Btn' THEN 'checkbox' ELSE 'other' END")
project("leaf_name", "SELECT page_id AS id, url AS s FROM {pages}", lambda: S.leaf_name("s"), "list_extract(string_split(s, '.'), -1)")
project("checkbox_state", f"SELECT event_id AS id, {pick(WORDS, 'event_id')} AS s FROM {{events}}", lambda: S.checkbox_state("s"),
        f"CASE WHEN lower({strip_sql('s')}) IN ('yes', 'true', '1', 'on') THEN '/Yes' ELSE '/Off' END")

BOXES = ("SELECT p_partkey AS id, CAST(p_size * 12 AS DOUBLE) AS x0, CAST(p_partkey % 700 AS DOUBLE) AS y0, CAST(300 - p_size AS DOUBLE) AS x1, CAST(p_partkey % 701 + p_size / 3 AS INT) * 1.0 AS y1, "
         "612.0 AS w, CASE WHEN p_partkey % 50 = 0 THEN 0.0 ELSE 792.0 END AS h FROM {part}")
BOXES_D = BOXES.replace("CAST(p_partkey % 701 + p_size / 3 AS INT) * 1.0", "CAST(p_partkey % 701 + p_size AS DOUBLE)").replace("612.0 AS", "CAST(612 AS DOUBLE) AS").replace(
    "THEN 0.0 ELSE 792.0 END", "THEN CAST(0 AS DOUBLE) ELSE CAST(792 AS DOUBLE) END")


@query(f"""SELECT id, round(least(x0, x1) / w * 100, 2) AS x_pct, round(least(y0, y1) / h * 100, 2) AS y_pct,
greatest(5.0::DOUBLE, round(abs(x1 - x0) / w * 100, 2)) AS width_pct, greatest(3.0::DOUBLE, round(abs(y1 - y0) / h * 100, 2)) AS height_pct FROM ({BOXES_D})
WHERE h > 0 AND round(abs(x1 - x0) / w * 100, 2) >= 0.5 AND round(abs(y1 - y0) / h * 100, 2) >= 0.5""")
def box_to_pct(spark, sf):
    d = bind(spark, sf, BOXES_D)
    return d.select("id", G.box_to_pct("x0", "y0", "x1", "y1", "w", "h").alias("b")).where("b IS NOT NULL").select("id", "b.*")


ZONES = ("SELECT p_partkey AS id, CAST(p_size * 2 AS DOUBLE) AS x, CAST(p_partkey % 110 AS DOUBLE) AS y, CAST(p_partkey % 60 AS DOUBLE) AS w, CAST(p_size AS DOUBLE) AS h FROM {part}")
BOX_ERROR = ("CASE WHEN least(x, y, w, h) < 0 OR greatest(x, y, w, h) > 100 THEN 'percentage outside 0-100' "
             "WHEN x + w > 100.01 OR y + h > 100.01 THEN 'box overflows the page' END")


@query(f"""SELECT id, CASE WHEN error IS NULL THEN 612.0::DOUBLE * (x / 100) END AS x, CASE WHEN error IS NULL THEN 792.0::DOUBLE * (y / 100) END AS y,
CASE WHEN error IS NULL THEN 612.0::DOUBLE * (w / 100) END AS w, CASE WHEN error IS NULL THEN 792.0::DOUBLE * (h / 100) END AS h, error
FROM (SELECT *, {BOX_ERROR} AS error FROM ({ZONES}))""")
def pct_to_box(spark, sf):
    d = bind(spark, sf, ZONES)
    return d.select("id", G.pct_to_box(F.lit(612.0), F.lit(792.0), "x", "y", "w", "h").alias("b")).select("id", "b.*")


@query(f"SELECT id, round(x, 2) AS x_pct, round(greatest(0.0::DOUBLE, 100 - y - h), 2) AS y_pct, greatest(5.0::DOUBLE, w) AS width_pct, greatest(3.0::DOUBLE, h) AS height_pct FROM ({ZONES})")
def top_to_bottom_origin(spark, sf):
    return bind(spark, sf, ZONES).select("id", G.top_to_bottom_origin("x", "y", "w", "h").alias("b")).select("id", "b.*")


project("slug", "SELECT conv_id AS id, turn, CASE WHEN turn % 3 = 2 THEN '' ELSE text END AS s FROM {conversations}", lambda: S.slug("s", "date"),
        "substr(regexp_replace(CASE WHEN s = '' THEN 'date' ELSE lower(s) END, '[^a-z0-9]', '_', 'g'), 1, 40)", keep=("id", "turn"))
FENCE = "```"


def _responses(spark, sf):
    e = table(spark, sf, "events")
    doc = F.concat(F.lit('{"F1": {"value": "'), "event_type", F.lit('", "confidence": '), (F.col("user_id") % 10 / 10).cast("string"),
                   F.lit('}, "F2": '), F.col("user_id").cast("string"), F.lit(', "F3": "", "F4": {"value": "'), "event_type", F.lit('"}}'))
    text = (
        F.when(F.col("event_id") % 4 == 0, doc).when(F.col("event_id") % 4 == 1, F.concat(F.lit(f"{FENCE}json\n"), doc, F.lit(f"\n{FENCE}")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit(f" {FENCE}\n"), doc, F.lit(f"{FENCE} "))).otherwise(F.concat(F.lit("Sorry: "), doc)))
    return e.select(F.col("event_id").alias("id"), text.alias("response"), (F.col("user_id") % 3).cast("int").alias("page"))


@query("""WITH e AS (SELECT event_id AS id, event_type, user_id FROM {events} WHERE event_id % 4 < 3)
SELECT id, 'F1' AS field_name, event_type AS value, round((user_id % 10) / 10.0, 1)::DOUBLE AS confidence FROM e
UNION ALL SELECT id, 'F2', CAST(user_id AS VARCHAR), 1.0::DOUBLE FROM e UNION ALL SELECT id, 'F4', event_type, 1.0::DOUBLE FROM e""", "parse_mapping_response")
def mapping_response(spark, sf):
    return R.stage(_responses(spark, sf), m=parse_mapping_response("response")).select("id", F.explode("m").alias("m")).select("id", "m.*")


@query("""WITH e AS (SELECT event_id AS id, event_type, user_id FROM {events})
SELECT id, 'sign_' || event_type AS key, 'Sign ' || event_type AS label, CAST(user_id % 3 AS INTEGER) AS page_index, 10.0::DOUBLE AS x_pct,
greatest(0.0::DOUBLE, 100.0 - user_id % 100 - 8)::DOUBLE AS y_pct, 30.0::DOUBLE AS width_pct, 8.0::DOUBLE AS height_pct, 'ai' AS source, 0.8::DOUBLE AS confidence FROM e
UNION ALL SELECT id, 'date_' || CAST(user_id % 3 AS VARCHAR) || '_2', '', CAST(user_id % 3 AS INTEGER), 50.0::DOUBLE, 19.0::DOUBLE, 5.0::DOUBLE, 3.0::DOUBLE, 'ai', 0.8::DOUBLE FROM e""", "parse_zone_response")
def zone_response(spark, sf):
    e = table(spark, sf, "events")
    text = F.concat(F.lit('[{"label": "Sign '), "event_type", F.lit('", "x_pct": 10, "y_pct": '), (F.col("user_id") % 100).cast("string"),
                    F.lit('}, {"label": "bad", "x_pct": "left"}, {"label": "", "kind": "date", "width_pct": 2, "height_pct": 1}, 7]'))
    parsed = R.stage(e.select(F.col("event_id").alias("id"), text.alias("response"), (F.col("user_id") % 3).alias("page")), z=parse_zone_response("response", "page"))
    return parsed.select("id", F.explode("z").alias("z")).select("id", "z.*")


project("normalise_profile_type", f"SELECT p_partkey AS id, {END} || p_name || CASE WHEN p_size > 25 THEN ' ' || p_type ELSE '' END AS s FROM {{part}}",
        lambda: S.normalise_profile_type("s"), f"replace(lower({strip_sql('s')}), ' ', '_')")
project("safe_request_id", f"SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN ' req-' || CAST(1000 + c_custkey AS STRING) || '_x' || {END} WHEN 1 THEN c_name WHEN 2 THEN 'short' ELSE CAST(123456789 + c_custkey AS STRING) END AS s FROM {{customer}}",
        lambda: S.safe_request_id("s"), "CASE WHEN regexp_full_match({0}, '[A-Za-z0-9_-]+') AND length({0}) BETWEEN 8 AND 128 THEN {0} END".format(strip_sql("s")))
HOSTS = ["localhost", "10.1.2.3", "172.16.0.9", "172.32.0.9", "192.168.1.1", "[::1]", "[fd12::1]", "8.8.8.8", "box.local", "api.example.com", "10.example.com", "printer.LAN", "127.9.9.9"]
PRIVATE = ["localhost", "10.1.2.3", "172.16.0.9", "192.168.1.1", "[::1]", "[fd12::1]", "box.local", "printer.LAN", "127.9.9.9"]
URLS = f"SELECT page_id AS id, CASE WHEN page_id % 14 = 13 THEN url ELSE 'http://' || {pick(HOSTS, 'page_id % 14')} || ':8080/' || CAST(page_id AS STRING) END AS u FROM {{pages}}"
project("host_class", URLS, lambda: S.host_class("u"), f"CASE WHEN regexp_extract(u, '^https?://(\\[[^]]*\\]|[^/:?]*)', 1) IN ({quoted(PRIVATE)}) THEN 'private' ELSE 'external' END")


@query("""SELECT event_id AS id, event_id % 5 NOT IN (1, 2, 3) AS valid FROM {events}""")
def verify_event(spark, sf):
    e = table(spark, sf, "events")
    ts = F.unix_seconds(F.col("ts").cast("timestamp"))
    kind = F.col("event_id") % 5
    signed = e.select(F.col("event_id").alias("id"), kind.alias("kind"), ts.alias("ts"), "props", F.when(kind == 4, "own secret").alias("own"),
                      secrets.sign_event(ts, "props", SECRET, F.when(kind == 4, "own secret")).alias("signature"))
    now = F.col("ts") + F.when(F.col("kind") == 1, 601).otherwise(600)
    body = F.when(F.col("kind") == 2, F.concat("props", F.lit(" "))).otherwise(F.col("props"))
    given = F.when(F.col("kind") == 3, F.substring("signature", 4, 64)).otherwise(F.col("signature"))
    return signed.select("id", secrets.verify_event("ts", body, given, now, SECRET, "own").alias("valid"))


project("safe_name", "SELECT page_id AS id, CASE WHEN page_id % 9 = 0 THEN '?' ELSE url END AS s FROM {pages}", lambda: S.safe_name("s"),
        "coalesce(nullif(substr(regexp_replace(s, '[^\\pL\\pN_-]', '', 'g'), 1, 60), ''), 'merged')")
project("content_hash", "SELECT doc_id AS id, text AS s FROM {documents}", lambda: S.content_hash("s"), "sha256(s)")
project("is_question", f"SELECT o_orderkey AS id, {pick(['q1', 'q_x', 'question_a', 'quality', 'a__b', 'a__notes', 'x__y__z', 'name'], 'o_orderkey')} AS k FROM {{orders}}",
        lambda: S.is_question("k"), "regexp_matches(k, '^(question_|q_|q[0-9])') OR (contains(k, '__') AND NOT suffix(k, '__notes'))")
project("has_any_key", "SELECT event_id AS id, event_type AS a, props FROM {events}",
        lambda: S.has_any_key(F.array("a", F.lit("zip")), ["click", "view", *fixed.NESTED_KEYS]), "a IN ('click', 'view')")
