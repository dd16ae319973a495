"""Queries of layout, signature zones, matching, mapping, fill and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordflow.functions import fixed
from recordflow.operators import cache as K, cache_store as ST, layout as L, matching as M, ordered as O, reports as A
from recordflow.plans import extract as X, fill as P
from recordflow.plans.bundle import to_bundle
from recordflow.registry.base import bind, duck, pick, query, table
from recordflow.registry.records import RAW, records
from recordflow.session import keep_partitions, materialize, spread, work_folder

# Words of documents laid out as 8 columns and 50 lines a page; a word that ends a
# sentence is followed by a field.
PLACE = """doc_id, CAST(pos / 400 AS INT) AS page, CAST(pos AS INT) AS word_no, text,
CAST(40 + (pos % 8) * 66 AS DOUBLE) AS x0, CAST(40 + (pos % 8) * 66 + length(text) * 5 AS DOUBLE) AS x1, CAST(30 + CAST((pos % 400) / 8 AS INT) * 14 + pos % 3 AS DOUBLE) AS top"""
PLACE = PLACE.replace("CAST(pos / 400 AS INT)", "CAST((pos - pos % 400) / 400 AS INT)").replace("CAST((pos % 400) / 8 AS INT)", "CAST((pos % 400 - pos % 8) / 8 AS INT)")
SPARK_WORDS = f"SELECT {PLACE} FROM (SELECT doc_id, pos, text FROM {{documents}} LATERAL VIEW posexplode(split(text, ' ')) w AS pos, text)".replace(
    "SELECT doc_id, pos, text FROM {documents} LATERAL", "SELECT doc_id, w.pos, w.text FROM {documents} d LATERAL").replace("split(text", "split(d.text")
DUCK_WORDS = f"SELECT {PLACE} FROM (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS text FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))"
FIELDS = """SELECT doc_id, 'field' || CAST(word_no % 97 AS STRING) AS name, CASE WHEN word_no % 3 = 0 THEN '/Btn' WHEN word_no % 3 = 1 THEN '/Tx' ELSE '/Sig' END AS type, page,
CAST(CASE WHEN word_no % 8 = 0 THEN 20 ELSE x1 + 4 END AS INT) AS x0, CAST(CASE WHEN word_no % 8 = 0 THEN 36 ELSE x1 + 44 END AS INT) AS x1,
CAST(CASE WHEN word_no % 8 = 0 THEN 28 ELSE x1 + 24 END AS INT) AS x, CAST(top - word_no % 5 AS INT) AS y FROM {w} WHERE right(text, 1) = '.'"""


DOCUMENTS_A_TASK = 2000


def words(spark, sf):
    """Words of documents, which are dealt over tasks by their number before they are laid out: a text moves once and whole, and as joins, windows and
    aggregates of the layout go by document, neither its words nor the fields made of them move again."""
    keep_partitions(spark)
    d = table(spark, sf, "documents")
    return spark.sql(SPARK_WORDS, documents=spread(d.select("doc_id", "text"), d.count(), DOCUMENTS_A_TASK, "doc_id"))


def fields(spark, sf):
    return spark.sql(FIELDS, w=words(spark, sf))


W = f"w AS ({DUCK_WORDS}), f AS ({FIELDS.replace('{w}', 'w')})"
NEAR = f"""near AS (SELECT f.*, w.text, w.x0 AS wx0, w.word_no FROM (SELECT DISTINCT * FROM f) f JOIN w ON f.doc_id = w.doc_id AND f.page = w.page AND abs(w.top - f.y) <= 12
AND CASE WHEN f.x0 < 80 THEN w.x0 >= f.x1 - 5 AND w.x0 - f.x1 <= 500 ELSE w.x1 <= f.x0 + 5 AND f.x0 - w.x0 <= 220 END)"""
LABELS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name, type, page, x0, x1, y ORDER BY CASE WHEN x0 < 80 THEN wx0 ELSE -wx0 END, CASE WHEN x0 < 80 THEN word_no ELSE -word_no END) AS rn FROM near),
lab AS (SELECT doc_id, name, type, page, x0, x1, y, trim(string_agg(text, ' ' ORDER BY wx0, word_no)) AS label FROM ranked WHERE rn <= CASE WHEN x0 < 80 THEN 6 ELSE 4 END GROUP BY ALL),
fl AS (SELECT f.*, coalesce(lab.label, f.name) AS label FROM f LEFT JOIN lab USING (doc_id, name, type, page, x0, x1, y)),
infer AS (SELECT doc_id, name, arg_max(label, page * 1000000 + y * 1000 + x) AS label FROM fl GROUP BY doc_id, name)"""
FORMS = f"{W}, {NEAR}, {LABELS}"


@query(f"WITH {FORMS} SELECT doc_id, page, y, x0, x1, count(*) AS words FROM near GROUP BY doc_id, page, y, x0, x1")
def label_proximity(spark, sf):
    """Words in reach of every field place."""
    f, w = fields(spark, sf), words(spark, sf)
    n = L.proximity(L.label_probes(f), w).groupBy("doc_id", "page", "y", "is_box", "edge").agg(F.count(F.lit(1)).alias("words"))
    is_box = F.col("x0") < fixed.CHECKBOX_X
    placed = f.select("doc_id", "page", "y", "x0", "x1", is_box.alias("is_box"), F.when(is_box, F.col("x1")).otherwise(F.col("x0")).alias("edge")).distinct()
    same = f.groupBy("doc_id", "page", "y", "x0", "x1").agg(F.countDistinct("name", "type").alias("_same"))
    return placed.join(n, ["doc_id", "page", "y", "is_box", "edge"]).join(same, ["doc_id", "page", "y", "x0", "x1"]).select(
        "doc_id", "page", "y", "x0", "x1", (F.col("words") * F.col("_same")).alias("words"))


@query(f"WITH {FORMS} SELECT doc_id, name, label FROM infer")
def infer_labels(spark, sf):
    return L.infer_labels(fields(spark, sf), words(spark, sf))


@query(f"WITH {FORMS} SELECT doc_id, f.name, CASE type WHEN '/Tx' THEN 'text' WHEN '/Btn' THEN 'checkbox' ELSE 'other' END AS field_type, page, label, x0, x1, y FROM f JOIN infer USING (doc_id, name)")
def inspect_form(spark, sf):
    return L.inspect_form(fields(spark, sf), words(spark, sf))


EXTENTS = "ext AS (SELECT doc_id, page, min(x0) AS x_min, coalesce(nullif(max(x0), 0), 1) AS x_max, min(y) AS y_min, coalesce(nullif(max(y), 0), 1) AS y_max FROM f GROUP BY doc_id, page)"


@query(f"WITH {W}, {EXTENTS} SELECT * FROM ext")
def page_extents(spark, sf):
    return L.page_extents(fields(spark, sf))


def _band(v: str, lo: str, hi: str) -> str:
    share = f"(({v} - {lo}) / CASE WHEN {hi} = {lo} THEN 1.0::DOUBLE ELSE ({hi} - {lo})::DOUBLE END)"
    return f"CASE WHEN {share} < 0.33 THEN 'low' WHEN {share} < 0.67 THEN 'mid' ELSE 'high' END"


@query(f"""WITH {FORMS}, {EXTENTS} SELECT doc_id, f.name AS field_name, CASE WHEN type = '/Tx' THEN 'textbox' ELSE 'checkbox' END AS type, label, page,
'x:' || {_band('x0', 'x_min', 'x_max')} || ' y:' || {_band('y', 'y_min', 'y_max')} AS position FROM f JOIN infer USING (doc_id, name) JOIN ext USING (doc_id, page)""")
def labeled_fields(spark, sf):
    f = fields(spark, sf)
    return L.labeled_fields(f, L.infer_labels(f, words(spark, sf)), coords=True)


@query(f"WITH {W} SELECT doc_id, page, y, x, name, row_number() OVER (PARTITION BY doc_id ORDER BY page, y, x, name) AS place FROM f")
def reading_order(spark, sf):
    return O.number_fields(fields(spark, sf)).select("doc_id", "page", "y", "x", "name", "place")


@query("""SELECT page_id AS doc_id, 'f' || CAST(page_id AS VARCHAR) AS name, CASE WHEN page_id % 3 = 0 THEN '/Tx' ELSE '/Btn' END AS type, 0 AS page,
CASE WHEN page_id % 5 = 0 THEN 0 ELSE CAST(page_id % 300 AS INTEGER) END AS x0, CASE WHEN page_id % 5 = 0 THEN 0 ELSE CAST(page_id % 300 + 40 AS INTEGER) END AS x1,
CASE WHEN page_id % 5 = 0 THEN 0 ELSE CAST(page_id % 300 + 20 AS INTEGER) END AS x, CASE WHEN page_id % 5 = 0 THEN 0 ELSE CAST(792 - length(url) - 12 AS INTEGER) END AS y FROM {pages} WHERE page_id % 7 > 0""")
def fields_from_annotations(spark, sf):
    p = table(spark, sf, "pages")
    x = (F.col("page_id") % 300).cast("double")
    y = F.length("url").cast("double")
    return L.fields_from_annotations(p.select(
        F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 7 > 0, F.concat(F.lit("f"), F.col("page_id").cast("string"))).alias("name"),
        F.when(F.col("page_id") % 3 > 0, "/Btn").alias("ft"), F.lit(0).alias("page"), F.lit(792.0).alias("page_height"),
        F.when(F.col("page_id") % 5 > 0, F.array(x, y + 12, x + 40, y)).alias("rect")))


# Parts as widgets: brand = document.
SIGN_NAMES = ["Signature", "sign_here", "Date Signed", "date", "Name", "birth date", "autograph", "design", "sign date", "phone"]
WIDGETS = f"""SELECT p_brand AS doc_id, CAST(p_size % 4 AS INT) AS page, p_partkey AS seq, {pick(SIGN_NAMES, 'p_partkey')} AS name,
CASE WHEN p_partkey % 9 = 0 THEN 'Dated on' WHEN p_partkey % 4 = 0 THEN '' END AS tooltip, CASE WHEN p_partkey % 13 = 0 THEN '/Sig' ELSE '/Tx' END AS type,
CAST(p_size * 4 AS DOUBLE) AS rx0, CAST(p_partkey % 600 AS DOUBLE) AS ry0, CAST(p_size * 4 + p_partkey % 90 AS DOUBLE) AS rx1, CAST(p_partkey % 600 + 30 AS DOUBLE) AS ry1,
CAST(612 AS DOUBLE) AS page_w, CAST(792 AS DOUBLE) AS page_h FROM {{part}}"""
SAYS = "regexp_matches(concat_ws(chr(10), name, tooltip), '(?i){}')"
FOUND = (f"(SELECT *, CASE WHEN {SAYS.format(fixed.DATE_WORDS)} AND type <> '/Sig' AND NOT {SAYS.format(fixed.SIGN_WORDS)} THEN 'date' ELSE 'signature' END AS kind, "
         f"coalesce(nullif(tooltip, ''), name) AS label FROM ({WIDGETS}) WHERE type = '/Sig' OR {SAYS.format(fixed.SIGN_WORDS)} OR {SAYS.format(fixed.DATE_WORDS)})")


@query(f"SELECT doc_id, seq, kind, label FROM {FOUND}")
def detect_signature_fields(spark, sf):
    return L.detect_signature_fields(bind(spark, sf, WIDGETS)).select("doc_id", "seq", "kind", "label")


KEYED = f"""(SELECT *, base || CASE WHEN n = 1 THEN '' ELSE '_' || CAST(n - 1 AS VARCHAR) END AS key FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY page, seq) AS n FROM
(SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '_', 'g') AS base, round((rx1 - rx0) / page_w * 100, 2) AS w FROM {FOUND}) WHERE w >= 0.5))"""


@query(f"""SELECT doc_id, key, label, page AS page_index, round(rx0 / page_w * 100, 2) AS x_pct, round(ry0 / page_h * 100, 2) AS y_pct, greatest(5.0::DOUBLE, w) AS width_pct,
round(30 / page_h * 100, 2) AS height_pct, 'acroform' AS source, 1.0::DOUBLE AS confidence FROM {KEYED}
UNION ALL SELECT 'plain' || CAST(page_id AS VARCHAR), 'sign_here', 'Sign here', 1, 50.0, 12.0, 30.0, 8.0, 'ai', 0.8 FROM {{pages}}""")
def detect_zones(spark, sf):
    found = bind(spark, sf, WIDGETS)
    answers = found.select("doc_id").distinct().unionByName(table(spark, sf, "pages").select(F.concat(F.lit("plain"), F.col("page_id").cast("string")).alias("doc_id")))
    return L.detect_zones(found, answers.select("doc_id", F.lit(1).alias("page"), F.lit('[{"label": "Sign here"}]').alias("response")))


@query(f"SELECT doc_id, seq, base || CASE WHEN n = 1 THEN '' ELSE '_' || CAST(n - 1 AS VARCHAR) END AS unique_key FROM {KEYED}")
def dedupe_keys(spark, sf):
    d = L.detect_signature_fields(bind(spark, sf, WIDGETS)).where(F.round((F.col("rx1") - F.col("rx0")) / F.col("page_w") * 100, 2) >= 0.5)
    return L.dedupe_keys(d.withColumn("base", F.regexp_replace(F.lower("name"), "[^a-z0-9]", "_")), "doc_id", "base", ["page", "seq"]).select("doc_id", "seq", "unique_key")


@query("SELECT p_brand AS doc_id, CASE WHEN bool_and(p_size > 2) THEN 'acroform' WHEN bool_or(p_size > 2) THEN 'mixed' ELSE 'ai' END AS source FROM {part} GROUP BY p_brand UNION ALL SELECT 'none', 'none'")
def detection_source(spark, sf):
    p = table(spark, sf, "part")
    zones = p.select(F.col("p_brand").alias("doc_id"), F.when(F.col("p_size") > 2, "acroform").otherwise("ai").alias("source"))
    docs = zones.select("doc_id").unionByName(spark.range(1).select(F.lit("none").alias("doc_id")))
    return A.detection_source(docs, zones)


# Matching: forms = part types, fields = part names; records = orders with part words as keys.
FORM_FIELDS = "SELECT DISTINCT p_type AS form_id, p_name AS field_name FROM {part}"
KEY_OF = "CASE WHEN o_orderkey % 5 = 0 THEN '-' || split_part(p_name, ' ', 1) WHEN o_orderkey % 5 = 1 THEN upper(p_name) WHEN o_orderkey % 5 = 2 THEN 'x' || p_name || '_y' WHEN o_orderkey % 5 = 3 THEN 'zz' ELSE split_part(p_name, ' ', 2) END"
ORDER_KEYS = f"SELECT o_orderkey AS record_id, p_type AS form_id, l_linenumber + 10 * row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS pos, {KEY_OF} AS key, CAST(l_partkey AS STRING) AS value FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey JOIN {{part}} ON p_partkey = l_partkey"


@query(f"""WITH f AS (SELECT form_id, field_name, regexp_replace(lower(field_name), '[-_\\s]', '', 'g') AS a FROM ({FORM_FIELDS})),
e AS (SELECT *, regexp_replace(lower(key), '[-_\\s]', '', 'g') AS b FROM ({ORDER_KEYS})),
s AS (SELECT record_id, e.form_id, field_name, pos, key, value, CASE WHEN a = b THEN 100 WHEN contains(a, b) OR contains(b, a) THEN 60 ELSE 0 END AS score FROM e JOIN f ON e.form_id = f.form_id)
SELECT record_id, form_id, field_name, key, value, score FROM s WHERE score >= 60 QUALIFY row_number() OVER (PARTITION BY record_id, form_id, field_name ORDER BY score DESC, pos) = 1""")
def match_fields(spark, sf):
    f = bind(spark, sf, FORM_FIELDS).withColumn("candidates", F.array("field_name", F.lit("")))
    return M.match_fields(f, bind(spark, sf, ORDER_KEYS))


# Mappings: one row per (order, line).
MAPPINGS = """SELECT l_orderkey AS batch_id, l_linenumber AS idx, 'f' || CAST(l_suppkey % 10 AS STRING) AS field_name, CAST(min(l_partkey) AS STRING) AS value,
CASE WHEN min(l_partkey) % 13 > 0 THEN round(1 - 5 * max(l_discount), 2) END AS confidence FROM {lineitem} GROUP BY l_orderkey, l_linenumber, l_suppkey % 10"""


@query(f"SELECT batch_id, idx, field_name, value, confidence FROM ({MAPPINGS}) WHERE coalesce(confidence, 1) >= 0.75")
def apply_threshold(spark, sf):
    return A.apply_threshold(bind(spark, sf, MAPPINGS), 0.75)


AVG = "round(CAST(sum(CAST({c} AS DECIMAL(20,10))) AS DOUBLE) / count({c}), 3)"
STATS = f"SELECT batch_id, idx, count(*) FILTER (coalesce(confidence, 1) >= 0.75) AS fields_filled, {AVG.format(c='confidence')} AS avg_confidence, count(*) FILTER (confidence < 0.75) AS fields_skipped FROM ({MAPPINGS}) GROUP BY batch_id, idx"


@query(STATS)
def record_stats(spark, sf):
    return A.record_stats(bind(spark, sf, MAPPINGS), 0.75)


@query(f"SELECT batch_id, {AVG.format(c='avg_confidence')} AS avg_confidence, count(*) FILTER (idx % 2 = 0) AS cache_hits FROM ({STATS}) GROUP BY batch_id")
def batch_confidence(spark, sf):
    return A.batch_confidence(A.record_stats(bind(spark, sf, MAPPINGS), 0.75).withColumn("cache_hit", F.col("idx") % 2 == 0))


@query(f"SELECT batch_id, idx, string_agg(field_name || '=' || value, ',' ORDER BY field_name) AS mappings FROM ({MAPPINGS}) GROUP BY batch_id, idx")
def rows_to_map(spark, sf):
    d = A.rows_to_map(bind(spark, sf, MAPPINGS), "field_name", "value", ["batch_id", "idx"])
    return d.select("batch_id", "idx", F.array_join(F.transform(F.map_entries("mappings"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("mappings"))


# Cache: orders as requests by customer; the older half is cached.
OLD = "CAST(o_orderdate AS DATE) < DATE '1998-06-01'"


def _cache(spark, sf):
    o = table(spark, sf, "orders").where(OLD)
    entry = F.struct(F.col("o_orderstatus").alias("value"), F.lit(0.5).alias("confidence"), F.lit("ai").alias("source"))
    empty = F.struct(F.lit("").alias("value"), F.lit(0.5).alias("confidence"), F.lit("ai").alias("source"))
    rows = o.select(F.concat(F.lit("fp"), F.col("o_custkey").cast("string")).alias("fingerprint"),
                    F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400).alias("cached_at"),
                    F.when(F.col("o_custkey") % 10 == 0, 1).otherwise(2).alias("version"), F.col("o_orderkey").alias("n"),
                    F.create_map(F.lit("status"), entry, F.lit("none"), empty).alias("mappings"))
    return rows


CACHE_ROWS = f"(SELECT 'fp' || CAST(o_custkey AS VARCHAR) AS fingerprint, CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 AS tm, o_custkey % 10 AS c, o_orderkey AS n, o_orderstatus FROM {{orders}} WHERE {OLD})"
LATEST = f"(SELECT fingerprint, max(tm) AS tm, arg_max(o_orderstatus, tm) AS status, min(c) AS c FROM {CACHE_ROWS} GROUP BY fingerprint)"


def _latest(spark, sf):
    from recordflow.operators.ordered import last_wins
    return last_wins(_cache(spark, sf).drop("n"), ["fingerprint"], "cached_at")


def _requests(spark, sf):
    return table(spark, sf, "orders").where(f"NOT ({OLD})").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("fp"), F.col("o_custkey").cast("string")).alias("fingerprint"))


@query(f"SELECT fingerprint, tm AS cached_at, status FROM {LATEST}")
def merge_cache(spark, sf):
    c = _cache(spark, sf)
    half = F.col("n") % 2 == 0
    d = K.merge_cache(c.where(half).drop("n"), c.where(~half).drop("n"))
    return d.select("fingerprint", F.unix_seconds("cached_at").alias("cached_at"), F.col("mappings")["status"]["value"].alias("status"))


@query(f"""WITH r AS (SELECT o_orderkey AS id, 'fp' || CAST(o_custkey AS VARCHAR) AS fingerprint FROM {{orders}} WHERE NOT ({OLD}))
SELECT 'hit' AS kind, count(*) AS requests, count(DISTINCT fingerprint) AS fingerprints, count(*) AS filled FROM r WHERE fingerprint IN (SELECT fingerprint FROM {LATEST})
UNION ALL SELECT 'miss', count(DISTINCT fingerprint), count(DISTINCT fingerprint), 0 FROM r WHERE fingerprint NOT IN (SELECT fingerprint FROM {LATEST})""")
def with_cache(spark, sf):
    hits, misses = K.with_cache(_requests(spark, sf), _latest(spark, sf))
    n, f = F.count(F.lit(1)).alias("requests"), F.countDistinct("fingerprint").alias("fingerprints")
    return hits.agg(n, f, F.sum(F.size("mappings")).alias("filled")).select(F.lit("hit").alias("kind"), "*").unionByName(
        misses.agg(n, f, F.lit(0).cast("bigint").alias("filled")).select(F.lit("miss").alias("kind"), "*"))


@query(f"SELECT fingerprint FROM {LATEST} WHERE c > 0 AND tm >= epoch(TIMESTAMP '1998-06-01') - 400 * 86400")
def valid_cache(spark, sf):
    return K.valid_cache(_latest(spark, sf), F.lit("1998-06-01").cast("timestamp"), ttl_days=400).select("fingerprint")


@query(f"SELECT fingerprint, tm AS cached_at, 2 AS field_count FROM {LATEST}")
def list_cache(spark, sf):
    return K.list_cache(_latest(spark, sf)).withColumn("cached_at", F.unix_seconds("cached_at"))


@query(f"""WITH asked AS (SELECT DISTINCT 'fp' || CAST(o_custkey AS VARCHAR) AS fingerprint FROM {{orders}} WHERE NOT ({OLD}))
SELECT 'left' AS kind, fingerprint, NULL AS existed FROM {LATEST} WHERE fingerprint NOT IN (SELECT fingerprint FROM asked)
UNION ALL SELECT 'asked', fingerprint, fingerprint IN (SELECT fingerprint FROM {LATEST}) FROM asked""")
def invalidate_cache(spark, sf):
    left, asked = K.invalidate_cache(_latest(spark, sf), _requests(spark, sf))
    return left.select(F.lit("left").alias("kind"), "fingerprint", F.lit(None).cast("boolean").alias("existed")).unionByName(
        asked.select(F.lit("asked").alias("kind"), "fingerprint", "existed"))


# Fill: customers as records, one form per market segment with fixed fields.
FILL_FIELDS = [("MemberName", "Member name"), ("Zip", "zip code"), ("DOB", "Date of birth"), ("Drug", "Medication"), ("Odd", "nothing fits")]


def _labeled(spark, sf):
    forms = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("doc_id")).distinct().where("doc_id <> 'MACHINERY'")
    pairs = F.array(*[F.struct(F.lit(n).alias("field_name"), F.lit(v).alias("label")) for n, v in FILL_FIELDS])
    return forms.select("doc_id", F.explode(pairs).alias("f")).select("doc_id", "f.*")


def _fill(spark, sf):
    r = records(spark, sf).withColumn("doc_id", F.col("batch_id")).withColumnRenamed("id", "idx")
    return P.fill_batch(r, _labeled(spark, sf), t=0.5, shape="flat")


# Without a zip or drug the next best keys contain the word: city_state_zip, drug_obtained_via.
FILLED = f"""SELECT batch_id, id AS idx, f AS field_name, CASE f WHEN 'MemberName' THEN patient_name WHEN 'Zip' THEN coalesce(zip, nullif(concat_ws(', ', city, state), ''))
WHEN 'DOB' THEN substr(dob, 6, 2) || '/' || substr(dob, 9, 2) || '/' || substr(dob, 1, 4) WHEN 'Drug' THEN coalesce(drug, benefit) END AS value,
CASE WHEN (f = 'Zip' AND zip IS NULL) OR (f = 'Drug' AND drug IS NULL) THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS confidence
FROM ({RAW}) r, (VALUES ('MemberName'), ('Zip'), ('DOB'), ('Drug')) t(f) WHERE benefit IS DISTINCT FROM 'bogus' AND batch_id <> 'MACHINERY'"""
FILLED_AVG = AVG.format(c="confidence")


@query(f"SELECT * FROM ({FILLED}) WHERE value IS NOT NULL")
def fill_batch(spark, sf):
    return _fill(spark, sf)["filled"].select("batch_id", "idx", "field_name", "value", "confidence")


def _as_records(spark, sf):
    return records(spark, sf).withColumn("doc_id", F.col("batch_id")).withColumnRenamed("id", "idx")


def _with_hits(out):
    """Filled fields and whether their record came from the cache."""
    hits = out["results"].select("batch_id", "idx", "cache_hit")
    return out["filled"].join(hits, ["batch_id", "idx"]).select("batch_id", "idx", "field_name", "value", "confidence", "cache_hit")


@query(f"SELECT *, idx % 4 = 2 AS cache_hit FROM ({FILLED}) WHERE value IS NOT NULL")
def fill_batch_cached(spark, sf):
    """Half of the records are mapped before and stored; a quarter of all are too old in the cache by now and are mapped anew."""
    path, labeled = work_folder(spark, "cache"), _labeled(spark, sf)
    bundles = P.request_bundles(_as_records(spark, sf), labeled, shape="flat")
    for rest, day in ((0, "2024-01-01"), (2, "2024-03-01")):
        fresh = P.fill_bundles(bundles.where(F.col("idx") % 4 == rest), labeled, t=0.5)["fresh"]
        ST.upsert_cache(P.fresh_entries(fresh, F.lit(day)), path)
    return _with_hits(P.fill_bundles(bundles, labeled, t=0.5, cache=ST.read_cache(spark, path), now=F.lit("2024-03-05").cast("timestamp"), ttl_days=30))


def _names_only(frames):
    """A mapper that fills two fields, one of them with little confidence."""
    for f in frames:
        for field, confidence in (("MemberName", 0.75), ("Odd", 0.25)):
            yield f[["fingerprint"]].assign(field_name=field, value=[dict(x).get("patient_name") for x in f["flat"]], confidence=confidence)


@query(f"SELECT batch_id, idx, field_name, value, 0.75::DOUBLE AS confidence, false AS cache_hit FROM ({FILLED}) WHERE field_name = 'MemberName' AND value IS NOT NULL")
def fill_batch_mapper(spark, sf):
    """Mapped by a function of the caller instead of by text."""
    return _with_hits(P.fill_batch(_as_records(spark, sf), _labeled(spark, sf), t=0.5, shape="flat", mapper=_names_only))


@query(f"SELECT batch_id, idx, 'MemberName' AS field_name, 'by ' || batch_id AS value, 0.5::DOUBLE AS confidence, false AS cache_hit FROM ({FILLED}) WHERE field_name = 'MemberName'")
def fill_batch_answers(spark, sf):
    """Mapped by a table of a model's answers, one text per request."""
    labeled = _labeled(spark, sf)
    bundles = P.request_bundles(_as_records(spark, sf), labeled, shape="flat")
    asked = bundles.where("fingerprint IS NOT NULL").select("fingerprint", "doc_id").distinct()
    answer = F.concat(F.lit('{"MemberName": {"value": "by '), "doc_id", F.lit('", "confidence": 0.5}, "Zip": {"value": "1", "confidence": 0.1}}'))
    return _with_hits(P.fill_bundles(bundles, labeled, t=0.5, mapper=asked.select("fingerprint", answer.alias("response"))))


@query(f"""SELECT batch_id, count(*) AS total_records, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, round(count(*) FILTER (ok) / CAST(count(*) AS DOUBLE) * 100, 1) AS success_rate,
any_value(c) AS avg_confidence, 0 AS cache_hits FROM (SELECT batch_id, batch_id <> 'MACHINERY' AND benefit IS DISTINCT FROM 'bogus' AS ok FROM ({RAW}))
LEFT JOIN (SELECT batch_id, {AVG.format(c="c")} AS c FROM (SELECT batch_id, idx, {FILLED_AVG} AS c FROM ({FILLED}) WHERE value IS NOT NULL GROUP BY batch_id, idx) GROUP BY batch_id) USING (batch_id) GROUP BY batch_id""")
def fill_summary(spark, sf):
    return _fill(spark, sf)["summary"]


@query(f"""WITH {FORMS}, v AS (SELECT doc_id, 'form.' || 'field' || CAST(word_no % 101 AS VARCHAR) AS full_name, arg_max(text, word_no) AS value FROM w GROUP BY ALL)
SELECT doc_id, coalesce(v.full_name, d.name) AS name, d.label, coalesce(v.value, '') AS value, d.page + 1 AS page, d.kind AS field_type, CASE WHEN d.name IS NULL THEN 1 ELSE 0 END AS source
FROM (SELECT doc_id, name, any_value(label) AS label, arg_max(page, page * 1000000 + y * 1000 + x) AS page,
arg_max(CASE type WHEN '/Tx' THEN 'text' WHEN '/Btn' THEN 'checkbox' ELSE 'other' END, page * 1000000 + y * 1000 + x) AS kind FROM (SELECT f.*, infer.label FROM f JOIN infer USING (doc_id, name)) GROUP BY doc_id, name) d
FULL OUTER JOIN v ON v.doc_id = d.doc_id AND v.full_name = 'form.' || d.name""".replace("SELECT doc_id, coalesce(v.full_name", "SELECT coalesce(v.doc_id, d.doc_id) AS doc_id, coalesce(v.full_name"))
def extract(spark, sf):
    w = words(spark, sf)
    full = F.concat(F.lit("form.field"), (F.col("word_no") % 101).cast("string"))
    values = w.groupBy("doc_id", full.alias("full_name")).agg(F.max("word_no").alias("pos"), F.max_by("text", "word_no").alias("value"))
    return X.extract(values, fields(spark, sf), w).select("doc_id", "name", "label", "value", "page", "field_type", "source")


@query("""SELECT doc_id, count(*) AS fields_detected, count(*) FILTER (quality = 1) AS non_empty_fields, CASE WHEN count(*) FILTER (quality = 1) = 0 THEN 'all_empty' END AS hint FROM {labels} GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, 'no_fields' FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM {labels})""")
def extract_summary(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "yes").otherwise(" ").alias("value"))
    return A.extract_summary(rows, table(spark, sf, "documents"))
