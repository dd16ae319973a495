"""Queries of the template catalogue: parts as templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from recordflow.operators import catalog as K, catalog_index as IX
from recordflow.registry.base import pick, query, table
from recordflow.session import work_folder

STATES = ["TX", "RI", "CA", "NY"]


def catalog(spark, sf):
    """Parts as manifests: name = drug, brand = payer, type = category."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    state = F.when(k % 5 > 0, F.element_at(F.array(*[F.lit(s) for s in STATES]), (k % 4 + 1).cast("int")))
    question = F.struct(F.lit("k").alias("key"), F.lit("t").alias("text"), F.lit("yesno").alias("type"), F.lit(True).alias("required"),
                        F.array().cast("array<string>").alias("options"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("notes"))
    zone = lambda key, x: F.struct(
        key.alias("key"), F.lit("Sign").alias("label"), F.lit(0).alias("page_index"), x.cast("double").alias("x_pct"), F.lit(5.0).alias("y_pct"),
        F.lit(40.0).alias("width_pct"), F.lit(12.0).alias("height_pct"), F.lit(True).alias("required"), F.lit(None).cast("string").alias("description"))
    return p.select(
        F.concat(F.lit("t"), k.cast("string")).alias("id"), F.concat("p_name", F.lit(" form")).alias("name"), F.col("p_type").alias("category"),
        F.when(k % 4 > 0, F.concat(F.lit("Spec"), (F.col("p_size") % 5).cast("string"))).alias("specialty"),
        F.when(k % 7 > 0, F.struct(F.initcap("p_name").alias("name"), F.split("p_name", " ")[1].alias("generic_name"))).alias("drug"),
        F.when(k % 6 > 0, F.struct(F.col("p_brand").alias("name"), F.when(k % 2 == 0, "medicaid").alias("plan_type"), state.alias("state"))).alias("payer"),
        F.array(F.split("p_name", " ")[0]).alias("indications"), F.array_repeat(question, (k % 3).cast("int")).alias("questions"),
        F.array(F.col("p_type"), F.concat(F.lit("Size"), F.col("p_size").cast("string"))).alias("tags"), F.col("p_size").alias("pages"),
        (k % 10 > 0).alias("is_public"),
        F.array(zone(F.lit("patient"), F.col("p_size")), zone(F.when(k % 8 == 0, "patient").otherwise("doctor"), F.col("p_size") + 1)).alias("signature_fields"))


SQL_CATALOG = f"""(SELECT 't' || CAST(p_partkey AS VARCHAR) AS id, p_partkey AS k, p_name || ' form' AS name, p_type AS category, CASE WHEN p_partkey % 4 > 0 THEN 'Spec' || CAST(p_size % 5 AS VARCHAR) END AS specialty,
CASE WHEN p_partkey % 7 > 0 THEN p_name END AS drug, CASE WHEN p_partkey % 6 > 0 THEN p_brand END AS payer, CASE WHEN p_partkey % 6 > 0 AND p_partkey % 2 = 0 THEN 'medicaid' END AS plan_type,
CASE WHEN p_partkey % 6 > 0 AND p_partkey % 5 > 0 THEN {pick(STATES, 'p_partkey')} END AS state, p_size, p_type, p_partkey % 10 > 0 AS is_public, p_name FROM {{part}})"""


@query(f"""SELECT id, name, category, upper(substr(drug, 1, 1)) || substr(split_part(drug, ' ', 1), 2) || ' ' || upper(substr(split_part(drug, ' ', 2), 1, 1)) || substr(split_part(drug, ' ', 2), 2) AS drug_name, payer AS payer_name, plan_type, state, specialty,
split_part(p_name, ' ', 1) AS indications, p_type || ',Size' || CAST(p_size AS VARCHAR) AS tags, p_size AS pages, k % 3 AS question_count, is_public FROM {SQL_CATALOG}""")
def template_row(spark, sf):
    d = K.template_row(catalog(spark, sf))
    return d.withColumn("indications", F.array_join("indications", ",")).withColumn("tags", F.array_join("tags", ","))


SEARCHES = [
    ("category", dict(category="economy"), "lower(category) = 'economy'"), ("drug", dict(drug="RING"), "contains(lower(drug), 'ring')"),
    ("payer", dict(payer="#1"), "contains(lower(payer), '#1')"), ("state", dict(state="tx"), "payer IS NOT NULL AND (state IS NULL OR state = 'TX')"),
    ("specialty", dict(specialty="SPEC3"), "specialty = 'Spec3'"), ("tag", dict(tag="size7"), "p_size = 7"), ("public", dict(is_public=False), "NOT is_public"),
    ("all", dict(category="Promo", payer="brand#2", state="RI", is_public=True), "lower(category) = 'promo' AND contains(lower(payer), 'brand#2') AND (state IS NULL OR state = 'RI') AND is_public"),
]


@query(" UNION ALL ".join(f"SELECT '{n}' AS search, id FROM {SQL_CATALOG} WHERE {w}" for n, _, w in SEARCHES))
def search_catalog(spark, sf):
    stored = K.with_search_columns(catalog(spark, sf))
    found = [K.search_catalog(stored if n == "tag" else stored.drop("tags_lc"), **args).select(F.lit(n).alias("search"), "id") for n, args, _ in SEARCHES]
    out = found[0]
    for d in found[1:]:
        out = out.unionByName(d)
    return out


@query(" UNION ALL ".join(f"SELECT '{n}' AS search, id FROM {SQL_CATALOG} WHERE {w}" for n, _, w in [*SEARCHES, ("short", {}, "contains(lower(drug), 'a ')"), ("both", {}, "contains(lower(drug), 'ed') AND contains(lower(payer), 'rand#3')")]))
def search_index(spark, sf):
    """The same searches, one by a term shorter than the index's parts and one by two names, from an index."""
    path = work_folder(spark, "catalog-index")
    IX.build_index(catalog(spark, sf), path)
    asked = [(n, args) for n, args, _ in SEARCHES] + [("short", dict(drug="A ")), ("both", dict(drug="ed", payer="RAND#3"))]
    found = [IX.search_ids(spark, path, **args).select(F.lit(n).alias("search"), "id") for n, args in asked]
    return reduce(DataFrame.unionByName, found)


@query(f"SELECT id, 'patient' AS key, 2 AS n FROM {SQL_CATALOG} WHERE k % 8 = 0")
def duplicate_keys(spark, sf):
    return K.duplicate_keys(catalog(spark, sf))


LINES = "(SELECT l_orderkey, l_linenumber, l_partkey, 't' || CAST(l_partkey * 2 AS VARCHAR) AS template_id FROM {lineitem})"


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("t"), (F.col("l_partkey") * 2).cast("string")).alias("template_id"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, category, CASE WHEN id IS NULL THEN 'Template ''' || template_id || ''' not found' END AS error FROM {LINES} l LEFT JOIN {SQL_CATALOG} c ON id = template_id")
def attach_template(spark, sf):
    good, lost = K.attach_template(_lines(spark, sf), catalog(spark, sf).select("id", "category"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    return good.select(*keys, "category", F.lit(None).cast("string").alias("error")).unionByName(lost.select(*keys, F.lit(None).cast("string").alias("category"), "error"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN id IS NOT NULL AND l_linenumber % 2 = 0 THEN p_size WHEN id IS NOT NULL AND k % 8 > 0 THEN p_size + 1 END::DOUBLE AS x_pct,
CASE WHEN id IS NULL OR (l_linenumber % 2 = 1 AND k % 8 = 0) THEN 'no signature field ' || CASE WHEN l_linenumber % 2 = 0 THEN 'patient' ELSE 'doctor' END END AS error FROM {LINES} LEFT JOIN {SQL_CATALOG} ON id = template_id""")
def zone_for(spark, sf):
    asked = _lines(spark, sf).withColumn("field_key", F.when(F.col("l_linenumber") % 2 == 0, "patient").otherwise("doctor"))
    return K.zone_for(asked, catalog(spark, sf)).select("l_orderkey", "l_linenumber", "l_partkey", "zone.x_pct", "error")




@query(f"""WITH i AS (SELECT unnest(range((SELECT count(*) + 1000 FROM {{part}}))) AS seq),
d AS (SELECT t, lower(t) AS g, row_number() OVER (ORDER BY t) - 1 AS at, count(*) OVER () AS n FROM (SELECT DISTINCT p_type AS t FROM {{part}})),
b AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS at, count(*) OVER () AS n FROM (SELECT DISTINCT p_brand AS t FROM {{part}})),
p AS (SELECT seq, 'pa_' || d0.g || '_' || substr(lower(b0.t), 1, 12) || '_' || lower({pick(STATES, 'seq')}) || '_stub' || CAST(seq AS VARCHAR) AS id,
d1.t AS drug_name, b1.t AS payer_name, CASE WHEN b1.at % 2 = 0 THEN 'medicaid' ELSE 'commercial' END AS plan_type, {pick(STATES, '(seq + 1)')} AS state
FROM i JOIN d d0 ON seq % d0.n = d0.at JOIN d d1 ON (seq + 1) % d1.n = d1.at JOIN b b0 ON seq % b0.n = b0.at JOIN b b1 ON (seq + 1) % b1.n = b1.at)
SELECT seq, id, drug_name || ' PA — ' || payer_name || ' (' || state || ') [catalog stub]' AS name, drug_name, payer_name, plan_type, state FROM p WHERE seq >= 500 OR seq % 7 <> 3
ORDER BY seq LIMIT 1000 - (SELECT count(*) FROM range(500) r(k) WHERE k % 7 = 3)""")
def missing_templates(spark, sf):
    """The catalogue has all parts and some stubs already; drugs and payers are the parts' types and brands."""
    def names(column):
        return [r[0] for r in table(spark, sf, "part").select(column).distinct().orderBy(column).collect()]

    drugs = [(t, t.lower()) for t in names("p_type")]
    payers = [(b, "commercial" if i % 2 else "medicaid") for i, b in enumerate(names("p_brand"))]
    have = catalog(spark, sf).select("id")
    stubs = K.missing_templates(have.limit(0), drugs, payers, STATES, 500).where("seq % 7 = 3").select("id")
    return K.missing_templates(have.unionByName(stubs), drugs, payers, STATES, table(spark, sf, "part").count() + 1000)


@query(f"""SELECT 'catalog' AS kind, id, CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END AS zones, NULL AS outcome FROM {SQL_CATALOG}
UNION ALL SELECT 'report', id, NULL, 'updated' FROM {SQL_CATALOG} WHERE k % 3 = 0 UNION ALL SELECT 'report', 'new' || id, NULL, 'skipped' FROM {SQL_CATALOG} WHERE k % 3 = 1""")
def patch_catalog(spark, sf):
    c = catalog(spark, sf)
    k = F.substring("id", 2, 20).cast("long")
    patch = c.where(k % 3 < 2).select(F.when(k % 3 == 0, F.col("id")).otherwise(F.concat(F.lit("new"), "id")).alias("id"), F.slice("signature_fields", 1, 1).alias("signature_fields"))
    patched, report = K.patch_catalog(c, patch)
    return patched.select(F.lit("catalog").alias("kind"), "id", F.size("signature_fields").alias("zones"), F.lit(None).cast("string").alias("outcome")).unionByName(
        report.select(F.lit("report").alias("kind"), "id", F.lit(None).cast("int").alias("zones"), "outcome"))


@query(f"""WITH c AS {SQL_CATALOG} SELECT 'catalog' AS kind, id, CASE WHEN k % 4 = 1 THEN 'second' ELSE name END AS name FROM c
UNION ALL SELECT 'catalog', 'new' || id, CASE WHEN k % 4 = 2 THEN 'second' ELSE 'first' END FROM c WHERE k % 4 IN (2, 3)
UNION ALL SELECT 'add', id, 'Template ''' || id || ''' already exists' FROM c WHERE k % 4 = 0 UNION ALL SELECT 'update', 'lost' || id, 'Template ''lost' || id || ''' not found' FROM c WHERE k % 4 = 0
UNION ALL SELECT 'add', 'new' || id, 'Template ''new' || id || ''' already exists' FROM c WHERE k % 4 = 3""")
def upsert_catalog(spark, sf):
    c = catalog(spark, sf).select("id", "name")
    k = F.substring("id", 2, 20).cast("long") % 4
    def change(seq, action, rid, name):
        return F.struct(F.lit(seq).alias("seq"), F.lit(action).alias("action"), rid.alias("id"), F.lit(name).alias("name"))
    new, lost = F.concat(F.lit("new"), "id"), F.concat(F.lit("lost"), "id")
    steps = (
        F.when(k == 0, F.array(change(1, "add", F.col("id"), "first"), change(2, "update", lost, "second")))
        .when(k == 1, F.array(change(1, "update", F.col("id"), "first"), change(2, "update", F.col("id"), "second")))
        .when(k == 2, F.array(change(1, "add", new, "first"), change(2, "update", new, "second")))
        .otherwise(F.array(change(1, "add", new, "first"), change(2, "add", new, "second"))))
    done, rejects = K.upsert_catalog(c, c.select(F.explode(steps).alias("s")).select("s.*"))
    return done.select(F.lit("catalog").alias("kind"), "id", "name").unionByName(rejects.select(F.col("action").alias("kind"), "id", F.col("error").alias("name")))


ROUTED = "CASE WHEN event_id % 4 = 0 THEN 'Gemini' WHEN event_id % 4 = 1 THEN ' ' END"


@query(f"""WITH e AS (SELECT event_id AS id, {ROUTED} AS hint, event_type, user_id % 2 = 0 AS up FROM {{events}}),
r AS (SELECT id, CASE WHEN trim(hint) <> '' THEN lower(hint) WHEN event_type IN ('click', 'view') AND up THEN 'local' ELSE 'gemini' END AS provider FROM e)
SELECT id, provider, provider <> 'local' AS blocked FROM r""")
def route(spark, sf):
    e = table(spark, sf, "events")
    d = e.select(F.col("event_id").alias("id"), F.expr(ROUTED).alias("provider_hint"), F.col("event_type").alias("category"), (F.col("user_id") % 2 == 0).alias("local_reachable"),
                 F.lit("http://localhost:11434/v1").alias("local_url"), F.lit("https://api.example.com/v1").alias("cloud_url"))
    return K.route(d, ["click", "view"], force_local=True, local_only=True).select("id", "provider", "blocked")
