"""Template catalogue: search, lookup, upsert, routing.

Catalogue rows follow ``MANIFEST``. ``_lc`` columns of ``with_search_columns``
hold lower-cased copies, so that filters on them reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordflow.functions.scalars import host_class, strip

SIGNATURE_FIELD = ("struct<key:string,label:string,page_index:int,x_pct:double,y_pct:double,"
                   "width_pct:double,height_pct:double,required:boolean,description:string>")
MANIFEST = (
    "id string, name string, category string, specialty string, "
    "drug struct<name:string,generic_name:string,strengths:array<string>,form:string,j_code:string,ndc:string>, "
    "payer struct<name:string,plan_type:string,state:string,fax:string,phone:string>, "
    "indications array<string>, "
    "questions array<struct<key:string,text:string,type:string,required:boolean,options:array<string>,section:string,notes:string>>, "
    "tags array<string>, version string, pages int, is_public boolean, created_at string, updated_at string, "
    f"signature_fields array<{SIGNATURE_FIELD}>, custom map<string,string>"
)


def with_search_columns(catalog: DataFrame) -> DataFrame:
    """Lower-cased copies to store beside the catalogue."""
    return (
        catalog.withColumn("category_lc", F.lower("category"))
        .withColumn("specialty_lc", F.lower("specialty"))
        .withColumn("tags_lc", F.transform("tags", F.lower))
    )


def template_row(catalog: DataFrame) -> DataFrame:
    """List view of manifests."""
    return catalog.select(
        "id", "name", "category", F.col("drug.name").alias("drug_name"), F.col("payer.name").alias("payer_name"),
        F.col("payer.plan_type").alias("plan_type"), F.col("payer.state").alias("state"), "specialty",
        "indications", "tags", "pages", F.coalesce(F.size("questions"), F.lit(0)).alias("question_count"), "is_public")


def search_catalog(catalog: DataFrame, category: str | None = None, drug: str | None = None, payer: str | None = None,
                   state: str | None = None, specialty: str | None = None, tag: str | None = None,
                   is_public: bool | None = None) -> DataFrame:
    """Templates that fit every given condition.

    A national payer (no state) fits every state; a template without payer none.
    """
    stored = set(catalog.columns)

    def low(name: str) -> Column:
        return F.col(f"{name}_lc") if f"{name}_lc" in stored else F.lower(name)

    found = catalog
    if category:
        found = found.where(low("category") == category.lower())
    if is_public is not None:
        found = found.where(F.col("is_public") == is_public)
    if specialty:
        found = found.where(low("specialty") == specialty.lower())
    if tag:
        tags = F.col("tags_lc") if "tags_lc" in stored else F.transform("tags", F.lower)
        found = found.where(F.array_contains(tags, tag.lower()))
    if drug:
        found = found.where(F.lower("drug.name").contains(drug.lower()) | F.lower("drug.generic_name").contains(drug.lower()))
    if payer:
        found = found.where(F.lower("payer.name").contains(payer.lower()))
    if state:
        found = found.where(F.col("payer").isNotNull() & (F.col("payer.state").isNull() | (F.upper("payer.state") == state.upper())))
    return found


def duplicate_keys(catalog: DataFrame) -> DataFrame:
    """Signature field keys that a template lists more than once."""
    return (
        catalog.select("id", F.explode("signature_fields").alias("f"))
        .groupBy("id", F.col("f.key").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )


def attach_template(records: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with their template, and error rows for unknown templates."""
    good = records.join(catalog, records["template_id"] == catalog["id"]).drop(catalog["id"])
    lost = records.join(catalog.select("id"), records["template_id"] == catalog["id"], "left_anti").withColumn(
        "error", F.concat(F.lit("Template '"), F.col("template_id"), F.lit("' not found")))
    return good, lost


def zone_for(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Signature zone of (template_id, field_key), or an error text."""
    zones = catalog.select(F.col("id").alias("template_id"), F.posexplode("signature_fields").alias("_at", "zone")).withColumn(
        "field_key", F.col("zone.key"))
    # A template may list a key twice; the first one counts.
    first = zones.groupBy("template_id", "field_key").agg(F.min_by("zone", "_at").alias("zone"))
    return requests.join(first, ["template_id", "field_key"], "left").withColumn(
        "error", F.when(F.col("zone").isNull(), F.concat(F.lit("no signature field "), "field_key")))


# Proposed ids that are counted together.
RANGE = 65_536


def missing_templates(existing: DataFrame, drugs: list[tuple[str, str]], payers: list[tuple[str, str]],
                      states: list[str], target: int) -> DataFrame:
    """New stub templates, cycling through the lists, until the catalogue has ``target`` ids.

    ``target`` proposals are enough, as each existing id takes one place and can be skipped once at most. How many
    are free is counted per ``RANGE`` of them; sums over the ranges before say which are wholly needed, and only the
    range in which the target is reached is cut by place. Nothing is counted when this is planned.
    """
    have = existing.select("id").distinct()
    need = F.greatest(F.lit(0), F.lit(target) - have.agg(F.count(F.lit(1))).scalar())
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), (i % len(values)).cast("int"))
    i = F.col("id")
    generic = F.replace(pick([g for _, g in drugs], i), F.lit(" "), F.lit("_"))
    payer = F.substring(F.replace(F.lower(pick([p for p, _ in payers], i)), F.lit(" "), F.lit("_")), 1, 12)
    # The stored stub describes the list item after the one that names it.
    j = i + 1
    drug_name, payer_name, state = pick([d for d, _ in drugs], j), pick([p for p, _ in payers], j), pick(states, j)
    plan = pick([t for _, t in payers], j)
    proposals = existing.sparkSession.range(target).select(
        i.alias("seq"), F.concat_ws("_", F.lit("pa"), generic, payer, F.lower(pick(states, i)), F.concat(F.lit("stub"), i.cast("string"))).alias("id"),
        F.concat(drug_name, F.lit(" PA — "), payer_name, F.lit(" ("), state, F.lit(") [catalog stub]")).alias("name"),
        drug_name.alias("drug_name"), payer_name.alias("payer_name"), plan.alias("plan_type"), state.alias("state"))
    free = proposals.join(have, "id", "left_anti").withColumn("_range", F.floor(F.col("seq") / RANGE))
    counts = free.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row per range: target / RANGE rows.
    before = counts.select("_range", "_n", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before")).where(F.col("_before") < need)
    place = F.row_number().over(Window.partitionBy("_range").orderBy("seq"))
    return free.join(before, "_range").withColumn("_place", F.col("_before") + place).where(F.col("_place") <= need).select(*proposals.columns)


def patch_catalog(catalog: DataFrame, patch: DataFrame, column: str = "signature_fields") -> tuple[DataFrame, DataFrame]:
    """Replace a column for the listed ids: (catalogue, listed ids with updated / skipped)."""
    new = patch.select("id", F.col(column).alias("_new"))
    patched = catalog.join(new, "id", "left").withColumn(column, F.coalesce("_new", column)).select(*catalog.columns)
    known = catalog.select("id").distinct().withColumn("_known", F.lit(True))
    report = patch.select("id").join(known, "id", "left").select(
        "id", F.when(F.col("_known"), "updated").otherwise("skipped").alias("outcome"))
    return patched, report


def upsert_catalog(catalog: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply add / update rows (``action``, ``seq``): (catalogue, rejects with ``error``).

    Adding a known id and updating an unknown one are rejected. Of several
    accepted changes to an id the last counts, and an id added in the same batch is known
    to later changes.
    """
    data = [c for c in catalog.columns]
    known = catalog.select("id").withColumn("_known", F.lit(True))
    first_add = changes.where("action = 'add'").groupBy("id").agg(F.min("seq").alias("_added"))
    judged = (
        changes.join(known, "id", "left").join(first_add, "id", "left")
        .withColumn("_known", F.coalesce("_known", F.lit(False)))
        .withColumn("_there", F.col("_known") | F.coalesce(F.col("_added") < F.col("seq"), F.lit(False)))
    )
    ok = F.when(F.col("action") == "add", ~F.col("_there")).otherwise(F.col("_there"))
    accepted = judged.where(ok)
    rejects = judged.where(~ok).select("id", "action", "seq", F.when(F.col("action") == "add", F.concat(F.lit("Template '"), "id", F.lit("' already exists")))
                                       .otherwise(F.concat(F.lit("Template '"), "id", F.lit("' not found"))).alias("error"))
    rest = [c for c in data if c != "id"]
    latest = accepted.groupBy("id").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("id", "r.*")
    kept = catalog.join(latest.select("id"), "id", "left_anti")
    return kept.select(*data).unionByName(latest.select(*data)), rejects


def route(records: DataFrame, local_categories: list[str], force_local: bool = True, local_only: bool = False,
          default_provider: str = "gemini") -> DataFrame:
    """Provider per record and whether its endpoint may be used.

    ``records``: provider_hint, category, local_reachable, local_url, cloud_url.
    An explicit hint wins; else listed categories go local where that endpoint answers.
    """
    hinted = F.coalesce(strip("provider_hint"), F.lit("")) != ""
    listed = F.lit(force_local) & F.coalesce(F.col("category").isin(local_categories), F.lit(False))
    hint = F.when(hinted, F.col("provider_hint")).when(
        listed, F.when(F.col("local_reachable"), "local")).otherwise(F.col("provider_hint"))
    provider = F.lower(F.coalesce(F.nullif(strip(hint), F.lit("")), F.lit(default_provider)))
    url = F.when(F.col("provider") == "local", F.col("local_url")).otherwise(F.col("cloud_url"))
    return (
        records.withColumn("provider", provider).withColumn("base_url", url)
        .withColumn("blocked", F.lit(local_only) & (host_class("base_url") == "external"))
    )
