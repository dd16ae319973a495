from pyspark.sql import functions as F

from recordflow.operators import catalog as K, catalog_index as IX

ROWS = [("a", "Alpha", "Ring ring", "ringer", "Acme", "TX"), ("b", "alpha", "STRING", None, "acme co", None), ("c", None, None, None, None, None),
        ("d", "beta", "rinring", "İring é😀x", "Ac me", "ri"), ("e", "beta", "", "ri", "cme", "tx"), ("f", "alpha", "ngri", "ingrin", "Acme", "CA")]
TERMS = ["ring", "RI", "r", "é😀x", "😀", "ringr", "ring r", "gri", "ingring", "aaaa", "acme", "cm", "%", "_ing", "xyz"]


def catalog(spark):
    d = spark.createDataFrame(ROWS, "id string, category string, drug string, generic string, payer string, state string")
    return d.select(
        "id", F.lit("n").alias("name"), "category", F.lit(None).cast("string").alias("specialty"), F.when(F.col("id") != "c", F.struct(F.col("drug").alias("name"), F.col("generic").alias("generic_name"))).alias("drug"),
        F.when(F.col("id") != "c", F.struct(F.col("payer").alias("name"), F.lit(None).cast("string").alias("plan_type"), "state")).alias("payer"), F.array("id").alias("tags"), (F.col("id") < "d").alias("is_public"))


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    c, path = catalog(spark), str(tmp_path / "index")
    IX.build_index(c, path)
    searches = [{k: t} for t in TERMS for k in ("drug", "payer")] + [{}, dict(drug="ring", payer="acme"), dict(drug="rin", state="tx"), dict(category="ALPHA", payer="ac", is_public=True), dict(tag="D"), dict(state="ri")]
    for args in searches:
        want = sorted(r[0] for r in K.search_catalog(c, **args).select("id").collect())
        assert sorted(r[0] for r in IX.search_ids(spark, path, **args).collect()) == want, args
    assert IX.search_indexed(c, path, drug="gri").columns == c.columns


def test_index_of_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    IX.build_index(catalog(spark).limit(0), path)
    assert IX.search_ids(spark, path, drug="ring", category="x").collect() == IX.search_ids(spark, path).collect() == []


def test_search_reads_only_the_index_columns(spark, tmp_path):
    c, path = catalog(spark), str(tmp_path / "index")
    IX.build_index(c, path)
    plan = IX.search_ids(spark, path, drug="ring", payer="acme")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [ing,rin])" in plan  # pushed to the sorted parts
    assert "tags" not in plan and "specialty" not in plan
