"""Every registered query against its SQL on the smallest tables."""

import decimal
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) else v
    return v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    mine = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    answer = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert mine == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in answer.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["extract", "infer_labels", "inspect_form", "labeled_fields"])
def test_layout_moves_documents_only(spark, name):
    """Words and fields stay where their document went, also where no side is small enough for a broadcast."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert moved and all("REPARTITION_BY_NUM" in line for line in moved)


def test_partitions_are_kept_for_the_layout_only(spark):
    from recordflow.session import CO_PARTITION
    entry.queries()["reading_order"](spark, SF)
    assert spark.conf.get(CO_PARTITION) == "false"
    entry.queries()["overlay"](spark, SF)
    assert spark.conf.get(CO_PARTITION) == "true"
