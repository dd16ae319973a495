"""Registration of queries over the test tables, with the SQL that checks them.

Inputs that both engines derive the same way are written once, as SQL with
tables in braces: ``{orders}``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordflow.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bind(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """Run a shared input on Spark."""
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: table(spark, sf, n) for n in names})


def duck(text: str) -> str:
    """The same input for the checking engine."""
    return re.sub(r"\{(\w+)\}", r"\1", text)


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        key = name or fn.__name__

        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(configure(spark), sf)

        assert key not in QUERIES, key
        QUERIES[key] = run
        if sql is not None:
            SQL[key] = duck(sql)
        return fn
    return add


def project(name: str, source: str, column: Callable, sql: str, out: str = "result", keep: tuple[str, ...] = ("id",)) -> None:
    """Register a Column function over a shared input: ``sql`` is its expression there."""
    names = ", ".join(keep)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return bind(spark, sf, source).select(*keep, column().alias(out))

    query(f"SELECT {names}, {sql} AS {out} FROM ({source})", name)(run)


def quoted(values) -> str:
    return ", ".join("'" + str(v) + "'" for v in values)


def pick(values, by: str) -> str:
    """Shared SQL: one of a list of texts, chosen by a whole number."""
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE ({by}) % {len(values)} {cases} END)"
