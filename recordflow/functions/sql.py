"""The scalar functions by name, for use from SQL.

``register(spark)`` defines temporary SQL functions; Spark inlines their bodies,
so they optimise like any expression. HMAC, which has no SQL form, is
registered as a pandas UDF.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from recordflow.functions import fixed, secrets
from recordflow.functions.scalars import sql_bool, sql_strip

DIGITS = "regexp_replace(s, '[^0-9]', '')"
LAST_TEN = f"right({DIGITS}, 10)"
BARE = sql_strip("s")
D2, D4 = "[0-9]" * 2, "[0-9]" * 4

FUNCTIONS = {
    "to_snake": "lower(regexp_replace(regexp_replace(s, '(.)([A-Z][a-z]+)', '$1_$2'), '([a-z0-9])([A-Z])', '$1_$2'))",
    "normalise_phone": (f"CASE WHEN length({DIGITS}) = 10 OR (length({DIGITS}) = 11 AND startswith({DIGITS}, '1')) "
                        f"THEN concat('(', substr({LAST_TEN}, 1, 3), ') ', substr({LAST_TEN}, 4, 3), '-', substr({LAST_TEN}, 7, 4)) ELSE s END"),
    "normalise_date": (f"CASE WHEN {BARE} RLIKE '^{D4}-{D2}-{D2}$' THEN regexp_replace({BARE}, '^(....)-(..)-(..)$', '$2/$3/$1') "
                       f"WHEN {BARE} RLIKE '^{D2}-{D2}-{D4}$' THEN regexp_replace({BARE}, '^(..)-(..)-(....)$', '$2/$1/$3') ELSE {BARE} END"),
    "normalise_bool": sql_bool("s"),
    "is_sensitive": f"lower(s) RLIKE '{'|'.join(fixed.SENSITIVE_PARTS)}'",
    "leaf_name": "substring_index(s, '.', -1)",
    "checkbox_state": f"CASE WHEN lower({BARE}) IN ('yes', 'true', '1', 'on') THEN '/Yes' ELSE '/Off' END",
    "field_kind": "CASE WHEN contains(s, '/Tx') THEN 'text' WHEN contains(s, '/Btn') THEN 'checkbox' ELSE 'other' END",
    "normalise_profile_type": f"replace(lower({BARE}), ' ', '_')",
    "safe_request_id": f"CASE WHEN {BARE} RLIKE '^[A-Za-z0-9_-]{{8,128}}$' THEN {BARE} END",
    "content_hash": "sha2(s, 256)",
}
BOOLEAN = {"is_sensitive"}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Define the functions, each with ``prefix``; returns their names."""
    for name, body in FUNCTIONS.items():
        kind = "BOOLEAN" if name in BOOLEAN else "STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(s STRING) RETURNS {kind} RETURN {body}")
    spark.udf.register(f"{prefix}hmac_sha256", secrets._hmac_hex)
    return [*(prefix + n for n in FUNCTIONS), f"{prefix}hmac_sha256"]
