import hashlib
import hmac

from pyspark.sql import functions as F

from recordflow.functions import scalars as S, sql

TEXTS = ["5125550192", "1-512-555-0192", "2024-05-06", "06-05-2024", " yes ", "N", "patientName", "ssnNumber", "a.b.c", "/Btn", "/Tx", "Care Provider", "req-12345678", "on", "", None]


def test_sql_functions_agree_with_column_functions(spark):
    names = sql.register(spark, "rf_")
    d = spark.createDataFrame([(t,) for t in TEXTS], "s string")
    for name in sql.FUNCTIONS:
        mine = [r[0] for r in d.select(getattr(S, name)("s")).collect()]
        assert [r[0] for r in d.select(F.expr(f"rf_{name}(s)")).collect()] == mine, name
    assert "rf_hmac_sha256" in names
    got = spark.sql("SELECT rf_hmac_sha256('k', '1.b')").first()[0]
    assert got == hmac.new(b"k", b"1.b", hashlib.sha256).hexdigest()
