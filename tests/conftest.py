import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from recordflow import build_session
    from recordflow.session import STATE_STORE
    s = build_session("tests", "local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g",
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def one(spark):
    """Evaluate Column functions of one text column over a list of values."""
    def run(fn, values, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {kind}")
        return [r[0] for r in rows.orderBy("i").select(fn("s")).collect()]
    return run
