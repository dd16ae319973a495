"""Session settings the operators rely on."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings that change results.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # Records are ordered key/value lists in which the last write wins and the
    # first position stays, which is what LAST_WIN map building does.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Recursive queries end by themselves; limits on their rows and levels would fail large inputs.
    "spark.sql.cteRecursionRowLimit": "-1",
    "spark.sql.cteRecursionLevelLimit": "-1",
}

# Settings that only change speed; a value set by the cluster is left alone.
# forceOptimizeSkewedJoin lets AQE split a hot join key even where that costs
# one more shuffle.
TUNING_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Whether a join may stay in tables that are partitioned alike by some of its keys instead of moving both by all of
# them. Only safe where those keys are many, so ``configure`` takes it back and ``keep_partitions`` gives it.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, which do not share the
    driver's ``sys.path``: by path on this machine, as an archive on a cluster."""
    context = spark.sparkContext
    root = str(Path(__file__).resolve().parent.parent)
    path = context.environment.get("PYTHONPATH", "")
    if root in path.split(os.pathsep):
        return
    context.environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, path) if p)
    if not context.master.startswith("local"):
        context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "recordflow"), "zip", root, "recordflow"))


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a session made elsewhere."""
    ship_package(spark)
    for key, value in SEMANTIC_CONF.items():
        spark.conf.set(key, value)
    given = {k for k, _ in spark.sparkContext.getConf().getAll()}
    for key, value in TUNING_CONF.items():
        if key not in given:
            spark.conf.set(key, value)
    if CO_PARTITION not in given:
        spark.conf.set(CO_PARTITION, "true")
    return spark


def keep_partitions(spark: SparkSession) -> None:
    """Let joins stay in tables that are partitioned alike by some of their keys, until ``configure`` is called again.

    Spark reads the setting when an action is planned; without it the rows are the same, but move before each join.
    """
    spark.conf.set(CO_PARTITION, "false")


def build_session(app: str = "recordflow", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SEMANTIC_CONF, **TUNING_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for tables and checkpoints in between.

    The cluster names it in ``spark.checkpoint.dir``. Only in local mode, where one machine
    holds everything, an unset name is replaced by a temporary folder; a cluster
    without a shared folder is an error, as its executors would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="recordflow-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame, rows: int, a_task: int, *by: str) -> DataFrame:
    """Deal rows over tasks of ``a_task`` rows, evenly or by columns, before work that costs far more than reading them:
    Spark cuts a compact file by its bytes, so one task may get all of them, and its fixed number of shuffle partitions lets tasks grow with the input."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // a_task)), *by)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, safe from lost executors."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
