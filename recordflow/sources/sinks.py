"""Writers: extracts, reports, audit events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recordflow.operators.reports import batch_report

EXTRACT = ["name", "label", "value", "page", "field_type"]
DOCUMENTS_A_TASK = 500


def write_extract_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """name, label, value, page, field_type as UTF-8 CSV with header."""
    df.select(*EXTRACT).write.csv(path, header=True, mode=mode, emptyValue="", escape='"')


def write_extract_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select(*EXTRACT).write.json(path, mode=mode)


def write_batch_report(results: DataFrame, path: str, timestamp: str | None = None, mode: str = "errorifexists") -> None:
    """``header``: one row per batch; ``results``: one row per record, by batch in index order.

    A batch may hold any number of records, so its results stay rows: they are
    range-partitioned by (batch, idx), which splits a large batch over files.
    """
    header = batch_report(results).withColumn("timestamp", F.lit(timestamp))
    header.write.json(f"{path}/header", mode=mode)
    ordered = results.repartitionByRange("batch_id", "idx").sortWithinPartitions("batch_id", "idx")
    ordered.write.json(f"{path}/results", mode=mode)


def append_audit(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_documents(df: DataFrame, path: str, folder: str | None = None) -> None:
    """One JSON document per row and file, or with ``folder`` one per folder of that column's values.

    A file costs far more than its row and the rows of many files may lie in one, so they are dealt anew over
    tasks by their number. Each task commits its own files: the driver alone would take as long again.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // DOCUMENTS_A_TASK))
    spread = df.repartition(tasks, folder) if folder else df.repartition(tasks)
    writer = spread.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    (writer.partitionBy(folder) if folder else writer.option("maxRecordsPerFile", 1)).json(path)
