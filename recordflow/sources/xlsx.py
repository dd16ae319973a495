"""Workbooks: many files per job, spread over tasks by Spark's binary file source.

A workbook is a ZIP of XML, so one file is read inside one task; its rows leave
the task in batches.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
ROWS = "file string, idx long, keys array<string>, cells array<string>"
BATCH = 5000
# Built-in number formats that show a date or time.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ET.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in root.iter(f"{MAIN}si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{MAIN}numFmt")
           if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))}
    styles = root.find(f"{MAIN}cellXfs")
    return {i for i, x in enumerate(styles if styles is not None else []) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def _active_sheet(book: zipfile.ZipFile) -> str:
    root = ET.fromstring(book.read("xl/workbook.xml"))
    view = root.find(f"{MAIN}bookViews/{MAIN}workbookView")
    sheets = list(root.iter(f"{MAIN}sheet"))
    sheet = sheets[int(view.get("activeTab", 0)) if view is not None else 0]
    links = ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in links if r.get("Id") == sheet.get(f"{REL}id"))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _text(cell: ET.Element, shared: list[str], dates: set[int]) -> str:
    kind, value = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t")).strip()
    if value is None:
        return ""
    if kind == "s":
        return shared[int(value)].strip()
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    if kind != "n":
        return value.strip()
    number = float(value)
    if int(cell.get("s", 0)) in dates:
        return str(dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(number * 86400)))
    return str(int(number)) if number == int(number) else str(number)


def sheet_rows(content: bytes) -> Iterator[list[str]]:
    """Rows of the active sheet as cell texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared, dates = _shared(book), _date_styles(book)
        with book.open(_active_sheet(book)) as sheet:
            for _, row in ET.iterparse(sheet):
                if row.tag != f"{MAIN}row":
                    continue
                cells: list[str] = []
                for i, c in enumerate(row.findall(f"{MAIN}c")):
                    at = _column(c.get("r")) if c.get("r") else i
                    cells.extend([""] * (at + 1 - len(cells)))
                    cells[at] = _text(c, shared, dates)
                row.clear()
                yield cells


def _read(blank: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = sheet_rows(content)
                head = next(rows, None)
                if head is None:
                    continue
                keys = [h or f"{blank}_{i}" for i, h in enumerate(head)]
                out, idx = [], 0
                for cells in rows:
                    cells = (cells + [""] * len(keys))[:len(keys)]
                    if not any(cells):
                        continue
                    idx += 1
                    out.append((path, idx, keys, cells))
                    if len(out) == BATCH:
                        yield pd.DataFrame(out, columns=["file", "idx", "keys", "cells"])
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=["file", "idx", "keys", "cells"])
    return read


def read_xlsx_records(spark: SparkSession, path: str, require_rows: bool = True) -> DataFrame:
    """Records (file, idx, entries) of the first sheet shown; empty rows are dropped.
    A header cell without text becomes ``column_{i}``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    rows = files.mapInPandas(_read("column"), ROWS)
    out = rows.select("file", "idx", F.zip_with("keys", "cells", lambda k, v: F.struct(
        k.alias("key"), v.cast("variant").alias("value"))).alias("entries"))
    if require_rows and out.isEmpty():
        raise ValueError(f"no populated data rows after the header in {path}")
    return out


def read_xlsx_import(spark: SparkSession, path: str) -> DataFrame:
    """Import rows (import_id, row, data); a header cell without text becomes ``col_{i}``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    rows = files.mapInPandas(_read("col"), ROWS)
    return rows.select(F.col("file").alias("import_id"), (F.col("idx") + 1).alias("row"), F.map_from_arrays("keys", "cells").alias("data"))
