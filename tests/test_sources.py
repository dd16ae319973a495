import json
import zipfile

import pytest
from pyspark.sql import functions as F

from recordflow.plans.profiles import import_profiles
from recordflow.sources import readers as R, sinks as W, xlsx


def entries(df):
    d = df.orderBy("file", "idx").select("idx", F.transform("entries", lambda e: F.struct(e["key"], e["value"].cast("string"))).alias("e"))
    return [(r["idx"], [tuple(e) for e in r["e"]]) for r in d.collect()]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿name,note\nAnn,"two\nlines"\n\nBob,\n', encoding="utf-8")
    assert entries(R.read_csv_records(spark, str(tmp_path))) == [(1, [("name", "Ann"), ("note", "two\nlines")]), (2, [("name", "Bob"), ("note", "")])]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "b.csv").write_text("name,note\n")
    with pytest.raises(ValueError):
        R.read_csv_records(spark, str(tmp_path / "empty"))


def test_csv_by_own_header_and_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,zip\nAnn,1\n")
    (tmp_path / "b.csv").write_text("zip,name,extra\n2,Bob,E\n")
    (tmp_path / "c d.csv").write_bytes("name,zip\nZoé,3\n".encode("latin-1"))
    assert sorted(e for _, e in entries(R.read_csv_records(spark, str(tmp_path)))) == [
        [("name", "Ann"), ("zip", "1")], [("name", "Zoé"), ("zip", "3")], [("zip", "2"), ("name", "Bob"), ("extra", "E")]]
    kinds = R.csv_kinds(spark, str(tmp_path)).collect()
    assert len(kinds) == 3 and not any(k["breaks"] for k in kinds)


def test_profile_import(spark, tmp_path):
    (tmp_path / "p.csv").write_text("name,profile_type,npi,phone\nDr. Alice,Care Provider,12,(555) 1\n , ,,\n,patient,,1\nJohn,,,2\n")
    got = import_profiles(R.read_profile_import(spark, str(tmp_path)), "provider").orderBy("row").select("row", "name", "profile_type", F.to_json("data"), "error").collect()
    assert [tuple(r) for r in got] == [(2, "Dr. Alice", "care_provider", '{"npi":"12","phone":"(555) 1"}', None), (3, "", "patient", '{"phone":"1"}', "Missing 'name' column"),
                                       (4, "John", "personal", '{"phone":"2"}', None)]


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1, "b": {"c": True}}, {"a": None}]))
    assert entries(R.read_json_records(spark, str(tmp_path))) == [(1, [("a", "1"), ("b", '{"c":true}')]), (2, [("a", None)])]


def test_bad_json_files_are_reported(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, 5]')
    (tmp_path / "b.json").write_text('[{"a": 2}, {"a"')
    (tmp_path / "c.json").write_text('{"a": 3}')
    got = sorted((r["file"][-6:], r["idx"], r["error"]) for r in R.read_json_records(spark, str(tmp_path)).select("file", "idx", "error").collect())
    assert got == [("a.json", 1, None), ("a.json", 2, "not a JSON object"), ("b.json", None, "not a JSON array"), ("c.json", None, "not a JSON array")]


def workbook(path, rows, active=0):
    """A small workbook; cells are str, int, float, bool or None."""
    def cell(r, c, v):
        ref = f'r="{chr(65 + c)}{r}"'
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c {ref} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, tuple):
            return f'<c {ref} s="1"><v>{v[0]}</v></c>'
        return f'<c {ref} t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c {ref}><v>{v}</v></c>'
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = "".join(f'<row r="{i}">' + "".join(cell(i, c, v) for c, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["first", None, "n "], ["Ann", 42.0, True], [None, None, None], [" Bob ", 1.5, (45292,)]])
    assert entries(xlsx.read_xlsx_records(spark, str(tmp_path))) == [
        (1, [("first", "Ann"), ("column_1", "42"), ("n", "TRUE")]), (2, [("first", "Bob"), ("column_1", "1.5"), ("n", "2024-01-01 00:00:00")])]
    workbook(tmp_path / "a.xlsx", [["only", "header"]])
    with pytest.raises(ValueError):
        xlsx.read_xlsx_records(spark, str(tmp_path))


def test_documents_skip_what_is_broken(spark, tmp_path):
    for name, text in {"t1": '{"id": "t1", "name": "A", "payer": {"name": "P"}, "questions": [{"key": "k"}]}', "t2": "{oops", "t3": '{"name": "no id"}'}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(text)
    assert [(r["folder"], r["payer"]["name"]) for r in R.read_catalog(spark, str(tmp_path)).collect()] == [("t1", "P")]
    jobs = tmp_path / "jobs"
    jobs.mkdir()
    (jobs / "j1.json").write_text('{\n "id": "j1", "status": "done",\n "progress": {"total": 2}}')
    (jobs / "j1_payload.json").write_text('{"id": "payload"}')
    (jobs / "j2.json").write_text("{")
    assert [r["id"] for r in R.read_jobs(spark, str(jobs)).collect()] == ["j1"]
    (jobs / "sess_1.json").write_text('{"session_id": "s", "signers": [{"index": 0, "name": "N"}]}')
    assert [r["signers"][0]["name"] for r in R.read_sessions(spark, str(jobs)).collect()] == ["N"]


def test_extract_csv_columns(spark, tmp_path):
    d = spark.createDataFrame([("n", None, 'a,"b"', 1, "text", 9)], "name string, label string, value string, page int, field_type string, extra int")
    W.write_extract_csv(d, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).collect()[0][0] == "name,label,value,page,field_type"


def test_documents_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(0, 1200, 1, 1).select(F.col("id").cast("string").alias("id"), F.lit("n").alias("name"))
    W.write_documents(rows, str(tmp_path / "flat"))
    W.write_documents(rows.withColumn("k", F.concat(F.lit("t"), "id")), str(tmp_path / "folders"), "k")
    for files in (list((tmp_path / "flat").glob("part-*.json")), list((tmp_path / "folders").glob("k=*/part-*.json"))):
        assert len(files) == 1200 and len({f.name.split("-")[1] for f in files}) >= 3
    for folder in ("flat", "folders"):
        got = R.read_documents(spark, str(tmp_path / folder), R.PROFILE, "*.json")
        assert got.select("id").distinct().count() == got.count() == 1200
