import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from recordflow.functions import fixed, geometry as G, scalars as S, secrets
from recordflow.functions.responses import parse_mapping_response, parse_zone_response
from recordflow.plans.profiles import protect_profiles, reveal_profiles


def test_phone(one):
    values = ["5125550192", "512-555-0192", "512.555.0192", "15125550192", "(512) 555-0192", "not-a-phone", "12345"]
    assert one(S.normalise_phone, values) == ["(512) 555-0192"] * 5 + ["not-a-phone", "12345"]


def test_date(one):
    assert one(S.normalise_date, ["03/14/1978", "1978-03-14", "14-03-1978", "March 14, 1978"]) == ["03/14/1978"] * 3 + ["March 14, 1978"]


def test_bool(one):
    assert one(S.normalise_bool, ["true", "yes", "Y", "1", "x", "false", "no", "N", "0", "Maybe"]) == ["Yes"] * 5 + ["No"] * 4 + ["Maybe"]


def test_keys(one):
    assert one(S.to_snake, ["patientName", "patientDOBValue", "already_snake", "PhysicianPhone"]) == [
        "patient_name", "patient_dob_value", "already_snake", "physician_phone"]
    assert one(S.canonical_key, ["medication_j_code", "dob", "nothing"]) == ["drug_j_code", "patient_dob", "nothing"]
    assert len(fixed.ALIASES) == 43 and len(fixed.CANONICAL_OF) == 130


@pytest.mark.parametrize("key, hidden", [("ssn", True), ("ITIN", True), ("routing_number", True), ("birthdate", True), ("shipping", True), ("email", False), ("zip", False), ("employer", False)])
def test_sensitive(one, key, hidden):
    assert one(S.is_sensitive, [key]) == [hidden]


def test_value_by_key(spark):
    rows = [("hotel", "5125550192"), ("update", "1978-03-14"), ("fax_date", "1978-03-14"), ("note", " x "), ("note", "  ")]
    d = spark.createDataFrame(rows, "k string, v string")
    assert [r[0] for r in d.select(S.normalise_value(F.col("k"), "v")).collect()] == ["(512) 555-0192", "03/14/1978", "1978-03-14", "x", None]


def test_hosts(one):
    private = ["http://localhost:1", "http://127.0.0.1/x", "http://[::1]:8", "http://0.0.0.0", "http://10.0.0.5", "http://172.20.1.1", "http://192.168.0.9", "http://nas.local", "http://a.internal", "http://b.lan", "http://[fd00::1]"]
    external = ["https://api.example.com", "http://8.8.8.8", "http://172.32.0.1", "http://10.evil.com", "http://192.168.0.9.example.com", "no url"]
    assert one(S.host_class, private + external) == ["private"] * len(private) + ["external"] * len(external)


def test_progress_without_total(spark):
    assert spark.range(1).select(S.progress_pct(F.lit(0), F.lit(0))).first()[0] == 0.0


def test_fingerprint_ignores_order_and_needs_data(spark):
    labels = spark.range(1).select(
        S.fingerprint(F.expr("map('a','1','b','2')"), F.expr("map('x','p','y','q')")), S.fingerprint(F.expr("map('b','2','a','1')"), F.expr("map('y','q','x','p')")),
        S.fingerprint(F.expr("map('a','1','b','2')"), F.expr("map('x','p','y','r')")), S.fingerprint(F.expr("map('a','1','b','3')"), F.expr("map('x','p','y','q')"))).first()
    assert labels[0] == labels[1] and len(set(labels)) == 3 and len(labels[0]) == 32


def test_geometry(spark):
    r = spark.range(1).select(
        G.band(F.lit(1), F.lit(0), F.lit(3)), G.band(F.lit(5), F.lit(5), F.lit(5)), G.box_to_pct(*[F.lit(v) for v in (612.0, 0.0, 0.0, 79.2, 612.0, 792.0)]),
        G.box_to_pct(*[F.lit(v) for v in (1.0, 0.0, 2.0, 79.2, 612.0, 792.0)]), G.pct_to_box(*[F.lit(v) for v in (100.0, 100.0, 90.0, 5.0, 20.0, 5.0)])).first()
    assert (r[0], r[1]) == ("mid", "low")
    assert tuple(r[2]) == (0.0, 0.0, 100.0, 10.0) and r[3] is None and r[4]["error"] == "box overflows the page"


def test_mapping_answers(one):
    fence = "`" * 3
    doc = json.dumps({"a": {"value": "v", "confidence": 0.4}, "b": {"value": ""}, "c": "s", "d": {"value": True}, "e": None})
    want = [("a", "v", 0.4), ("c", "s", 1.0), ("d", "True", 1.0), ("e", "None", 1.0)]
    for text in (doc, f"{fence}json\n{doc}\n{fence}", f"  {fence}\n{doc}{fence}"):
        assert sorted(map(tuple, one(parse_mapping_response, [text])[0])) == want
    assert one(parse_mapping_response, ["sorry", "[1]", ""]) == [[], [], []]


def test_zone_answers(one):
    zones = one(lambda c: parse_zone_response(c, F.lit(2)), ['[{"label": "Sign Here", "x_pct": 10, "y_pct": 80}, {"x_pct": "left"}, 5]', "{}"])
    assert [z["key"] for z in zones[0]] == ["sign_here"] and zones[0][0]["y_pct"] == 12.0 and zones[1] == []


def test_protect_and_reveal(spark):
    rows = [("p1", {"ssn": "123-45-6789", "email": "a@example.com", "dob": ""}), ("p2", {"email": "b@example.com"})]
    d = spark.createDataFrame(rows, "id string, data map<string,string>")
    hidden = protect_profiles(d, "secret")
    back = {r["id"]: r["data"] for r in hidden.collect()}
    assert set(back["p1"]) == {"ssn_encrypted", "email", "dob_encrypted"} and back["p2"] == rows[1][1]
    assert {r["id"]: r["data"] for r in reveal_profiles(spark.createDataFrame([(k, v) for k, v in back.items()], d.schema), "secret").collect()} == dict(rows)
    wrong = reveal_profiles(spark.createDataFrame([("p1", back["p1"])], d.schema), "other").first()["data"]
    assert wrong == {"ssn": fixed.DECRYPTION_ERROR, "email": "a@example.com", "dob": ""}


def test_signed_events(spark):
    d = spark.createDataFrame([("1000", "body"), ("x", "body")], "ts string, body string").withColumn("sig", secrets.sign_event("ts", "body", "k"))
    rows = d.select("sig", secrets.verify_event("ts", "body", "sig", F.lit(1600), "k"), secrets.verify_event("ts", "body", "sig", F.lit(1601), "k"),
                    secrets.verify_event("ts", "body", "sig", F.lit(1000), "other")).collect()
    assert rows[0][0] == "v1=" + hmac.new(b"k", b"1000.body", hashlib.sha256).hexdigest()
    assert list(rows[0])[1:] == [True, False, False] and list(rows[1])[1:] == [False, False, False]


def test_white_space_of_any_kind(one):
    pad = ["\t{}\n", "\r\n{} ", " {} ", " {}\x0b"]
    assert one(S.strip, [p.format("a b") for p in pad]) == ["a b"] * 4
    assert one(S.normalise_date, [p.format("1978-03-14") for p in pad]) == ["03/14/1978"] * 4
    assert one(S.normalise_bool, [p.format("yes") for p in pad]) == ["Yes"] * 4
    assert one(S.safe_request_id, [p.format("abcdefgh") for p in pad]) == ["abcdefgh"] * 4
    assert one(S.checkbox_state, [p.format("On") for p in pad]) == ["/Yes"] * 4
