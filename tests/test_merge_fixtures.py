"""Merging of drawings: small sets with the results known."""

import pytest
from pyspark.sql import functions as F

from plansift import model
from plansift.operators import merge

BASE = {"project_id": "p", "doc_id": "d", "ordinal": 0, "drawing_type": "PZT", "source_document": "a.pdf", "page": 1, "raw_text": "", "identifier": None, "type": None, "diameter_mm": None, "ground_m": None, "invert_m": None, "height_m": None, "crown": None, "confidence": "niska", "validation_issues": "", "n_transitions": 0}


def run(spark, *rows):
    df = spark.createDataFrame([{**BASE, "ordinal": k, **r} for k, r in enumerate(rows)], model.RECORD)
    return {r["identifier"]: r for r in merge.merged_records(merge.inventory_gate(df)).collect()}


PLAN = [{"identifier": f"D{k}"} for k in range(1, 7)]


def profile(**fields):
    return {"drawing_type": "PROFIL", "source_document": "b.pdf", **fields}


def test_plan_and_profile_complement_each_other(spark):
    r = run(spark, {"identifier": "D6/1", "ground_m": 134.15, "invert_m": 126.47, "height_m": 7.08}, profile(identifier="d6/1", diameter_mm=1200, type="kinetowa", crown="właz", n_transitions=1))["D6/1"]
    assert (r["diameter_mm"], r["ground_m"], r["invert_m"], r["height_m"], r["type"], r["crown"]) == (1200, 134.15, 126.47, 7.08, "kinetowa", "właz")
    assert len(r["source_documents"]) == 2 and r["completeness"] == 100 and r["confidence"] == "wysoka" and r["missing"] == ""


def test_conflicts_are_told_and_not_averaged(spark):
    r = run(spark, {"drawing_type": "", "identifier": "D1", "invert_m": 126.51}, {"drawing_type": "", "identifier": "D1", "invert_m": 126.47, "source_document": "b.pdf"})["D1"]
    assert r["invert_m"] == 126.51 and r["confidence"] == "niska" and r["validation_issues"] == "sprzeczna rzędna dna: 126.51 / 126.47"


def test_a_profiles_pair_overrides(spark):
    r = run(spark, {"identifier": "D1", "ground_m": 62.69, "invert_m": 61.13}, profile(identifier="D1", ground_m=62.8, invert_m=61.24))["D1"]
    assert (r["ground_m"], r["invert_m"], r["height_m"], r["validation_issues"]) == (62.8, 61.24, 1.56, "")


def test_height_follows_the_profile(spark):
    r = run(spark, {"identifier": "D1", "ground_m": 62.0, "invert_m": 60.82, "height_m": 1.18}, profile(identifier="D1", ground_m=62.0, invert_m=60.97, height_m=1.03, diameter_mm=1200, type="kinetowa", crown="x"))["D1"]
    assert (r["height_m"], r["diameter_mm"], r["type"], r["crown"]) == (1.03, 1200, "kinetowa", "x")


@pytest.mark.parametrize("fields,kept", [({}, False), ({"n_transitions": 1}, False), ({"ground_m": 62.0, "invert_m": 60.0, "n_transitions": 1}, True)])
def test_inventory_gate(spark, fields, kept):
    assert ("S40" in run(spark, *PLAN, profile(identifier="S40", **fields))) == kept


def test_two_profiles_bear_an_identifier_out(spark):
    assert "S40" in run(spark, *PLAN, profile(identifier="S40"), profile(identifier="S40", source_document="c.pdf"))


def test_a_small_plan_is_no_inventory(spark):
    assert "S40" in run(spark, *PLAN[:5], profile(identifier="S40"))


def test_blank_identifiers_never_merge(spark):
    df = spark.createDataFrame([{**BASE, "ordinal": k, "identifier": i} for k, i in enumerate(["", None, " "])], model.RECORD)
    assert merge.merged_records(df).count() == 3


def test_blank_identifiers_of_one_document_never_merge(spark):
    df = spark.createDataFrame([{**BASE, "ordinal": 4, "diameter_mm": dn} for dn in (1000, 1200, 1200)], model.RECORD).withColumn("place", F.monotonically_increasing_id())
    assert sorted((r["diameter_mm"], r["validation_issues"]) for r in merge.merged_records(df).collect()) == [(1000, ""), (1200, ""), (1200, "")]


def test_the_first_page_of_a_document_is_kept_and_said_to_be(spark):
    for dns in ((1000, 1500), (1500, 1000)):
        df = spark.createDataFrame([{**BASE, "ordinal": 4, "identifier": "D1", "page": k, "diameter_mm": dn} for k, dn in enumerate(dns, 1)], model.RECORD).withColumn("place", F.col("page"))
        r = merge.merged_records(df).first()
        assert (r["diameter_mm"], r["validation_issues"]) == (dns[0], f"sprzeczne DN: {dns[0]} / {dns[1]}")


def test_rows_of_one_page(spark):
    shape = "doc_id string, page_no int, place int, identifier string, raw_text string, type string, diameter_mm int, ground_m double, invert_m double, height_m double, crown string, confidence string, transitions array<struct<material:string,diameter_mm:int,quantity:int>>"
    rows = [
        ("d", 1, 1, "D1", "D 1", None, None, None, None, 0.0, "", "niska", [("PVC", 200, 1)]),
        ("d", 1, 2, "d1", "note", "kinetowa", 1200, 60.0, 58.0, 2.0, "właz", "wysoka", [("pvc", 200, 2), ("PP", 300, 1)]),
        ("d", 1, 3, "D1", "NOTE", None, 1500, 61.0, None, 3.0, None, "średnia", []),
        ("d", 1, 4, "", "alone", None, 800, None, None, None, None, "niska", []),
        ("d", 1, 5, None, "Alone", None, 900, None, None, None, None, "niska", []),
        ("d", 1, 6, "", "", None, 900, None, None, None, None, "niska", []),
        ("d", 2, 1, "D1", "D 1", None, None, None, None, None, None, "niska", []),
    ]
    found = merge.page_merged(spark.createDataFrame(rows, shape), ["doc_id", "page_no"]).orderBy("page_no", "place").collect()
    assert [(r["page_no"], r["place"], r["diameter_mm"]) for r in found] == [(1, 1, 1200), (1, 4, 800), (1, 6, 900), (2, 1, None)]
    r = found[0]
    # the last row's note isn't in the joined notes as a whole, so it is joined too
    assert (r["type"], r["ground_m"], r["height_m"], r["crown"], r["confidence"], r["raw_text"]) == ("kinetowa", 60.0, 0.0, "właz", "wysoka", "D 1 | note | NOTE")
    assert [tuple(t) for t in r["transitions"]] == [("PP", 300, 1), ("PVC", 200, 3)]


def test_rounding_of_completeness(spark):
    found = run(spark, {"identifier": "A1"}, {"identifier": "A3", "diameter_mm": 1000, "type": "x"}, {"identifier": "A5", "diameter_mm": 1000, "type": "x", "crown": "y", "n_transitions": 1})
    assert [found[k]["completeness"] for k in ("A1", "A3", "A5")] == [12, 38, 62]


def test_transitions(spark):
    rows = spark.createDataFrame([("p", "a", "D1", "PEHD", 300, 2), ("p", "b", "D1", "PE-HD", 300, 2), ("p", "b", "D1", "PP", 200, 1)], model.TRANSITIONS)
    most = {(r["material"], r["diameter_mm"]): r["quantity"] for r in merge.merged_transitions(rows, ["project_id", "identifier"]).collect()}
    assert most == {("PE-HD", 300): 2, ("PP", 200): 1}
    total = {r["material"]: r["quantity"] for r in merge.merged_transitions(rows, ["project_id"], "sum").collect()}
    assert total == {"PE-HD": 4, "PP": 1}


def test_inlets(spark):
    rows = [{k: BASE.get(k) for k in ("project_id", "doc_id", "ordinal", "drawing_type", "source_document", "page", "raw_text", "identifier", "confidence")} | {"ordinal": n, "identifier": i, "source_document": f"{n}.pdf", "confidence": c} for n, (i, c) in enumerate([("12", "niska"), ("WP12", "średnia")])]
    r = merge.merged_inlets(spark.createDataFrame(rows, model.INLETS)).collect()
    assert [(x["identifier"], x["confidence"], x["source_documents"]) for x in r] == [("WP12", "średnia", ["0.pdf", "1.pdf"])]


def test_set_type(spark):
    rows = [("p", 0, "PROFIL"), ("p", 1, "PZT"), ("p", 2, "NIEZNANY"), ("q", 0, "NIEZNANY"), ("r", 0, "PZT")]
    found = {r["project_id"]: r["drawing_type"] for r in merge.set_type(spark.createDataFrame(rows, "project_id string, ordinal long, drawing_type string")).collect()}
    assert found == {"p": "ZESTAW: PZT + PROFIL", "q": "NIEZNANY", "r": "PZT"}


def test_notes_are_appended_once(spark):
    found = run(spark, {"identifier": "D1", "raw_text": "D1 studnia"}, {"identifier": "D1", "raw_text": "STUDNIA"}, {"identifier": "D1", "raw_text": "inna"})
    assert found["D1"]["raw_text"] == "D1 studnia | inna"
