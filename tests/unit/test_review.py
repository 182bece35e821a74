"""Review sheets out and decisions in."""

import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.operators import review
from lodestone.sources import sinks

AT = datetime.datetime(2024, 1, 2)


@pytest.fixture(scope="module")
def staged(spark):
    caps = spark.createDataFrame(
        [("c1", "f1", 10.0, ["A", "B"], True, "d1", "p1", '{"capacity_max":"up to 10"}', "pending"), ("c2", "f1", 20.0, [], None, "d1", None, None, "pending"), ("c3", "f2", None, None, False, "d2", None, None, "approved")],
        "cap_id string, family_id string, capacity_max double, standards array<string>, lubricated boolean, source_doc_id string, source_locator string, evidence string, review_status string",
    )
    gases = spark.createDataFrame([("c1", "air", "pending"), ("c2", "air", "approved"), ("c2", "h2", "pending")], "cap_id string, gas string, review_status string")
    return {"capability_row": caps, "capability_gas": gases}


@pytest.fixture(scope="module")
def families(spark):
    return spark.createDataFrame([("f1",), ("f2",)], "family_id string")


@pytest.fixture(scope="module")
def ledger(spark):
    return spark.createDataFrame([("rc.x.0001", "x", "exported"), ("rc.x.0002", "x", "open")], "id string, client string, status string")


def cells(spark, rows):
    return spark.createDataFrame(rows, "cap_id string, family_id string, capacity_max string, standards string, lubricated string, decision string")


def test_sheets_and_back(spark, staged, families, ledger, tmp_path):
    out = review.sheets(staged)
    row = out["capability_row"].where("cap_id = 'c1'").first()
    assert (row["capacity_max"], row["»capacity_max"], row["standards"], row["decision"], row["source_locator"]) == ("10.0", "up to 10", "A, B", "", "p1")
    assert out["capability_gas"].where("cap_id = 'c1'").first().source_doc_id == "d1"
    sinks.write_sheet(out["capability_row"].withColumn("decision", F.when(F.col("cap_id") == "c1", " Approve")), str(tmp_path / "s"))
    sheet = spark.read.csv(str(tmp_path / "s"), header=True, escape='"')
    done = review.take_in(staged, {"capability_row": sheet}, families, ledger, "rc.x.0001", "me", F.lit(AT))
    assert {r.cap_id: (r.review_status, r.reviewer) for r in done.tables["capability_row"].collect()} == {"c1": ("approved", "me"), "c2": ("pending", None), "c3": ("approved", None)}


def test_decisions_are_applied(spark, staged, families, ledger):
    sheet = cells(spark, [("c1", "f2", "", " x , y,", "yes", "edit"), ("c2", "f9", "7", None, None, "REJECT"), ("c3", None, None, None, None, None), (None, None, None, None, None, None)])
    gas = spark.createDataFrame([("c1", "air", "approve")], "cap_id string, gas string, decision string")
    done = review.take_in(staged, {"capability_row": sheet, "capability_gas": gas}, families, ledger, "rc.x.0001", "me", F.lit(AT))
    rows = {r.cap_id: r for r in done.tables["capability_row"].collect()}
    assert (rows["c1"].family_id, rows["c1"].capacity_max, rows["c1"].standards, rows["c1"].lubricated, rows["c1"].review_status) == ("f2", None, ["x", "y"], True, "edited")
    assert (rows["c2"].family_id, rows["c2"].capacity_max, rows["c2"].review_status, rows["c2"].reviewed_at) == ("f1", 20.0, "rejected", datetime.datetime(2024, 1, 2))
    assert rows["c3"].review_status == "approved" and rows["c3"].reviewer is None
    gases = {(r.cap_id, r.gas): (r.review_status, r.reviewer) for r in done.tables["capability_gas"].collect()}
    assert gases == {("c1", "air"): ("approved", "me"), ("c2", "air"): ("rejected", "me"), ("c2", "h2"): ("rejected", "me")}
    counts = {r.table: r for r in done.counts.collect()}
    assert (counts["capability_row"].edit, counts["capability_row"].reject, counts["capability_row"].blank, counts["capability_gas"].approve) == (1, 1, 1, 1)
    assert {r.id: r.status for r in done.ledger.collect()} == {"rc.x.0001": "imported", "rc.x.0002": "open"}


def test_any_error_stops_all(spark, staged, families, ledger):
    sheet = cells(spark, [("c1", "f9", "many", None, None, "edit"), ("c2", None, None, None, None, "maybe"), ("c9", None, None, None, None, "approve"), ("c3", None, None, None, None, "approve"), ("c3", None, None, None, None, "reject")])
    found = {(e.row, e.error) for e in review.errors(staged, {"capability_row": sheet}, families).collect()}
    assert found == {("c1", "unknown family f9"), ("c1", "capacity_max isn't a number: many"), ("c2", "unknown decision maybe"), ("c9", "no such row"), ("c3", "several decisions")}
    with pytest.raises(ValueError, match="capability_row c1: capacity_max"):
        review.take_in(staged, {"capability_row": sheet}, families, ledger, "rc.x.0001")
