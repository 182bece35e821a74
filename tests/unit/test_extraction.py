"""Classification, the stop for families, extraction and staging with a model of rules."""

import json
import re
import sys

import pytest
from pyspark import cloudpickle

from lodestone.operators import documents, extraction

cloudpickle.register_pickle_by_value(sys.modules[__name__])
BODY = """intro words

# Gas range
Oil-free reciprocating compressors, up to 20,000 Nm3/hr and 350 barg, for Hydrogen and Air, API-618.

# Gas range again
up to 25,000 Nm3/hr for Hydrogen

# Models
MX-16 compact unit; 300 bar rating

# About
Founded in 1963 by makers

# Offices
Delhi branch, 12 Main Road

# Broken
x
"""


def ev(value, phrase=None):
    return {"value": value, "evidence": value if phrase is None else phrase}


def model(prompt):
    p = json.loads(prompt)
    heading = re.search(r"HEADING: (.*)", p["user"])
    heading = heading and heading[1]
    if p["schema"] == "section_classification":
        types = {"Gas range": "capability_spec", "Gas range again": "capability_spec", "Models": "product_list", "About": "company_fact", "Offices": "office_contact", "Broken": "office_contact", "(preamble)": "poem"}
        return json.dumps({"type": types[heading], "confidence": 0.9})
    if p["schema"] == "family_discovery":
        return json.dumps({"families": [{"id": "gas", "name": "Gas range", "division": "industrial"}, {"id": "mx", "name": "MX"}, {"name": "no id"}]})
    if heading == "Broken":
        return "[]"
    if p["schema"] == "extract_capability_spec":
        assert "gas Gas compressors" in p["system"]
        first = heading == "Gas range"
        row = {"family": ev("gas", "Gas range"), "capacity": ev("up to 20,000 Nm3/hr" if first else "up to 25,000 Nm3/hr"), "gases": [ev("Hydrogen"), ev("Helium"), ev("hydrogen", "Hydrogen")], "standards": [ev("API-618")]}
        return json.dumps({"rows": [row | ({"lubricated": ev("false", "Oil-free"), "discharge_pressure": ev("350 barg"), "comp_type": ev("screw", "screw type")} if first else {}), {"family": ev("invented", "Gas range")}]})
    if p["schema"] == "extract_product_list":
        return json.dumps({"products": [{"family": ev("mx", "MX-16"), "model_name": ev("MX-16"), "attributes": [ev("300 bar rating"), ev("400 bar")]}]})
    if p["schema"] == "extract_company_fact":
        return json.dumps({"facts": [{"kind": ev("founded", "Founded"), "value": ev("1963")}, {"kind": ev("rumour", "by"), "value": ev("makers")}]})
    return json.dumps({"offices": [{"city": ev("Delhi"), "phone": ev("+91 0"), "serves_divisions": []}]})


@pytest.fixture(scope="module")
def sections(spark):
    docs = spark.createDataFrame([("doc.a", BODY)], "doc_id string, body string")
    return documents.sections(docs)


@pytest.fixture(scope="module")
def families(spark):
    return spark.createDataFrame([("gas", "Gas compressors"), ("mx", "MX units")], "family_id string, name string")


def test_families_are_proposed_first(spark, sections):
    reached = extraction.run(sections, model, None)
    assert sorted(r.type for r in reached.classified.collect()) == ["capability_spec", "capability_spec", "company_fact", "office_contact", "office_contact", "other", "product_list"]
    assert reached.extracted is None and {(r.id, r.name) for r in reached.proposals.collect()} == {("gas", "Gas range"), ("mx", "MX")}


def test_extraction_and_staging(spark, sections, families):
    reached = extraction.run(sections, model, families, {"extract_company_fact": "F"})
    made = reached.extracted
    caps = sorted(made.tables["capability_row"].collect(), key=lambda r: r.cap_id)
    assert [(r.family_id, r.needs_family, r.capacity_max, r.discharge_p_max, r.lubricated, r.comp_type, r.conflict_group) for r in caps] == [
        ("gas", False, 20000.0, 350.0, False, None, "cg.gas.capacity"), (None, True, None, None, None, None, None),
        ("gas", False, 25000.0, None, None, None, "cg.gas.capacity"), (None, True, None, None, None, None, None),
    ]
    assert caps[0].standards == ["API-618"] and json.loads(caps[0].evidence)["lubricated"] == "Oil-free" and caps[0].source_doc_id == "doc.a" and caps[2].standards == []
    assert sorted((r.cap_id, r.gas) for r in made.tables["capability_gas"].collect()) == sorted((c.cap_id, g) for c in (caps[0], caps[2]) for g in ("Hydrogen", "hydrogen"))
    (product,) = made.tables["product"].collect()
    assert (product.family_id, product.model_name, json.loads(product.attributes)) == ("mx", "MX-16", {"printed": ["300 bar rating"]})
    assert [(r.kind, r.value) for r in sorted(made.tables["company_fact"].collect(), key=lambda r: r.fact_id)] == [("founded", "1963"), (None, "makers")]
    (office,) = made.tables["office"].collect()
    assert (office.city, office.phone, office.region, office.serves_divisions) == ("Delhi", None, None, [])
    assert {(r.path, r.value) for r in made.drops.collect()} == {("rows[0].comp_type", "screw"), ("rows[0].gases[1]", "Helium"), ("rows[0].standards[0]", "API-618"), ("products[0].attributes[1]", "400 bar"), ("offices[0].phone", "+91 0")}
    assert made.skipped.count() == 1
    report = [r.line for r in extraction.lines(made, families).orderBy("n").collect()]
    assert report[0] == "families: 2" and "capability_row: 4" in report and "rows that need a family: 2" in report and "conflict groups: 1" in report and "fields dropped: 6" in report
    old = made.tables["product"].withColumns({})
    reviewed = old.selectExpr("product_id", "'old' AS model_name", "'approved' AS review_status").unionByName(old.selectExpr("'prd.gone' AS product_id", "'gone' AS model_name", "'pending' AS review_status"))
    after = extraction.stage({"product": reviewed}, made)
    assert [(r.model_name, r.review_status) for r in after["product"].collect()] == [("old", "approved")]


def test_stored_classification_and_no_sections(spark, sections, families):
    stored = sections.selectExpr("section_id", "'other' AS type", "0.5D AS confidence")
    reached = extraction.run(sections, None, families, classified=stored)
    assert [t.count() for t in reached.extracted.tables.values()] == [0, 0, 0, 0, 0]
