"""Tools for tables of calls against the tools for one call, and against brute force."""

import json
import random

import numpy as np
import pytest

from lodestone.operators import calls, capability, products, search

CAPS = "cap_id string, family_id string, capacity_min double, capacity_max double, capacity_unit string, discharge_p_min double, discharge_p_max double, pressure_unit string, lubricated boolean, standards array<string>, source_doc_id string, source_locator string"


@pytest.fixture(scope="module")
def store(spark):
    caps = [
        ("c1", "f1", 100.0, 5000.0, "Nm3/hr", None, 400.0, "barg", False, ["API-618"], "d1", "p3 §Range"),
        ("c2", "f2", None, 3000.0, "nm3/h", None, 360.0, "bar", None, [], "d1", None),
        ("c3", "f3", None, 90000.0, "SCMD", None, 500.0, "barg", True, None, "d2", "§Gas"),
        ("c4", "f1", None, 100.0, "cfm", None, 900.0, "barg", None, ["API-618"], "d2", None),
        ("c5", "f2", None, 10.0, "Nm3/hr", None, 900.0, "barg", None, [], "d2", None),
    ]
    frame = spark.createDataFrame
    return calls.Store(
        capabilities=frame(caps, CAPS),
        families=frame([("f1", "Process Gas", "industrial", "gas"), ("f2", "Breathing Air", "diving", "air"), ("f3", "Gas Booster", "industrial", "gas"), ("f4", "Fire Pump", "fire_rescue", None)], "family_id string, name string, division string, category string"),
        gases=frame([("c1", "Hydrogen"), ("c2", " H2 "), ("c3", "hydrogen"), ("c4", "H2"), ("c5", "h2"), ("c5", "Air")], "cap_id string, gas string"),
        products=frame([("p1", "f2", "MX-16", "compact", "d1"), ("p2", "f2", "MX-16/25", None, "d1"), ("p3", "f3", "GB 7", "MX 16 kit", "d2"), ("p4", "f2", "ABC", None, "d2")], "product_id string, family_id string, model_name string, variant string, source_doc_id string"),
        facts=frame([("k1", "founded", "since 1963", "d1", "§About"), ("k2", "client", "Acme", "d1", None), ("k3", "founded", "by makers", "d2", None)], "fact_id string, kind string, value string, source_doc_id string, source_locator string"),
        offices=frame([("o1", "North branch", "Delhi", "North"), ("o2", "Head office", "Noida", "North"), ("o3", "West branch", "Pune", "West")], "office_id string, name string, city string, region string"),
        states=frame([("Goa", "o3"), ("Punjab", "o1")], "state string, office_id string"),
        chunks=frame([("x1", "d1", "§Range", "gas booster range with gas valves", [1.0, 0.0], ["f1", "f3"]), ("x2", "d2", "p2", "breathing air range", [0.0, 1.0], ["f2"]), ("x3", "d9", None, "gas range", [1.0, 1.0], None), ("x4", "d1", None, None, [0.0, 0.0], ["f1"])], "chunk_id string, doc_id string, locator string, content string, embedding array<double>, family_ids array<string>"),
        documents=frame([("d1", "Range", "https://x.org/range.pdf"), ("d2", None, "https://x.org/air.html")], "doc_id string, title string, url string"),
        aliases={"h2": "hydrogen"},
    )


DUTIES = [("a", "H2", 3000.0, "Nm3/hr", 350.0, None, None), ("b", "hydrogen", 3000.0, "nm3/h", 350.0, True, None), ("c", "h2", 3000.0, "Nm3/hr", 350.0, None, "API-618"), ("d", "air", 5.0, "Nm3/hr", 1.0, False, "NFPA"), ("e", "h2", 3000.0, "Nm3/hr", 350.0, None, None), ("f", "h2", 3000.0, "buckets", 350.0, None, None), ("g", "argon", 1.0, "cfm", 1.0, None, None), ("h", None, None, "cfm", None, None, None)]


@pytest.mark.parametrize("relax", [True, False])
def test_match_calls_as_one_by_one(spark, store, relax):
    asked = spark.createDataFrame(DUTIES, "call_id string, gas string, capacity double, capacity_unit string, discharge_p double, lubricated boolean, standard string")
    got = calls.match_calls(asked, store.capabilities, store.families, store.gases, store.aliases, relax).collect()
    for call, gas, capacity, unit, pressure, lubricated, standard in DUTIES[:5]:
        one = capability.match(store.capabilities, store.families, store.gases, gas, capacity, unit, pressure, store.aliases, lubricated, standard, relax)
        own = [r for r in got if r.call_id == call]
        assert sorted((r.cap_id, r.status, r.reason, r.relaxed, r.near_edge, r.converted_capacity) for r in own) == sorted((r.cap_id, r.status, r.reason, r.relaxed, r.near_edge, r.converted_capacity) for r in one.collect())
        assert [r.cap_id for r in sorted((r for r in own if r.rank), key=lambda r: r.rank)] == [r.cap_id for r in capability.rank(one).collect()]
    assert {r.call_id for r in got} <= set("abcde")


QUERIES = ["MX 16", "mx16", "breathing AIR", "f4", "gas", "the compact gas kit", "nothing here", "GB-7", "fire", "", None, "MX 16"]


def test_resolve_calls_as_one_by_one(spark, store):
    asked = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(QUERIES)], "call_id string, query string")
    got = calls.resolve_calls(asked, store.families, store.products).collect()
    for i, q in enumerate(QUERIES[:10]):
        one = sorted((r.tier, r.matched_by, r.family_id, r.product_id or "", r.position) for r in products.resolve(store.families, store.products, q).collect())
        assert sorted((r.tier, r.matched_by, r.family_id, r.product_id or "", r.position) for r in got if r.call_id == f"q{i}") == one, q
    assert [r for r in got if r.call_id == "q10"] == []
    assert sorted(r[1:] for r in got if r.call_id == "q0") == sorted(r[1:] for r in got if r.call_id == "q11")


def test_nearest_as_brute_force(spark):
    rnd = np.random.default_rng(3)
    vectors = rnd.integers(-2, 3, (300, 4)).astype(float)
    families = [random.Random(i).choice([None, ["a"], ["b"], ["a", "c"]]) for i in range(300)]
    rows = [(i, [float(x) for x in v], f) for i, (v, f) in enumerate(zip(vectors, families))] + [(300, None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, family_ids array<string>").repartition(5)
    asked = [(f"q{i}", [float(x) for x in rnd.integers(-2, 3, 4)], [None, ["a"], ["b", "c"], []][i % 4]) for i in range(40)] + [("zero", [0.0] * 4, None), ("none", None, None)]
    got = calls.nearest(spark.createDataFrame(asked, "ask string, vector array<double>, family_ids array<string>"), chunks, k=7, block=16)
    want = []
    for ask, q, scope in asked:
        if q is None or not any(q):
            continue
        near = sorted((round(float(1 - np.dot(v, q) / (np.linalg.norm(v) * np.linalg.norm(q))), 7), i) for i, v, f in ((i, np.array(v), f) for i, v, f in rows[:300]) if v.any() and (scope is None or set(f or ()) & set(scope)))
        want += [(ask, i, d, n) for n, (d, i) in enumerate(near[:7], 1)]
    assert sorted((r.ask, r.chunk_id, round(r.distance, 7), r.rank) for r in got.collect()) == sorted(want)


def test_holding_as_one_by_one(spark):
    rnd = random.Random(4)
    words = ["gas", "air", "pump", "the", "valve", "seal", "x1"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 3, 9, 30])))) for i in range(150)]
    chunks = spark.createDataFrame([(i, t, [0.0], None) for i, t in rows], "chunk_id long, content string, embedding array<double>, family_ids array<string>")
    queries = ["gas", "gas valve", "the", "pump seal x1 air", "gas missing", ""]
    asked = spark.createDataFrame([(q, q, None) for q in queries], "ask string, query string, family_ids array<string>")
    got = calls.holding(asked, chunks, k=9).collect()
    for q in queries:
        want = [(r.chunk_id, round(r.score, 9), r.rank) for r in search.text_arm(chunks, q, 9).collect()] if q else []
        assert sorted((r.chunk_id, round(r.score, 9), r.rank) for r in got if r.ask == q) == sorted(want), q


def test_run_gives_results_of_all_tools(spark, store):
    asked = [
        ("1", "match_capability", {"gas": "h2", "capacity": 3000, "capacity_unit": "Nm3/hr", "discharge_p": 350}),
        ("2", "match_capability", {"gas": "h2", "capacity": 3000, "capacity_unit": "buckets", "discharge_p": 350}),
        ("3", "get_product", {"query": "breathing air"}),
        ("4", "get_product", {"query": "gas"}),
        ("5", "get_product", {"query": "Process-Gas"}),
        ("6", "search_documents", {"query": "gas range", "vector": [1.0, 0.1], "k": 2}),
        ("7", "search_documents", {"query": "range", "division": "diving", "k": 5}),
        ("8", "list_products", {"division": "industrial"}),
        ("9", "get_office", {"state": "goa"}),
        ("10", "get_office", {}),
        ("11", "get_company_fact", {"kind": "founded"}),
        ("12", "rm", {}),
        ("13", "get_product", {"query": "nothing"}),
    ]
    rows = spark.createDataFrame([(i, t, json.dumps(a)) for i, t, a in asked], "call_id string, tool string, args string")
    got = {r.call_id: (json.loads(r.result) if r.result else None, r.rows_returned, r.error) for r in calls.run(rows, store).collect()}
    assert [m["cap_id"] for m in got["1"][0]["matches"]] == ["c2", "c1", "c3"] or [m["cap_id"] for m in got["1"][0]["matches"]] == ["c1", "c2", "c3"]
    assert got["1"][0]["any_near_edge"] is True and [c["cap_id"] for c in got["1"][0]["non_comparable_candidates"]] == ["c4"] and got["1"][1] == 3
    assert next(m for m in got["1"][0]["matches"] if m["cap_id"] == "c3")["converted_capacity"] == {"value": 72000.0, "unit": "SCMD"}
    assert got["2"][1:] == (0, "unknown capacity unit: buckets")
    assert [p["product_id"] for p in got["3"][0]["products"]] == ["p1", "p2", "p4"] and got["3"][0]["matched_by"] == "family"
    assert got["4"][0]["matched_by"] == "ambiguous" and got["4"][0]["candidates"] == ["Gas Booster", "Process Gas"]
    assert got["5"][0]["family"]["family_id"] == "f1" and [c["cap_id"] for c in got["5"][0]["capabilities"]] == ["c1", "c4"]
    assert [c["chunk_id"] for c in got["6"][0]["chunks"]] == ["x1"] and got["6"][0]["chunks"][0]["url"] == "https://x.org/range.pdf"
    assert [c["chunk_id"] for c in got["7"][0]["chunks"]] == ["x2"]
    assert [f["family_id"] for f in got["8"][0]["families"]] == ["f1", "f3"] and got["8"][0]["families"][1]["products"] == ["p3"]
    assert got["9"][0]["office"]["office_id"] == "o3" and got["10"][0]["office"] == {"office_id": "o2", "name": "Head office", "city": "Noida", "region": "North", "fallback": True}
    assert [f["fact_id"] for f in got["11"][0]["facts"]] == ["k1", "k3"]
    assert got["12"] == (None, None, "unknown tool: rm") and got["13"][1] == 0
    assert calls.run(rows.limit(0), store).count() == 0
