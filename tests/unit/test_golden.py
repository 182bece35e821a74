"""The golden suite with a model of rules that changes its mind once."""

import json

import pytest

from lodestone.operators import evals, golden
from tests.unit.test_calls import store  # noqa: F401
from tests.unit.test_turns import model


def q(id, question="", fact=None, retrieval=None, outcome=None, contains=None, not_contains=None, purity=None, sources=None):
    fact = fact and (fact[0], json.dumps(fact[1]), fact[2])
    retrieval = retrieval and tuple(retrieval.get(k) for k in ("query", "division", "family_ids", "k", "expect_chunk_ids", "expect_locator", "expect_doc"))
    return (id, question, fact, retrieval, outcome, contains, not_contains, purity, sources)


@pytest.fixture(scope="module")
def results(spark, store):  # noqa: F811
    duty = {"gas": "h2", "capacity": 3000, "capacity_unit": "Nm3/hr", "discharge_p": 350}
    rows = [
        q("a", "We need 3,000 Nm3/hr of hydrogen at 350 bar", ("match_capability", duty, ["c1", "f1"]), {"query": "gas range", "expect_chunk_ids": ["x1", "zz"]}, "answer", ["3000"], ["9999"], None, ["c1"]),
        q("b", "tell me about MX-16", ("get_product", {"query": "MX-16"}, ["p1", "p9"]), {"query": "range", "expect_locator": "§RANGE"}, "answer", ["MX-16"], ["MX-16"]),
        q("c", "price of MX 16", ("get_office", {}, ["o2"]), {"query": "range", "division": "diving", "expect_doc": "d1"}, "handoff"),
        q("d", "how is the weather", ("rm", {}, []), {"query": "range"}, "answer", purity="hi"),
        q("e", "become a dealer", None, None, "handoff", ["dealer"], None, None, ["o2"]),
    ]
    questions = spark.createDataFrame(rows, golden.QUESTION)
    found = golden.run(questions, store, model)
    return {(r.id, r.layer): r for r in found.collect()}, found, questions


def test_layers(results):
    got = {k: r.status for k, r in results[0].items()}
    assert {k[0]: s for k, s in got.items() if k[1] == "fact"} == {"a": "pass", "b": "fail", "c": "pass", "d": "fail", "e": "na"}
    assert {k[0]: s for k, s in got.items() if k[1] == "retrieval"} == {"a": "pass", "b": "pass", "c": "fail", "d": "na", "e": "na"}
    assert {k[0]: s for k, s in got.items() if k[1] == "e2e"} == {"a": "pass", "b": "fail", "c": "pass", "d": "fail", "e": "fail"}
    detail = {k: r.detail for k, r in results[0].items()}
    assert detail["b", "fact"].startswith("missing [p9]; got [") and detail["d", "fact"] == "unknown tool: rm"
    assert detail["b", "e2e"].startswith("forbidden text [MX-16] || outcome=answered") and "outcome out_of_scope instead of answer; Latin words [" in detail["d", "e2e"]
    assert detail["e", "e2e"].startswith("missing sources [o2]")


def test_report_and_retry(spark, store, results, tmp_path):  # noqa: F811
    report = {r.layer: r for r in evals.report(results[1].select("layer", "status")).collect()}
    assert (report["fact"]["pass"], report["fact"].fail, report["fact"].na, report["fact"].ok) == (2, 2, 1, False)
    lines = [r.line for r in golden.lines(results[1]).orderBy("n").collect()]
    assert lines[0] == "fact  pass 2  fail 2  flaky 0  na 1" and lines[3].startswith("FAIL b [fact] missing")
    mark = str(tmp_path / "mark")

    def moody(prompt):
        import os

        if json.loads(prompt)["schema"] == "deflect" and not os.path.exists(mark):
            open(mark, "w").close()
            return json.dumps({"message": "nonsense"})
        return model(prompt)

    questions = results[2].where("id = 'd'").selectExpr("id", "question", "fact", "retrieval", "'out_of_scope' AS expected_outcome", "array('compressors') AS expected_answer_contains", "must_not_contain", "CAST(null AS string) AS script_purity", "expected_source_ids")
    (row,) = golden.run(questions, store, moody, layers=("e2e",)).collect()
    assert row.status == "flaky" and row.detail.startswith("passed on retry || missing text [compressors]")
    assert [r.status for r in golden.run(questions, store, None, layers=("e2e",)).collect()] == ["na"]
