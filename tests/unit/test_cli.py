"""From a source list to an answered question, by the command line."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestone.__main__ import main
from lodestone.warehouse import Warehouse
from tests.unit.test_extraction import model as reader
from tests.unit.test_turns import model as speaker

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAGE = """<html><title>Range</title><body><nav><a href=x>Home</a></nav><p>intro words</p><h1>Gas range</h1>
<p>Oil-free reciprocating compressors, up to 20,000 Nm3/hr and 350 barg, for Hydrogen and Air, API-618.</p>
<h1>Models</h1><p>MX-16 compact unit; 300 bar rating</p><h1>About</h1><p>Founded in 1963 by makers</p><h1>Offices</h1><p>Delhi branch, 12 Main Road</p>
<p>FILL</p></body></html>""".replace("FILL", " ".join(f"word{i}" for i in range(60)))


def model(prompt):
    schema = json.loads(prompt)["schema"]
    return (reader if schema.startswith(("extract", "section", "family")) else speaker)(prompt)


def encode(texts):
    return [[float(len(t) % 7), 1.0] for t in texts]


def test_from_sources_to_answers(spark, tmp_path, capsys):
    root, me = str(tmp_path / "tables"), "tests.unit.test_cli"
    page = tmp_path / "range.html"
    page.write_text(PAGE)
    (tmp_path / "sources.yaml").write_text(f"pages:\n  - file://{page}\n  - file://{tmp_path}/gone.html\n")
    fams = str(tmp_path / "families.yaml")

    def run(*arguments):
        main(["--root", root, *arguments], spark)
        return capsys.readouterr().out

    assert run("release", "create", "--client", "x") == "rc.x.0001\n"
    said = run("ingest", "run", "--client", "x", "--candidate", "rc.x.0001", "--sources", str(tmp_path / "sources.yaml"))
    assert "written: 1" in said and "unreachable: file://" in said
    assert run("ingest", "verify").startswith("1 of 1 sources in order")
    proposed = run("extract", "run", "--candidate", "rc.x.0001", "--model", f"{me}:model")
    assert proposed.startswith('families:\n  - family_id: "gas"')
    (tmp_path / "families.yaml").write_text('families:\n  - family_id: gas\n    name: Gas compressors\n    division: industrial\n    source: "doc.range §Gas range"\n  - family_id: mx\n    name: MX units\n    division: diving\n    source: "doc.range §Models"\n')
    said = run("extract", "run", "--candidate", "rc.x.0001", "--model", f"{me}:model", "--families", fams)
    assert "capability_row: 2" in said and "product: 1" in said
    run("release", "export", "--candidate", "rc.x.0001", "--out", str(tmp_path / "out"))
    for table in ("document", "capability_row", "capability_gas", "product", "company_fact", "office"):
        sheet = spark.read.csv(str(tmp_path / "out" / table), header=True, multiLine=True, escape='"', quote='"')
        sound = F.col("needs_family") == "true" if "needs_family" in sheet.columns else F.lit(False)
        known = F.col("kind").isNull() if table == "company_fact" else F.lit(False)
        sheet.withColumn("decision", F.when(sound | known, "reject").otherwise("approve")).write.csv(str(tmp_path / "in" / table), header=True, escape='"', quote='"')
    counts = run("release", "import", "--candidate", "rc.x.0001", "--sheets", str(tmp_path / "in"), "--families", fams, "--reviewer", "me")
    assert '"table":"capability_row","approve":1,"edit":0,"reject":1,"blank":0' in counts and json.loads(run("release", "list").splitlines()[0])["status"] == "imported"
    (tmp_path / "regions.yaml").write_text('regions:\n  - state: Delhi\n    region: North\n    cities: ["Delhi"]\n')
    regions = str(tmp_path / "regions.yaml")
    assert run("release", "check", "--candidate", "rc.x.0001", "--families", fams, "--regions", regions).startswith("may be promoted")
    assert run("release", "diff", "--candidate", "rc.x.0001") == "new: 1\n"
    assert run("release", "promote", "--candidate", "rc.x.0001", "--families", fams, "--regions", regions, "--year", "2024", "--month", "5") == "r2024.05.1\n"
    with pytest.raises(ValueError, match="not to be promoted: promoted"):
        run("release", "promote", "--candidate", "rc.x.0001", "--families", fams)
    assert "chunk: 1" in run("release", "embed", "--release", "r2024.05.1", "--encoder", f"{me}:encode", "--dimension", "2")
    questions = tmp_path / "golden.yaml"
    questions.write_text('questions:\n  - id: a\n    question: "We need 3,000 Nm3/hr of hydrogen at 350 bar"\n    expected_outcome: answer\n    expected_answer_contains: ["Gas compressors"]\n    must_not_contain: ["Gas"]\n    fact:\n      tool: get_product\n      args:\n        query: MX-16\n      expect_ids: ["mx"]\n')
    gate = ("release", "activate", "--release", "r2024.05.1", "--questions", str(questions), "--model", f"{me}:model", "--encoder", f"{me}:encode", "--dimension", "2")
    with pytest.raises(SystemExit):
        run(*gate)
    assert Warehouse(spark, root).releases().where("is_active").isEmpty()
    questions.write_text(questions.read_text().replace('must_not_contain: ["Gas"]', "script_purity: null"))
    run(*gate)
    assert Warehouse(spark, root).active_id() == "r2024.05.1"
    assert "e2e  pass 1" in run("eval", "run", "--questions", str(questions), "--model", f"{me}:model", "--encoder", f"{me}:encode", "--dimension", "2")
    found = json.loads(run("tools", "match-capability", '{"gas": "hydrogen", "capacity": 3000, "capacity_unit": "Nm3/hr", "discharge_p": 350}'))
    assert [m["family_id"] for m in found["matches"]] == ["gas"]
    assert json.loads(run("tools", "get-office", '{"city": "delhi"}'))["office"]["city"] == "Delhi"
    assert "Gas compressors" in run("chat", "We need 3,000 Nm3/hr of hydrogen at 350 bar", "--session", "s1", "--model", f"{me}:model")
    run("chat", "how is the weather", "--session", "s1", "--model", f"{me}:model")
    logged = spark.read.parquet(f"{root}/ops/turn").orderBy("seq").collect()
    assert [(t.turn_id, t.outcome) for t in logged] == [("s1:1", "answered"), ("s1:2", "declined_oos")]
