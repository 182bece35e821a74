import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import documents
from lodestone.sources import readers, sinks
from lodestone.streaming import sessions

YAML = """
# sources
pages:
  - https://x.org/a.html
  - "https://x.org/b.html"
pdfs:
  - https://x.org/c.pdf
exclude:
  - https://x.org/b.html
families:
  - family_id: f1
    name: 'It''s one'
    standards: ["API-618", "ISO"]
  - family_id: f2
"""


def test_lists(spark):
    assert [(r.url, r.kind) for r in readers.source_list(spark, YAML).orderBy("position").collect()] == [("https://x.org/a.html", "html"), ("https://x.org/c.pdf", "pdf")]
    rows = readers.dimension(spark, YAML, "families", "family_id string, name string, standards array<string>").collect()
    assert [tuple(r) for r in rows] == [("f1", "It's one", ["API-618", "ISO"]), ("f2", None, None)]


def test_markdown_files(spark, tmp_path):
    made = spark.createDataFrame([("<!-- page 1 -->\n# A\nx\n<!-- page 3 -->\ny", "https://x.org/S-1.pdf")], "b string, u string")
    text = made.select(documents.render(F.col("b"), url=F.col("u"), kind=F.lit("pdf")).alias("md")).first().md
    (tmp_path / "1.md").write_text(text)
    r = readers.markdown(spark, str(tmp_path)).first()
    assert (r.doc_id, r.page_count, r.kind) == ("doc.s_1", 3, "pdf")
    s = readers.corpus_sections(spark, str(tmp_path)).first()
    assert (s.page_start, s.page_end, s.text) == (1, 3, "x\ny")


def test_other_scans(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    assert readers.raw_bytes(spark, str(tmp_path)).first().sha256.startswith("ba7816bf")
    (tmp_path / "m.json").write_text(json.dumps([{"url": "u", "sha256": "s"}]))
    assert readers.manifest(spark, str(tmp_path / "m.json")).first().sha256 == "s"
    pages = spark.createDataFrame([("d", 2, "x" * 60, None), ("d", 1, "few", "ocr text")], "doc_id string, page int, text string, ocr string")
    assert readers.pdf_pages(pages).first().body == "<!-- page 1 -->\n\nocr text\n\n<!-- page 2 -->\n\n" + "x" * 60


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "sha256 string, v int")
    assert sinks.append_new(rows, str(tmp_path / "t")) == 2 and sinks.append_new(rows, str(tmp_path / "t")) == 0
    for rel, v in (("r1", 1), ("r2", 2), ("r1", 3)):
        sinks.replace_release(spark.createDataFrame([(v, rel)], "v int, release_id string"), str(tmp_path / "rel"))
    assert {(r.release_id, r.v) for r in spark.read.parquet(str(tmp_path / "rel")).collect()} == {("r1", 3), ("r2", 2)}
    staged = spark.createDataFrame([("c", ["x", "y"], '{"id":"seen"}')], "id string, tags array<string>, evidence string")
    sinks.write_sheet(sinks.review_rows(staged, ["id", "tags"]), str(tmp_path / "sheet"))
    back = readers.review_sheet(spark, str(tmp_path / "sheet"), ["id", "»id", "tags", "»tags", "decision"]).first()
    assert (back["id"], back["»id"], back["tags"]) == ("c", "seen", "x, y")


def test_stream(spark, tmp_path):
    schema = "session_id string, seq bigint, ts timestamp, role string, gas string, capacity double, full boolean"
    rows = [("s", 1, "2024-01-01 00:00:00", "user", "h2", 5.0, False), ("s", 2, "2024-01-01 00:01:00", "user", None, None, False), ("s", 3, "2024-01-01 00:02:00", "user", None, 7.0, True)]
    spark.createDataFrame(rows, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = sessions.carry_forward(stream).writeStream.format("memory").queryName("slots").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.seq, r.gas, r.capacity) for r in spark.table("slots").collect()}
    assert got == {(1, "h2", 5.0), (2, "h2", 5.0), (3, None, 7.0)}


GOLDEN = """
questions:
  - id: a
    question: "Which office covers Delhi?"
    fact:
      tool: get_office
      args:
        city: Delhi
      expect_ids: ["o1"]
    expected_outcome: answer
    expected_answer_contains:
      - Delhi
  - id: b
    question: hello
    retrieval:
      query: range
      k: 3
      expect_doc: d1
"""


def test_golden_questions_and_prompts(spark, tmp_path):
    from lodestone.operators import golden

    rows = {r.id: r for r in readers.questions(spark, GOLDEN, golden.QUESTION).collect()}
    assert (rows["a"].fact.tool, rows["a"].fact.args, rows["a"].fact.expect_ids, rows["a"].expected_answer_contains, rows["a"].retrieval) == ("get_office", '{"city": "Delhi"}', ["o1"], ["Delhi"], None)
    assert (rows["b"].retrieval.k, rows["b"].retrieval.expect_doc, rows["b"].fact) == (3, "d1", None)
    for name, text in (("triage.md", "new"), ("triage.txt", "old"), ("faq.txt", "faq"), ("notes.log", "no")):
        (tmp_path / name).write_text(text)
    assert {r.agent: r.body for r in readers.prompts(spark, str(tmp_path)).collect()} == {"triage": "new", "faq": "faq"}


def test_records_witnesses_lists_and_sessions(spark):
    assert readers.only_client(["x"]) == "x"
    with pytest.raises(ValueError):
        readers.only_client(["x", "y"])
    raw = spark.createDataFrame([("s1", b"text"), ("s2", b"\xff")], "sha256 string, content binary")
    assert {r.sha256: r.witness for r in readers.witnesses(raw, lambda content: content.decode()).collect()} == {"s1": "text", "s2": None}
    fams = spark.createDataFrame([("b", "Böoster: big", None, ["x"]), ("a", None, 2, None)], "id string, name string, n int, standards array<string>")
    text = sinks.as_yaml(fams, "families", "id")
    assert readers.simple_yaml(text) == {"families": [{"id": "a", "n": 2}, {"id": "b", "name": "Böoster: big", "standards": ["x"]}]}
    created = spark.createDataFrame([("s1", 1), ("s2", 5)], "session_id string, created_at int")
    touched = spark.createDataFrame([("s1", 3), ("s1", 2)], "session_id string, at int")
    assert {r.session_id: r.last_at for r in sinks.sessions(created, touched).collect()} == {"s1": 3, "s2": 5}
