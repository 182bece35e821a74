"""A release's index, and reports as lines."""

import pytest

from lodestone.operators import documents, evidence, indexing, release, reports

PARA = " ".join(f"word{i}" for i in range(30))


def lines(df):
    return [r.line for r in df.orderBy("n").collect()]


def test_release_index(spark, tmp_path):
    body = f"# Gas Booster\n{PARA}\n\nmore about it " + " ".join(["x"] * 50)
    docs = spark.createDataFrame([("doc.a", "html", body, "industrial"), ("doc.b", "pdf", f"# Other\n{PARA}\n\n" + " ".join(["y"] * 50), None), ("doc.c", "html", "tiny", None)], "doc_id string, kind string, body string, division string")
    families = spark.createDataFrame([("f1", "Gas Booster", "industrial")], "family_id string, name string, division string")
    cover = spark.createDataFrame([("doc.b", "Other", "f1")], "doc string, heading string, family_id string")
    made = indexing.release_index(docs, families, cover, "r2024.01.1", str(tmp_path), lambda texts: [[float(len(t)), 1.0] for t in texts], 2)
    stored = {r.chunk_id: r for r in spark.read.parquet(f"{tmp_path}/chunks").collect()}
    assert sorted(stored) == ["ch.a.0000", "ch.b.0000"] and stored["ch.b.0000"].family_ids == ["f1"] and stored["ch.a.0000"].release_id == "r2024.01.1"
    assert PARA not in stored["ch.a.0000"].content and PARA in stored["ch.b.0000"].content
    assert made.vectors.endswith("chunk_embedding_r2024_01_1") and spark.read.parquet(made.vectors).count() == 2
    blocks = spark.createDataFrame([("doc.a", "html", PARA), ("doc.b", "pdf", PARA)], "doc string, kind string, text string")
    report = lines(indexing.lines(made, documents.paragraph_owners(blocks)))
    assert report[:3] == ["chunk: 2", "excluded: 1", "chunks: 2"] and report[3].startswith("largest: ch.") and report[4].endswith("— kept in doc.b")


def test_index_without_a_vector_writes_nothing(spark, tmp_path):
    docs = spark.createDataFrame([("doc.a", "html", PARA * 2, None)], "doc_id string, kind string, body string, division string")
    families = spark.createDataFrame([], "family_id string, name string, division string")
    cover = spark.createDataFrame([], "doc string, heading string, family_id string")
    with pytest.raises(Exception, match="wrong count or dimension"):
        indexing.release_index(docs, families, cover, "r1", str(tmp_path / "none"), lambda texts: [[1.0]] * len(texts), 2)
    assert not (tmp_path / "none").exists()


def test_report_lines(spark):
    found = spark.createDataFrame([("hard", "product", "p1", "needs a family"), ("warning", "family", "f1", "unused")], "severity string, table string, key string, message string")
    assert lines(reports.check_lines(found)) == ["must not be promoted: 1 failures, 1 warnings", "FAIL product p1: needs a family", "warn family f1: unused"]
    assert lines(reports.check_lines(found.limit(0))) == ["may be promoted: 0 failures, 0 warnings"]
    before, after = (spark.createDataFrame(rows, "id string, v double") for rows in ([("a", 1.0), ("b", 2.0)], [("a", 3.0), ("c", None)]))
    assert lines(reports.diff_lines(release.diff(before, after, "id", ["v"]), "id")) == ["changed: 1", "new: 1", "superseded: 1", 'changed a: {"v":1.0} -> {"v":3.0}']
    verified = spark.createDataFrame([("u1", True, [], [], None), ("u2", False, ["a", "b", "c"], ["read_more_stub"], None), ("u3", False, [], [], "not in manifest")], "url string, ok boolean, missing array<string>, junk array<string>, note string")
    assert lines(reports.verify_lines(verified, 2)) == ["1 of 3 sources in order", "FAIL u2: missing a, b and 1 more; junk read_more_stub", "FAIL u3: not in manifest"]
    calls = spark.createDataFrame([(10, 5, 2, False)], "tokens_in int, tokens_out int, tokens_cached int, skipped boolean")
    assert lines(reports.usage_lines(evidence.usage(calls)))[1:] == ["tokens in 10, out 5, cached 2 (20 %)", "cost n/a"]
