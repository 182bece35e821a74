from pyspark.sql import functions as F

from lodestone.operators import dialog, evals, evidence, release


def test_gated_activation(spark):
    releases = spark.createDataFrame([("r1", True), ("r2", False)], "release_id string, is_active boolean")
    good = spark.createDataFrame([("fact", True)], "layer string, ok boolean")
    bad = spark.createDataFrame([("fact", True), ("e2e", False)], "layer string, ok boolean")
    state = lambda rep: {r.release_id for r in release.activate_if(releases, "r2", rep).collect() if r.is_active}
    assert state(good) == {"r2"} and state(bad) == {"r1"}
    ledger = spark.createDataFrame([("r2024.05.9",), ("r2024.05.10",), ("r2024.04.3",)], "release_id string")
    assert release.release_id(ledger, 2024, 5).first().release_id == "r2024.05.11"
    assert release.release_id(ledger, 2024, 6).first().release_id == "r2024.06.1"
    rows = spark.createDataFrame([("a", "open"), ("b", "imported")], "id string, status string")
    assert [release.promotable(rows, x).first().error for x in "abc"] == ["not to be promoted: open", None, "no such candidate"]
    log = spark.createDataFrame([("k", 1, 1), ("k", 2, 2)], "id string, v int, updated_at int")
    assert release.current(log, ["id"]).first().v == 2


def test_duty_and_answers(spark):
    t = spark.createDataFrame([("need 3,000 Nm3/hr at 350 bar", 3000.0, "x"), ("make it 500", 500.0, "Nm3/hr")], "text string, capacity double, capacity_unit string")
    got = t.select(dialog.duty_slots(F.col("text")).alias("s"), dialog.states_full_duty(F.col("text")).alias("full")).collect()
    assert (got[0].s.capacity, got[0].s.discharge_p, got[0].full, got[1].full) == (3000.0, 350.0, True, False)
    assert [r.capacity_unit for r in dialog.unit_of_new_capacity(t).collect()] == ["x", None]
    m = spark.createDataFrame([("s", "t", 1, 0, "user", "text", "q", None), ("s", "t", 1, 1, "assistant", "text", "a", None), ("s", "t", 1, 2, "assistant", "document_card", None, '{"title":"Doc"}')], "session_id string, turn_id string, seq int, seq_in_turn int, role string, kind string, text string, payload string")
    assert dialog.answer_text(m).first().answer == "a Doc" and dialog.user_texts(m).first().texts == ["q"]
    hits = spark.createDataFrame([("t", i, f"d{i % 5}", "", f"http://x/my-doc{i}.pdf") for i in range(8)], "turn_id string, rank int, doc_id string, title string, url string")
    assert [r.title for r in dialog.cards(hits).orderBy("rank").collect()] == ["my-doc0", "my-doc1", "my-doc2"]


def test_golden_score(spark):
    q = spark.createDataFrame([("q1", ["a"], ["c1"], None, None, "answer", ["25000"], ["no"]), ("q2", None, None, None, None, "answer", None, None)], "id string, expected_ids array<string>, chunk_ids array<string>, locator string, doc string, outcome string, contains array<string>, must_not array<string>")
    f = spark.createDataFrame([("q1", ["a"])], "id string, found array<string>")
    r = spark.createDataFrame([("q1", [("c1", "p1", "d")])], "id string, chunks array<struct<chunk_id string, locator string, doc_id string>>")
    a = spark.createDataFrame([("q1", 1, "answer", "wrong"), ("q1", 2, "answer", "25,000 bar")], "id string, attempt int, outcome string, text string")
    got = {(x.id, x.layer): x.status for x in evals.score(q, f, r, a).collect()}
    assert got == {("q1", "fact"): "pass", ("q1", "retrieval"): "pass", ("q1", "e2e"): "flaky", ("q2", "fact"): "na", ("q2", "retrieval"): "na", ("q2", "e2e"): "na"}
    s = spark.createDataFrame([("9 bar", [9.0]), ("8 bar", [9.0])], "t string, a array<double>")
    assert [x.g for x in s.select(evals.handoff_guard(F.col("t"), F.col("a")).alias("g")).collect()] == [True, False]
    u = spark.createDataFrame([('{"a":{"c":0},"b":7}',)], "u string").select(evidence.cached_tokens(F.col("u"), "$.a.c", "$.b").alias("n"))
    assert u.first().n == 7
