"""Findings of round 3, each on tables small enough to see what goes wrong."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.functions import text
from lodestone.operators import calls, dialog, documents, grounding, html, turns
from tests.test_oracles import TABLES, rows
from tests.unit.test_calls import store  # noqa: F401
from tests.unit.test_turns import run


@pytest.fixture()
def folder(sf, tmp_path):
    """A function: the test tables with some of them replaced by what SQL over them gives; the folder and DuckDB views of it."""

    def make(**changed):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW given_{t} AS SELECT * FROM '{sf}/{t}.parquet'")
            target = f"{tmp_path}/{t}.parquet"
            if t in changed:
                con.execute(f"COPY ({changed[t]}) TO '{target}' (FORMAT parquet)")
            else:
                os.symlink(f"{sf}/{t}.parquet", target)
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{target}'")
        return str(tmp_path), con

    return make


def same(spark, made, name):
    got = entry.queries()[name](spark, made[0]).toPandas()
    want = made[1].execute(entry.oracle_sql()[name]).df()
    assert len(want) and rows(got) == rows(want)


def test_least_office_by_number(spark, folder):
    """of offices 9 and 10 in one city, 9 is the least; as text it was 10."""
    same(spark, folder(supplier="SELECT * REPLACE (7 AS s_nationkey, s_suppkey + 5 AS s_suppkey) FROM given_supplier WHERE s_suppkey IN (4, 5)", customer="SELECT * REPLACE (7 AS c_nationkey) FROM given_customer LIMIT 40"), "e01_golden_facts")


def test_answers_counted_once_for_each_question(spark):
    """aggregates of equal calls meet the calls as one row, not as the rows that they count."""
    asked = spark.range(400).selectExpr("id AS call_id", "'a' AS kind", "'Family x' AS query", "'d' AS division", "CAST(null AS string) AS category")
    facts = spark.range(300).selectExpr("id AS fact_id", "'a' AS kind")
    families = spark.createDataFrame([("x", "Family x", "d", "c")], "family_id string, name string, division string, category string")
    products = spark.range(300).selectExpr("'x' AS family_id", "id AS product_id", "'m' AS model_name", "CAST(null AS string) AS variant")
    n, first = F.count("*").alias("n"), F.min("product_id").alias("first")
    for listed, counted in (
        (calls.fact_calls(asked, facts), calls.fact_calls(asked, facts, told=(n,))),
        (calls.resolve_calls(asked, families, products), calls.resolve_calls(asked, families, products, told=(n, first))),
    ):
        own = (n,) if "fact_id" in listed.columns else (n, first)
        assert sorted(counted.collect()) == sorted(listed.groupBy("call_id").agg(*own).collect()) and counted.count() == 400
        assert most_rows(counted) <= 1200
    (row,) = calls.list_calls(asked, families, products, told=(n, F.sum(F.size("products")).alias("first"))).drop("call_id").distinct().collect()
    assert tuple(row) == (1, 300)


def most_rows(df):
    """The largest number of rows that a step of the finished plan gave."""
    df = df.select("*")  # a plan of its own, as counts add up over runs
    df.collect()
    most, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        plan = left.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            left.append(plan.executedPlan())
        if "QueryStage" in plan.nodeName():
            left.append(plan.plan())
        metric = plan.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        left += [plan.children().apply(i) for i in range(plan.children().size())]
    return most


@pytest.mark.parametrize("relax", [True, False])
def test_matches_counted_as_listed(spark, relax):
    """F8: counts and best fit of equal envelopes are those of the list; rows with equal limits are met once."""
    k = F.col("id")
    caps = spark.range(1200).select(
        k.alias("cap_id"), F.lit("f").alias("family_id"), F.when(k % 5 == 1, "SCMD").when(k % 5 == 2, "cfm").otherwise("Nm3/hr").alias("capacity_unit"), F.lit(None).cast("double").alias("capacity_min"), (k % 3 * 1000 + 500.0).alias("capacity_max"),
        F.lit(None).cast("double").alias("discharge_p_min"), F.lit(400.0).alias("discharge_p_max"), F.lit("barg").alias("pressure_unit"), F.when(k % 2 == 0, True).alias("lubricated"), F.array(F.lit("A")).alias("standards"),
    ).localCheckpoint()
    families, gases = spark.createDataFrame([("f", "F")], "family_id string, name string"), caps.select("cap_id", F.lit("h2").alias("gas"))
    duty = "call_id string, gas string, capacity double, capacity_unit string, discharge_p double, lubricated boolean, standard string"
    asked = spark.createDataFrame([("a", "h2", 900.0, "Nm3/hr", 350.0, None, None), ("b", "h2", 900.0, "Nm3/hr", 100.0, False, "B"), ("c", "h2", 10.0, "cfm", 390.0, True, "A"), ("d", "h2", 10.0, "cfm", 900.0, None, None)], duty)
    listed = calls.match_calls(asked, caps, families, gases, {}, relax).groupBy("call_id").agg(
        F.count_if(F.col("status") == "match"), F.count_if(F.col("status") == "candidate"), F.bool_or("relaxed"), F.max(F.when(F.col("rank") == 1, F.col("cap_id")))
    )
    counted = calls.match_counts(asked, caps, families, gases, {}, relax)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, listed.collect()))
    assert most_rows(counted) <= 1200 < most_rows(listed)


def test_long_paragraph_is_chunked_whole(spark):
    """a line of more words than a chunk may hold stopped the query; now it is split between words and none is lost."""
    words = [f"w{i}" for i in range(9000)]
    parts = spark.createDataFrame([("a", 0, ["H"], "§H", "one two\n\n" + " ".join(words) + "\n\nlast"), ("b", 0, ["H"], "§H", " ".join(words[:8190]))], "doc string, position int, heading_path array<string>, locator string, text string")
    got = documents.chunks(parts).orderBy("chunk_id").collect()
    own = [r.content.split() for r in got if r.doc == "a"]
    tails = [0, 2] + [60] * (len(own) - 2)
    assert [w for chunk, n in zip(own, tails, strict=True) for w in chunk[n:]] == ["one", "two", *words, "last"]
    assert max(map(len, own)) == 660
    assert [r.token_count for r in got if r.doc == "b"] == [8191]  # under the limit: as before


def test_citations_of_a_call_need_no_sort(spark):
    """repeats within a call are dropped in its row, at their first places; nothing is sorted or grouped after the results are unfolded."""
    result = '{"products":[{"product_id":"p1","family_id":"f1"},{"product_id":"p2","family_id":"f1","source_doc_id":"d"},{"product_id":"p1","family_id":""}]}'
    made = spark.createDataFrame([("a", 1, "list_products", result, ""), ("a", 2, "list_products", result, ""), ("b", 1, "list_products", "{}", "")], "answer_id string, position int, tool string, result string, answer string")
    found = grounding.derive_citations(made)
    own = [(0, "product", "p1"), (1, "family", "f1"), (2, "product", "p2"), (4, "document", "d")]
    assert sorted((r.answer_id, r.position, r.i, r.kind, r.ref_id) for r in found.collect()) == [("a", n, *x) for n in (1, 2) for x in own]
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_texts_go_along_to_few_names(spark, monkeypatch):
    """with few names, texts aren't joined back by id, and the names are those of the way for many."""
    texts = spark.createDataFrame([(1, "the abcd and bcde"), (2, "abcx de"), (3, None), (4, "xyabcdef")], "id int, low string")
    names = spark.createDataFrame([("abcd",), ("ABCDEF",), ("bcdz",), ("de",), ("",), (None,)], "name string")
    few = dialog.containing(texts, "id", "low", names, "name")
    monkeypatch.setattr(dialog, "HEADS", 1)
    many = dialog.containing(texts, "id", "low", names, "name")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == [(1, "abcd"), (1, "de"), (2, "de"), (4, "ABCDEF"), (4, "abcd"), (4, "de")]
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("(id#")
    assert joins(few) == 0 < joins(many)


def test_pages_of_a_batch_are_taken_in_slices(spark):
    """a batch is read in slices of PAGES pages; none is lost or doubled where slices meet."""
    n = 2 * html.PAGES + 1
    pages = spark.range(n).coalesce(1).selectExpr("id AS page_id", "'u' AS url", "concat('<p>', id, '</p>') AS html")
    got = html.to_markdown(pages).collect()
    assert sorted((r.page_id, r.markdown) for r in got) == [(i, str(i)) for i in range(n)]


def test_equal_questions_of_turns_have_one_result(spark, store, monkeypatch):  # noqa: F811
    """turns that ask the same are looked up once, and share one result and one context; each still has its own call, draft and log."""
    said = ["We need 3,000 Nm3/hr of hydrogen at 350 bar"] * 70 + ["3,000 Nm3/hr hydrogen at 350 bar invent"] * 2
    seen, real = [], calls.run
    monkeypatch.setattr(turns.calls, "run", lambda asked, tools: seen.append(asked.count()) or real(asked, tools))
    monkeypatch.setattr(turns, "SHARE", 16)
    r, logs, texts, used, cited = run(spark, store, said)
    assert seen == [1, 1]
    assert [logs[f"t{i}"].outcome for i in range(72)] == ["answered"] * 70 + ["fallback"] * 2
    assert {u[1] for calls_ in used.values() for u in calls_} == {"match_capability", "search_documents"} and r.tool_calls.where("result IS NOT NULL").count() == 144
    assert len({texts[f"t{i}", 1].text for i in range(70)}) == len({tuple(cited[f"t{i}"]) for i in range(70)}) == 1


def test_pairs_that_differ_are_dropped_before_sets_go_along(spark):
    """sets that share rare tokens but differ in many others aren't joined with their tokens; all pairs of the threshold stay."""
    pick = random.Random(4)
    sets = [frozenset(pick.sample([f"w{i}" for i in range(60)], 30)) for _ in range(400)]
    sets += [s - {min(s)} for s in sets[:40]] + [s - {max(s)} | {"x", "y"} for s in sets[:40]] + sets[:5]
    found = documents.similar_pairs(spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in enumerate(sets)], "doc_id int, text string"))
    close = {(i, j, len(a & b), len(a | b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) * 10 >= len(a | b) * 9}
    assert {tuple(r) for r in found.collect()} == close and len(close) > 80
    assert most_rows(found) <= sum(map(len, sets))


ODD = [
    ("<p>" + "<b>x</b><i></i> " * 400, "x " * 399 + "x"),
    ("<table><tr><td>a<table><tr><td>b</td><td>c<br> d</table></td><td><a href=/S.pdf>s\n t</a></td></tr></table>", "| abc d | [s t](http://h/S.pdf) |\n| --- | --- |\n| b | c d |"),
    ("<ul>no<li>one <a href=y.html>two</a><ul><li>deep</ul><li><li>three</ul>", "- one twodeep\n- three"),
    ("<p>lost<body>kept <title>t</title><div>own</div><h2>H <img alt=Image><img alt=view></h2></body><body><p>second", "kept\n\nt\n\nown\n\n## H view"),
    ("<nav><table><tr><td>gone</table></nav><a href=q>Read <b>more</b></a><a href=q>stays</a> tail", "stays\n\ntail"),
]


def test_pages_are_read_once(spark):
    """heads, titles and blocks of pages come from one reading, as rows of cells and not of nodes; odd pages come out as before."""
    pages = spark.createDataFrame([(i, "http://h/", page) for i, (page, _) in enumerate(ODD)], "page_id int, url string, html string")
    found = html.to_markdown(pages)
    got = found.orderBy("page_id").collect()
    assert [r.markdown for r in got] == [text for _, text in ODD]
    assert [(r.title, r.headings, r.tables) for r in got] == [(None, 0, 0), (None, 0, 1), (None, 0, 0), ("t", 1, 0), (None, 0, 0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert most_rows(found) <= 40


def test_strip_is_white_space_at_the_ends(spark):
    """trimmed are the characters that ``(?U)\\s`` matches, no others."""
    every = spark.range(1, 0x3100).selectExpr("concat(chr(0), ' a ', decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')) AS t").selectExpr("explode(array(t, reverse(t))) AS t")
    every = every.where("NOT t RLIKE '[\\\\x{D800}-\\\\x{DFFF}]'")
    assert every.where(text.strip(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).count() == 0
    assert every.where(text.strip(F.col("t")) != F.col("t")).count() == 50


def test_sections_of_pages_read_once(spark):
    """sections need one reading of the pages; lines that only begin like a heading or a page mark are text, as before."""
    pages = spark.createDataFrame([(1, "http://h/", "<p>a<h1>A</h1><p>b<h4>c</h4><h2>B #</h2>")], "page_id int, url string, html string")
    made = documents.sections(html.to_markdown(pages).select("page_id", F.col("markdown").alias("body")), "page_id")
    assert sorted((r.section_id, r.heading_path, r.text) for r in made.collect()) == [("1::s000", [], "a"), ("1::s001", ["A"], "b\n\n#### c"), ("1::s002", ["A", "B"], "")]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    lines = ["#", "#no", " # no", "#### no", "<!-- page x -->", "<!-- page 2 -->.", "<!-- page 03 -->\r", "#\tA ##", "<!-- page 4 -->", "b"]
    docs = spark.createDataFrame([("d", "\n".join(lines))], "doc_id string, body string")
    got = [(r.heading_path, r.page_start, r.page_end, r.text) for r in documents.sections(docs).orderBy("section_id").collect()]
    assert got == [([], 3, 3, "\n".join(lines[:6])), (["A"], 3, 4, "b")]
