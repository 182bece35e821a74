"""The golden suite over a table of questions: facts, retrieval and whole turns, each layer for all questions at once.

Questions: (id, question, fact struct<tool, args as JSON, expect_ids>, retrieval struct<query, division, family_ids, k,
expect_chunk_ids, expect_locator, expect_doc>, expected_outcome, expected_answer_contains, must_not_contain, script_purity,
expected_source_ids); a null fact or retrieval isn't evaluated. A whole turn that fails is tried once more: if it passes then,
it is flaky, which doesn't fail the suite, and the first attempt's evidence stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import units as U
from lodestone.operators import calls, dialog, evals, evidence, grounding, turns

QUESTION = (
    "id string, question string, fact struct<tool:string,args:string,expect_ids:array<string>>, "
    "retrieval struct<query:string,division:string,family_ids:array<string>,k:int,expect_chunk_ids:array<string>,expect_locator:string,expect_doc:string>, "
    "expected_outcome string, expected_answer_contains array<string>, must_not_contain array<string>, script_purity string, expected_source_ids array<string>"
)
#: Names of outcomes in the log and in questions, where they differ.
OUTCOMES = {"answered": "answer", "declined_oos": "out_of_scope", "deflected": "out_of_scope"}
_HITS = "struct<chunks:array<struct<chunk_id:string,locator:string,doc_id:string>>>"
_NONE = "array<string>"


def _listed(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.coalesce(F.sort_array(c), F.array().cast(_NONE)), ", "), F.lit("]"))


def _layer(name: str, status: Column, detail: Column) -> list[Column]:
    return [F.col("id"), F.lit(name).alias("layer"), status.alias("status"), detail.alias("detail")]


def facts(questions: DataFrame, store: calls.Store) -> DataFrame:
    """(id, layer, status, detail): does a tool's result hold the expected ids. A tool that can't be run fails."""
    asked = questions.where("fact IS NOT NULL").select(F.col("id").alias("call_id"), F.col("fact.tool").alias("tool"), F.coalesce("fact.args", F.lit("{}")).alias("args"))
    done = calls.run(asked, store).select(F.col("call_id").alias("id"), evals.result_ids(F.coalesce("result", F.lit(""))).alias("found"), "error")
    every = questions.select("id", "fact").join(done, "id", "left")
    status = F.when(F.col("fact").isNull(), "na").when(F.col("error").isNotNull(), "fail").otherwise(evals.fact_layer(F.coalesce("fact.expect_ids", F.array(F.lit(""))), F.array_append(F.coalesce("found", F.array().cast(_NONE)), F.lit(""))))
    missing = F.array_except(F.coalesce("fact.expect_ids", F.array().cast(_NONE)), F.coalesce("found", F.array().cast(_NONE)))
    detail = F.when(F.col("fact").isNull(), "no fact block").when(F.col("error").isNotNull(), F.col("error")).when(F.size(missing) > 0, F.concat(F.lit("missing "), _listed(missing), F.lit("; got "), _listed(F.col("found")))).otherwise(F.concat(F.col("fact.tool"), F.lit(" returned "), _listed(F.col("fact.expect_ids"))))
    return every.select(*_layer("fact", status, detail))


def retrieval(questions: DataFrame, store: calls.Store, encode: Callable[[list[str]], list[list[float]]] | None = None, dimension: int = 0) -> DataFrame:
    """(id, layer, status, detail): is an expected chunk, part of a locator or document among the best hits."""
    r = lambda c: F.col(f"retrieval.{c}")
    asked = questions.where("retrieval IS NOT NULL").select(F.col("id").alias("call_id"), F.coalesce(r("query"), "question").alias("query"), r("division").alias("division"), r("family_ids").alias("family_ids"), F.coalesce(r("k"), F.lit(5)).alias("k"))
    vector = F.lit(None).cast("array<double>")
    if encode:
        found = evidence.embed(asked.select("call_id", F.col("query").alias("content")), encode, dimension, id_col="call_id")
        asked = asked.join(found.withColumnRenamed("embedding", "v"), "call_id", "left")
        vector = F.col("v").cast("array<double>")
    rows = asked.select("call_id", F.lit("search_documents").alias("tool"), F.to_json(F.struct("query", "division", "family_ids", "k")).alias("args"), vector.alias("vector"))
    done = calls.run(rows, store).select(F.col("call_id").alias("id"), F.from_json("result", _HITS).alias("h"))
    every = questions.select("id", "retrieval").join(done, "id", "left")
    hits = F.coalesce("h.chunks", F.from_json(F.lit('{"chunks":[]}'), _HITS).chunks)
    low = F.transform(hits, lambda c: F.struct(c.chunk_id.alias("chunk_id"), F.lower(F.coalesce(c.locator, F.lit(""))).alias("locator"), c.doc_id.alias("doc_id")))
    # One expectation counts: chunks before locator before document.
    ids = r("expect_chunk_ids")
    locator = F.when(ids.isNull(), F.lower(r("expect_locator")))
    doc = F.when(ids.isNull() & locator.isNull(), r("expect_doc"))
    status = F.when(F.col("retrieval").isNull(), "na").otherwise(evals.retrieval_layer(low, ids, locator, doc))
    got = F.transform(hits, lambda c: F.when(ids.isNotNull(), c.chunk_id).when(locator.isNotNull(), c.locator).otherwise(c.doc_id))
    detail = F.when(F.col("retrieval").isNull(), "no retrieval block").when(status == "na", "retrieval block has no expectation").otherwise(F.concat(F.lit("top-k "), F.concat(F.lit("["), F.array_join(got, ", ", "-"), F.lit("]"))))
    return every.select(*_layer("retrieval", status, detail))


def attempt(questions: DataFrame, store: calls.Store, call: Callable[[str], str], prompts: dict[str, str] | None = None, encode: Callable[[list[str]], list[list[float]]] | None = None, dimension: int = 0) -> DataFrame:
    """(id, errors, evidence): each question as the first turn of a session of its own, and what is wrong with its answer."""
    none = F.lit(None).cast("array<struct<role:string,text:string>>")
    asked = questions.select(F.col("id").alias("turn_id"), F.col("id").alias("session_id"), F.lit(1).alias("seq"), F.col("question").alias("text"), none.alias("history"))
    done = turns.answer(asked, store, call, prompts, None, encode, dimension)
    answers = dialog.answer_text(done.messages)
    cited = done.citations.groupBy(F.col("answer_id").alias("turn_id")).agg(F.collect_set("ref_id").alias("cited"))
    texts = done.tool_calls.select("turn_id", F.concat_ws(" ", "args", "result").alias("t")).unionByName(asked.select("turn_id", F.col("text").alias("t")))
    allowed = grounding.universe(texts, "turn_id", "t")
    rows = questions.withColumnRenamed("id", "turn_id").join(done.turns.select("turn_id", F.col("outcome").alias("logged")), "turn_id", "left")
    for more in (answers, cited, allowed):
        rows = rows.join(more, "turn_id", "left")
    names = F.create_map(*(F.lit(x) for pair in OUTCOMES.items() for x in pair))
    outcome = F.coalesce(F.element_at(names, F.col("logged")), F.col("logged"), F.lit(""))
    text, empty = F.coalesce("answer", F.lit("")), F.array().cast(_NONE)
    rows = rows.withColumns({"outcome": outcome, "answer": text, "cited": F.coalesce("cited", empty), "allowed": F.coalesce("allowed", F.array().cast("array<double>"))})
    tell = lambda c, label: F.when(F.size(c) > 0, F.array(F.concat(F.lit(label), _listed(c)))).otherwise(empty)
    wanted = F.nullif("expected_outcome", F.lit(""))
    wrong = F.when(wanted.isNotNull() & (F.col("outcome") != wanted), F.array(F.concat(F.lit("outcome "), F.col("outcome"), F.lit(" instead of "), wanted))).otherwise(empty)
    says = lambda items, truth: F.filter(F.coalesce(items, empty), lambda n: T.says(F.col("answer"), n) == F.lit(truth))
    leaks = F.when(F.col("script_purity") == "hi", T.latin_leaks(F.col("answer"))).otherwise(empty)
    unsourced = F.transform(F.array_except(U.spec_numbers(F.col("answer")), F.col("allowed")), lambda x: x.cast("string"))
    errors = F.concat(
        wrong, tell(says("expected_answer_contains", False), "missing text "), tell(says("must_not_contain", True), "forbidden text "), tell(leaks, "Latin words "),
        tell(F.array_except(F.coalesce("expected_source_ids", empty), "cited"), "missing sources "), tell(F.when(F.col("outcome") == "handoff", unsourced).otherwise(empty), "unsourced numbers "),
    )
    shown = F.concat(F.lit("outcome="), F.coalesce("logged", F.lit("")), F.lit(" cites="), _listed(F.col("cited")), F.lit(" answer="), F.col("answer"))
    return turns.settled(rows.select(F.col("turn_id").alias("id"), errors.alias("errors"), shown.alias("evidence")))


def whole_turns(questions: DataFrame, store: calls.Store, call: Callable[[str], str] | None, prompts: dict[str, str] | None = None, encode: Callable[[list[str]], list[list[float]]] | None = None, dimension: int = 0) -> DataFrame:
    """(id, layer, status, detail): whole turns, those that fail tried once more. Without a model nothing is evaluated."""
    if call is None:
        return questions.select(*_layer("e2e", F.lit("na"), F.lit("no model")))
    first = attempt(questions, store, call, prompts, encode, dimension)
    failed = questions.join(first.where(F.size("errors") > 0).select("id"), "id", "left_semi")
    again = failed.limit(0).select("id", F.array().cast(_NONE).alias("errors2"), F.lit("").alias("evidence2"))
    if not failed.isEmpty():
        again = attempt(failed, store, call, prompts, encode, dimension).withColumnsRenamed({"errors": "errors2", "evidence": "evidence2"})
    both = first.join(again, "id", "left")
    status = evals.e2e_layer(F.col("errors"), F.col("errors2"))
    tell = lambda e, shown: F.concat_ws(" || ", F.array_join(e, "; "), F.col(shown))
    detail = F.when(status == "pass", F.col("evidence")).when(status == "flaky", F.concat(F.lit("passed on retry || "), tell("errors", "evidence"))).otherwise(tell("errors2", "evidence2"))
    return both.select(*_layer("e2e", status, detail))


def run(questions: DataFrame, store: calls.Store, call: Callable[[str], str] | None = None, prompts: dict[str, str] | None = None, encode: Callable[[list[str]], list[list[float]]] | None = None, dimension: int = 0, layers: tuple[str, ...] = evals.LAYERS) -> DataFrame:
    """(id, layer, status, detail) of all questions on the given layers; ``evals.report`` counts them, ``failing`` lists what blocks."""
    made = {
        "fact": lambda: facts(questions, store),
        "retrieval": lambda: retrieval(questions, store, encode, dimension),
        "e2e": lambda: whole_turns(questions, store, call, prompts, encode, dimension),
    }
    found = [made[name]() for name in evals.LAYERS if name in layers]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every


def failing(results: DataFrame) -> DataFrame:
    return results.where("status = 'fail'")


def lines(results: DataFrame) -> DataFrame:
    """(n, line): the report as text, totals by layer first, then what failed or was flaky by question."""
    counts = evals.report(results.select("layer", "status"))
    head = F.concat_ws("  ", F.col("layer"), *(F.concat(F.lit(f"{s} "), F.col(s).cast("string")) for s in evals.STATUSES))
    place = F.element_at(F.create_map(*(x for i, n in enumerate(evals.LAYERS) for x in (F.lit(n), F.lit(i)))), F.col("layer"))
    totals = counts.select(F.struct(F.lit(0).alias("part"), F.lit("").alias("id"), place.alias("place")).alias("n"), head.alias("line"))
    told = results.where(F.col("status").isin("fail", "flaky"))
    each = told.select(F.struct(F.lit(1).alias("part"), F.col("id"), place.alias("place")).alias("n"), F.concat(F.upper("status"), F.lit(" "), "id", F.lit(" ["), "layer", F.lit("] "), "detail").alias("line"))
    return totals.unionByName(each)
