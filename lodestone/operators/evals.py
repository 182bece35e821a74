"""Evaluation of golden questions on three layers, and its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import units as U

LAYERS = ("fact", "retrieval", "e2e")
STATUSES = ("pass", "fail", "flaky", "na")


def fact_layer(expected: Column, found: Column) -> Column:
    """pass if every expected id was found; na without expectations."""
    missing = F.size(F.array_except(expected, F.coalesce(found, F.array().cast("array<string>"))))
    return F.when(expected.isNull() | (F.size(expected) == 0), "na").when(missing == 0, "pass").otherwise("fail")


def retrieval_layer(chunks: Column, chunk_ids: Column, locator: Column, doc: Column) -> Column:
    """pass if a retrieved chunk (struct chunk_id, locator, doc_id) is expected by id, by part of its locator or by document."""
    hit = F.exists(
        chunks,
        lambda c: F.coalesce(F.array_contains(chunk_ids, c["chunk_id"]), F.lit(False))
        | F.coalesce(F.contains(c["locator"], locator), F.lit(False))
        | F.coalesce(c["doc_id"] == doc, F.lit(False)),
    )
    none = chunk_ids.isNull() & locator.isNull() & doc.isNull()
    return F.when(none | chunks.isNull(), "na").when(hit, "pass").otherwise("fail")


def e2e_errors(outcome: Column, expected_outcome: Column, text: Column, contains: Column, forbidden: Column) -> Column:
    """What an answer misses or must not say."""
    none = F.array().cast("array<string>")
    wrong = F.when(outcome != expected_outcome, F.array(F.concat(F.lit("outcome:"), outcome))).otherwise(none)
    missing = F.transform(F.filter(F.coalesce(contains, none), lambda n: ~T.says(text, n)), lambda n: F.concat(F.lit("missing:"), n))
    said = F.transform(F.filter(F.coalesce(forbidden, none), lambda n: T.says(text, n)), lambda n: F.concat(F.lit("said:"), n))
    return F.concat(wrong, missing, said)


def e2e_layer(first: Column, second: Column) -> Column:
    """Status of two attempts' errors; the second counts only if the first failed."""
    return F.when(F.size(first) == 0, "pass").when(F.coalesce(F.size(second) == 0, F.lit(False)), "flaky").otherwise("fail")


#: Fields of tool results that hold ids.
ID_FIELDS = ("cap_id", "family_id", "product_id", "fact_id", "office_id", "chunk_id", "doc_id")


def result_ids(result: Column) -> Column:
    """Distinct ids in a tool result's JSON, at any depth: string values of the id fields."""
    pattern = r'"(?:' + "|".join(ID_FIELDS) + r')"\s*:\s*"((?:[^"\\]|\\.)*)"'
    return F.array_sort(F.array_distinct(F.regexp_extract_all(result, F.lit(pattern), F.lit(1))))


def report(results: DataFrame) -> DataFrame:
    """(layer, pass, fail, flaky, na, ok) of results (layer, status)."""
    counts = results.groupBy("layer").pivot("status", list(STATUSES)).count().na.fill(0, list(STATUSES))
    return counts.withColumn("ok", F.col("fail") == 0)


def handoff_guard(answer: Column, allowed: Column) -> Column:
    """Whether all spec numbers of a handoff are among the numbers of results, arguments and question."""
    return F.size(F.array_except(U.spec_numbers(answer), allowed)) == 0


def purity(text: Column, script: Column) -> Column:
    """Latin words left in an answer that should be in another script; none where Latin is asked for."""
    return F.when(script.isNull() | (script == "latin"), F.array().cast("array<string>")).otherwise(T.latin_leaks(text))


def score(questions: DataFrame, facts: DataFrame, retrieved: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, layer, status) of golden questions.

    ``questions``: (id, expected_ids, chunk_ids, locator, doc, outcome, contains, must_not); ``facts``: (id, found);
    ``retrieved``: (id, chunks); ``answers``: (id, attempt, outcome, text) of one or two attempts."""
    tried = answers.groupBy("id").agg(*(F.max(F.when(F.col("attempt") == k, F.struct("outcome", "text"))).alias(f"a{k}") for k in (1, 2)))
    every = questions.join(facts.select("id", "found"), "id", "left").join(retrieved.select("id", "chunks"), "id", "left").join(tried, "id", "left")
    errors = lambda k: F.when(F.col(f"a{k}").isNotNull(), e2e_errors(F.col(f"a{k}.outcome"), F.col("outcome"), F.coalesce(f"a{k}.text", F.lit("")), F.col("contains"), F.col("must_not")))
    e2e = F.when(F.col("a1").isNull(), "na").otherwise(e2e_layer(errors(1), errors(2)))
    layers = F.array(
        F.struct(F.lit("fact").alias("layer"), fact_layer(F.col("expected_ids"), F.col("found")).alias("status")),
        F.struct(F.lit("retrieval").alias("layer"), retrieval_layer(F.col("chunks"), F.col("chunk_ids"), F.col("locator"), F.col("doc")).alias("status")),
        F.struct(F.lit("e2e").alias("layer"), e2e.alias("status")),
    )
    return every.select("id", F.explode(layers).alias("r")).select("id", "r.layer", "r.status")
