"""Quality rules as a short-circuit cascade.

Each rule rejects a document by one metric of its whole text. The cost and the
rejection rate of every rule are measured on a sample; the cascade then tries
rules in the order of rejections per second. A later rule's metric is computed
only for documents that passed all earlier ones (CASE branches are lazy). The
order changes the running time alone: a document is kept when no rule rejects it.

Defined cases: a null text counts as empty and an empty text is rejected by
``few_words``; repeated rows are judged one by one; other columns pass through,
and the columns added replace columns of the same name.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import words_of


def _grams(n: int) -> str:
    """SQL for the hashes of all windows of ``n`` words, from the word hashes ``h``."""
    return f"transform(sequence(0, size(h) - {n}), i -> xxhash64({', '.join(f'h[i + {k}]' for k in range(n))}))"


#: Metrics over the columns ``_text`` (never null) and ``_words``. All are bigint.
METRICS = {
    "n_words": "cast(size(_words) as bigint)",
    "word_chars": "cast(char_length(array_join(_words, '')) as bigint)",
    "n_symbols": "cast(regexp_count(_text, '[#*$%&|<>]') as bigint)",
    "n_upper": "cast(regexp_count(_text, '[A-Z]') as bigint)",
    "n_shouts": "cast(regexp_count(_text, '!') as bigint)",
    "n_lines": r"cast(size(filter(split(_text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')) as bigint)",
    # Lines with a word, less the distinct ones: those equal to an earlier line.
    "n_dup_lines": r"""transform(array(filter(split(_text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')),
        ls -> cast(size(ls) - size(array_distinct(ls)) as bigint))[0]""",
    # Documents without an equal pair of 4-word windows, nearly all, stop there. Else take 8-word windows, sort
    # (hash, position), keep positions with an equal neighbour and add up what their windows cover.
    "n_repeat_words": f"""CASE WHEN size(_words) < 9 THEN 0L ELSE transform(array(transform(_words, w -> xxhash64(w))),
        h -> CASE WHEN size(array_distinct({_grams(4)})) = size(h) - 3 THEN 0L ELSE transform(
            array(sort_array(transform({_grams(8)}, (g, i) -> struct(g AS h, i AS i)))),
            s -> transform(
                array(sort_array(transform(
                    filter(s, (x, k) -> coalesce(get(s, k - 1).h = x.h, false) OR coalesce(get(s, k + 1).h = x.h, false)),
                    x -> x.i))),
                p -> aggregate(transform(p, (v, k) -> least(8, coalesce(get(p, k + 1) - v, 8))), 0L, (a, v) -> a + v)
            )[0])[0] END)[0] END""",
}


@dataclass(frozen=True)
class Rule:
    """``reject`` is a SQL predicate with metrics in braces."""

    name: str
    reject: str

    def sql(self, ready: frozenset[str] = frozenset()) -> str:
        """With metrics in ``ready`` taken as columns and the rest computed in place."""
        return self.reject.format(**{k: k if k in ready else f"({v})" for k, v in METRICS.items()})


BASE_RULES = (
    Rule("few_words", "{n_words} < 20"),
    Rule("repeated_words", "100 * {n_repeat_words} > 30 * {n_words}"),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", "10 * {n_symbols} > {n_words}"),
    Rule("upper_case", "10 * {n_upper} > 4 * {word_chars}"),
    Rule("shouting", "2 * {n_shouts} > {n_words}"),
    Rule("repeated_lines", "10 * {n_dup_lines} > 4 * {n_lines}"),
    Rule("word_length", "{word_chars} < 2 * {n_words} OR {word_chars} > 25 * {n_words}"),
)


def with_words(docs: DataFrame) -> DataFrame:
    """(_row, _text, _words): the row as a struct, so that none of its own columns is touched, its text and its words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), text.alias("_text"), words_of(text).alias("_words"))


def measure(docs: DataFrame, rules=RULES, sample_rows: int = 2000, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) of each rule on a random sample of about ``sample_rows`` documents.

    Seconds are the least of three runs, less those of a run without a rule, so that a job's start isn't counted.
    The sample serves the order of the rules alone, never a verdict."""
    n = docs.count()
    sample = with_words(docs.select("text").sample(min(1.0, sample_rows / max(n, 1)), seed)).drop("_row").coalesce(1).persist()

    def timed(condition: str) -> tuple[float, int]:
        probe, took = sample.agg(F.count_if(F.expr(condition)).alias("n")), []
        for _ in range(3):  # the first compiles
            began = time.perf_counter()
            found = probe.first().n
            took.append(time.perf_counter() - began)
        return min(took), found

    try:
        rows = sample.count()
        empty = timed("size(_words) < 0")[0]
        found = []
        for rule in rules:
            seconds, rejected = timed(rule.sql())
            found.append((rule, max(1e-4, seconds - empty), rejected / max(rows, 1)))
    finally:
        sample.unpersist()
    return found


def cascade_order(measured) -> list[Rule]:
    """Rules by rejections per second, highest first; ties by name."""
    return [m[0] for m in sorted(measured, key=lambda m: (-m[2] / max(m[1], 1e-9), m[0].name))]


def cascade_sql(order, ready: frozenset[str] = frozenset()) -> str:
    """Name of the first rule that rejects, in order; null if none does."""
    branches = " ".join(f"WHEN {r.sql(ready)} THEN '{r.name}'" for r in order)
    return f"CASE {branches} END" if order else "CAST(NULL AS STRING)"


def verdict(order) -> str:
    """``cascade_sql`` with words and text bound to lambda variables. As columns of a projection they would be copied into
    every rule once a filter on the verdict moves below it; bound, a document is split into words once."""
    return f"transform(array(_text), _text -> transform(array(_words), _words -> {cascade_sql(order)})[0])[0]"


def judge(docs: DataFrame, rules=RULES, sample_rows: int = 2000) -> DataFrame:
    """``docs`` with ``rejected_by`` (the first rejecting rule in cascade order) and ``kept``."""
    order = cascade_order(measure(docs, rules, sample_rows))
    names = [c for c in docs.columns if c not in ("rejected_by", "kept")]
    judged = with_words(docs.select(*names)).select("_row.*", F.expr(verdict(order)).alias("rejected_by"))
    return judged.select(*names, "rejected_by", F.col("rejected_by").isNull().alias("kept"))


def keep(docs: DataFrame, rules=RULES, sample_rows: int = 2000) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    order = cascade_order(measure(docs, rules, sample_rows))
    return with_words(docs).where(F.expr(verdict(order)).isNull()).select("_row.*")


DIGEST = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def digest(docs: DataFrame, rules=RULES, sample_rows: int = 2000) -> DataFrame:
    """doc_id, the five base metrics, base_failed and kept for every document.

    All documents get the base metrics; the cascade decides over the other rules, and only where the base rules pass."""
    extra = [r for r in cascade_order(measure(docs, rules, sample_rows)) if r not in BASE_RULES]
    ready = frozenset(DIGEST)
    base = " OR ".join(r.sql(ready) for r in BASE_RULES)
    counted = with_words(docs.select("doc_id", "text")).select(
        "_row.doc_id", "_text", "_words", *(F.expr(METRICS[k]).alias(k) for k in DIGEST)
    )
    failed = counted.withColumn("base_failed", F.expr(base))
    return failed.select(
        "doc_id",
        *DIGEST,
        "base_failed",
        F.expr(f"CASE WHEN base_failed THEN false ELSE ({cascade_sql(extra, ready)}) IS NULL END").alias("kept"),
    )


#: DuckDB SQL for ``digest``.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
                  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
     g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS gram
           FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
     h AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
     r AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
           FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM h) GROUP BY doc_id),
     m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
                  CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
                  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
                  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
                  length(regexp_replace(t, '[^!]', '', 'g')) AS n_shouts, len(ls) AS n_lines
           FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
     b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_upper > 4 * word_chars OR 2 * n_shouts > n_words
            OR 10 * n_dup_lines > 4 * n_lines OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM b
"""
