"""Reports as lines (n, line), for a console or a file: order by n. Counts are aggregations; lists are cut where the report says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _line(part: int, by: Column, text: Column) -> list[Column]:
    return [F.struct(F.lit(part).alias("part"), F.coalesce(by.cast("string"), F.lit("")).alias("by")).alias("n"), text.alias("line")]


def check_lines(violations: DataFrame) -> DataFrame:
    """Of ``release.check``: whether a candidate may be promoted, then hard failures, then warnings."""
    hard = F.col("severity") == "hard"
    counts = violations.agg(F.count_if(hard).alias("h"), F.count_if(~hard).alias("w"))
    verdict = F.when(F.col("h") == 0, "may be promoted").otherwise("must not be promoted")
    head = counts.select(*_line(0, F.lit(""), F.concat(verdict, F.lit(": "), F.format_string("%d failures, %d warnings", "h", "w"))))
    said = F.concat(F.when(hard, "FAIL ").otherwise("warn "), "table", F.lit(" "), F.coalesce(F.col("key").cast("string"), F.lit("-")), F.lit(": "), "message")
    each = violations.select(F.when(hard, 1).otherwise(2).alias("p"), F.concat_ws(" ", "table", F.col("key").cast("string"), "message").alias("b"), said.alias("s"))
    return head.unionByName(each.select(F.struct(F.col("p").alias("part"), F.col("b").alias("by")).alias("n"), F.col("s").alias("line")))


def diff_lines(changes: DataFrame, key: str) -> DataFrame:
    """Of ``release.diff``: how many rows are new, changed, superseded and the same, then each changed row with both values."""
    counts = changes.groupBy("change").count().select(*_line(0, F.col("change"), F.concat_ws(": ", "change", F.col("count").cast("string"))))
    both = F.concat_ws(" -> ", F.to_json("_old"), F.to_json("_new"))
    each = changes.where("change = 'changed'").select(*_line(1, F.col(key), F.concat(F.lit("changed "), F.col(key).cast("string"), F.lit(": "), both)))
    return counts.unionByName(each)


def verify_lines(verified: DataFrame, most: int = 25) -> DataFrame:
    """Of ``documents.verify``: the sources that aren't in order, with at most ``most`` missing tokens each, and the total."""
    total = verified.agg(F.count("*").alias("n"), F.count_if("ok").alias("k")).select(*_line(0, F.lit(""), F.format_string("%d of %d sources in order", "k", "n")))
    tokens = F.concat(F.lit("missing "), F.array_join(F.slice("missing", 1, most), ", "), F.when(F.size("missing") > most, F.concat(F.lit(" and "), (F.size("missing") - most).cast("string"), F.lit(" more"))).otherwise(F.lit("")))
    why = F.concat_ws("; ", F.col("note"), F.when(F.size("missing") > 0, tokens), F.when(F.size("junk") > 0, F.concat(F.lit("junk "), F.array_join("junk", ", "))))
    each = verified.where("NOT ok").select(*_line(1, F.col("url"), F.concat(F.lit("FAIL "), "url", F.lit(": "), why)))
    return total.unionByName(each)


def usage_lines(totals: DataFrame) -> DataFrame:
    """Of ``evidence.usage``: calls, tokens, cache rate and cost; a cost without prices is n/a."""
    cost = F.when(F.col("cost").isNull(), "n/a").otherwise(F.format_string("%.4f", "cost"))
    calls = F.format_string("calls %d, skipped %d", "calls", "skipped")
    tokens = F.format_string("tokens in %d, out %d, cached %d (%.0f %%)", "tokens_in", "tokens_out", "tokens_cached", F.col("cache_rate") * 100)
    return totals.select(*_line(0, F.lit(""), calls)).unionByName(totals.select(*_line(1, F.lit(""), tokens))).unionByName(totals.select(*_line(2, F.lit(""), F.concat(F.lit("cost "), cost))))
