"""Queries opN_<name> over the training-data tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import (
    bpe,
    decontaminate,
    jaccard_join,
    license_scan,
    line_dedup,
    lm_scores,
    pii,
    prefix_trie,
    quality_classifier,
    quality_rules,
    secret_scan,
    spelling,
    warc,
)
from lodestone.llm.common import byte_bpe_path, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.example_findings(spark))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.similarity_classes(table(spark, sf_dir, "documents"), percent=90, size=3, links=True)
    return found.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), byte_bpe_path())


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_lines", "n_deleted", "source_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.digest(table(spark, sf_dir, "conversations"))


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.digest(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_pii,
        op3_license_scan,
        op4_jaccard_join,
        op5_bpe,
        op6_warc,
        op7_quality_rules,
        op8_quality_classifier,
        op9_line_dedup,
        op10_decontamination,
        op11_prefix_trie,
        op12_lm_scores,
        op13_spelling_variants,
    )
}
ORACLES = {"op7_quality_rules": quality_rules.ORACLE_SQL, "op9_line_dedup": line_dedup.ORACLE_SQL, "op11_prefix_trie": prefix_trie.ORACLE_SQL}
