"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_rules
from lodestone.llm.common import byte_bpe_path, cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines of 50 words or more that occurred earlier are cut out; a document of which no word is left goes."""
    found = line_dedup.dedup_lines(docs)
    changed = F.col("n_deleted") > 0
    left = found.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(changed, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(
        *docs.columns
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: groups by Jaccard of 0.8 or more on 5-word shingles."""
    return jaccard_join.keep_one_per_group(docs, percent=80, size=5)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, with the digests of a round trip: (doc_id, n_tokens, ids, ids_sha256, decoded_sha256)."""
    return bpe.round_trip(docs, byte_bpe_path())


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("decontamination", leaks),
    ("bpe", tokens),
]

#: BPE and latent retrieval can't be stated in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
