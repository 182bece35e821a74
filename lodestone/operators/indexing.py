"""The retrieval index of a release: chunks, their vectors and the check that nothing is missing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import documents, evidence
from lodestone.operators.turns import settled
from lodestone.sources import sinks


@dataclass
class Index:
    """Chunks and dispositions of a release, and where its vectors lie."""

    chunks: DataFrame
    dispositions: DataFrame
    vectors: str


def release_index(docs: DataFrame, families: DataFrame, cover: DataFrame, release_id: str, root: str, encode: Callable[[list[str]], list[list[float]]], dimension: int,
                  overrides: DataFrame | None = None, count: Callable[[str], int] = documents.count_words, limit: int = 8192) -> Index:
    """Chunk a release's documents (doc_id, kind, body, division), embed every chunk, and replace the release's partition of
    ``root``/chunks and its folder of vectors. Raises before anything is written if a chunk has no vector or more than one."""
    made, seeded = documents.chunk_corpus(docs, families, cover, overrides, count, limit)
    made = settled(made)
    vectors = settled(evidence.embed(made, encode, dimension))
    lost = made.select("chunk_id").exceptAll(vectors.select("chunk_id")).unionByName(vectors.select("chunk_id").exceptAll(made.select("chunk_id"))).limit(5).collect()
    if lost:
        raise ValueError("chunks and vectors differ: " + ", ".join(sorted(r.chunk_id for r in lost)))
    sinks.replace_release(made.withColumn("release_id", F.lit(release_id)), f"{root}/chunks")
    return Index(made, seeded, sinks.write_vectors(vectors, root, release_id))


def lines(index: Index, owners: DataFrame | None = None) -> DataFrame:
    """(n, line): dispositions, chunks, the largest one; with ``owners`` (paragraph, owner, docs), the first twenty shared paragraphs."""
    part = lambda n, by, line: [F.struct(F.lit(n).alias("part"), by.alias("by")).alias("n"), line.alias("line")]
    kinds = index.dispositions.groupBy("disposition").count().select(*part(0, F.col("disposition"), F.concat_ws(": ", "disposition", F.col("count").cast("string"))))
    total = index.chunks.agg(F.count("*").alias("c")).select(*part(1, F.lit(""), F.concat_ws(": ", F.lit("chunks"), F.col("c").cast("string"))))
    largest = index.chunks.agg(F.max(F.struct("token_count", "chunk_id")).alias("m")).where("m IS NOT NULL")
    every = kinds.unionByName(total).unionByName(largest.select(*part(2, F.lit(""), F.format_string("largest: %s, %d tokens", "m.chunk_id", "m.token_count"))))
    if owners is None:
        return every
    shown = owners.orderBy(F.desc("docs"), "paragraph").limit(20)
    return every.unionByName(shown.select(*part(3, F.col("paragraph"), F.concat(F.lit("shared: "), F.left("paragraph", F.lit(80)), F.lit(" — kept in "), F.col("owner").cast("string")))))
