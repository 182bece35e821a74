"""Sinks. Parquet has no updates: a mutation writes a new state beside the old one; partitions are replaced whole."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_only(fresh: DataFrame, stored: DataFrame, key: str = "sha256") -> DataFrame:
    """Rows of ``fresh`` whose content isn't stored yet, one for each key; running twice adds nothing."""
    return fresh.dropDuplicates([key]).join(stored.select(key).distinct(), key, "left_anti")


def append_new(fresh: DataFrame, path: str, key: str = "sha256") -> int:
    """Append what isn't in the table at ``path``; the number of rows written."""
    spark = fresh.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        fresh = new_only(fresh, spark.read.schema(fresh.schema).parquet(path), key)
    else:
        fresh = fresh.dropDuplicates([key])
    rows = fresh.persist()
    try:
        n = rows.count()
        if n:
            rows.write.mode("append").parquet(path)
        return n
    finally:
        rows.unpersist()


def replace_release(rows: DataFrame, path: str) -> None:
    """Replace the partitions of the releases in ``rows``; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("release_id").parquet(path)


def write_vectors(vectors: DataFrame, root: str, release_id: str) -> str:
    """The vectors of a release in a folder of its own; the folder."""
    slug = "".join(c if c.isalnum() else "_" for c in release_id.lower()).strip("_")
    if not slug:
        raise ValueError("a release needs a name")
    path = f"{root}/chunk_embedding_{slug}"
    vectors.write.mode("overwrite").parquet(path)
    return path


def review_rows(staged: DataFrame, values: list[str], evidence: str = "evidence") -> DataFrame:
    """A review sheet: each value beside its evidence, provenance, and an empty decision. Lists are joined by commas."""
    def cell(c: str):
        kind = staged.schema[c].dataType.typeName()
        col = F.col(c)
        return (F.array_join(col, ", ") if kind == "array" else F.to_json(col) if kind in ("struct", "map") else col.cast("string")).alias(c)

    pairs = [x for c in values for x in (cell(c), F.get_json_object(evidence, f"$.{c}").alias(f"»{c}"))]
    kept = [c for c in ("section_id", "source_doc_id", "source_locator", "conflict_group") if c in staged.columns]
    return staged.select(*pairs, *kept, F.lit("").alias("decision"))


def with_parent_source(gases: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Gas rows with the source document and locator of their capability row."""
    return gases.join(capabilities.select("cap_id", "source_doc_id", "source_locator"), "cap_id", "left")


def write_sheet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, escape='"', quote='"')


def append_turn(tables: dict[str, DataFrame], root: str, batch: str) -> None:
    """Append the tables of a turn, children last, each row with its batch: readers ignore batches without a turn row written."""
    for name in ("message", "agent_invocation", "tool_call", "citation", "turn"):
        if name in tables:
            tables[name].withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{root}/{name}")


def write_manifest(pages: DataFrame, path: str) -> None:
    """The ingest manifest: one JSON entry for each address; duplicates share a content hash."""
    pages.dropDuplicates(["url"]).write.mode("overwrite").json(path)


def write_json(rows: DataFrame, path: str) -> None:
    """An artefact (sections, classifications, drops, raw extractions) as JSON lines."""
    rows.write.mode("overwrite").json(path)


def append_log(calls: DataFrame, path: str) -> None:
    """Model calls at the end of a log of JSON lines."""
    calls.write.mode("append").json(path)


def as_yaml(rows: DataFrame, name: str, order: str) -> str:
    """A hand-kept list (families, dispositions) as YAML that ``readers.simple_yaml`` reads back: one mapping a row, nulls left out.

    Such lists are for people to edit: a few hundred rows, collected to the driver."""
    lines = [f"{name}:"]
    for row in rows.orderBy(order).collect():
        fields = [(k, v) for k, v in row.asDict().items() if v is not None]
        lines += [f"{'  - ' if i == 0 else '    '}{k}: {json.dumps(v, ensure_ascii=False)}" for i, (k, v) in enumerate(fields)]
    return "\n".join(lines) + "\n"


def sessions(created: DataFrame, touches: DataFrame) -> DataFrame:
    """Sessions (session_id, created_at, …) with ``last_at``: the latest of the times appended when they were touched."""
    last = touches.groupBy("session_id").agg(F.max("at").alias("_at"))
    return created.join(last, "session_id", "left").withColumn("last_at", F.greatest("created_at", "_at")).drop("_at")
