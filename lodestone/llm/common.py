"""Shared pieces of the training-data operators: table access, lineage cuts, word splitting."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
WORD_BREAKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a fresh local one, but on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, with its scheme; removed when the driver's JVM ends."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}")
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(jpath)
    return fs.makeQualified(jpath).toString()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a frame from ``cut`` once nothing reads them any more."""
    spark = df.sparkSession
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(f)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def free_shuffles(spark: SparkSession, last: bool = False) -> None:
    """Let Spark's cleaner delete the shuffle files of finished frames now, not at the driver's next collection.

    The scheduler holds on to the last job until another one comes; with ``last`` an empty one lets go of it."""
    if last:
        spark._jsparkSession.range(1).queryExecution().toRdd().count()
    gc.collect()
    spark._jvm.System.gc()


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], spread: Column, share: int = 1000) -> DataFrame:
    """``rows`` left-joined with the one row of their group in ``groups`` (keys, n_rows, other columns), of a cut table.

    Groups with at least 1 / ``share`` of the rows counted in n_rows, of which there can't be more than ``share``, are
    broadcast, and their rows are dealt out by ``spread`` instead of the key, so that no task gets a whole hot group."""
    total = groups.agg(F.sum("n_rows")).first()[0] or 0
    values = [c for c in groups.columns if c not in (*keys, "n_rows")]
    is_hot = F.col("n_rows") * share >= total
    packed = lambda name: F.struct(*values).alias(name)
    hot = groups.where(is_hot).select(*keys, packed("_hot"))
    cold = groups.where(~is_hot).select(*keys, F.lit(-1).cast("bigint").alias("_deal"), packed("_cold"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_deal", F.when(F.col("_hot").isNull(), F.lit(-1).cast("bigint")).otherwise(F.pmod(spread, F.lit(1 << 40)))
    )
    joined = dealt.join(cold, [*keys, "_deal"], "left").withColumn("_group", F.coalesce("_hot", "_cold"))
    return joined.select(*rows.columns, *(F.col("_group")[v].alias(v) for v in values))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null gives no words."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_BREAKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit integers, each bit of which depends on all bits of the given ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_bpe_path() -> str:
    """The public byte-level BPE file of the installed vocabulary package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
