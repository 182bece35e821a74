"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, drop_cut, join_groups


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node (all, or those below it) to the least of them.

    A node with a large share of the edges, as the least one of a large group is, is joined by broadcast."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        keep = F.col("v") > F.col("u")
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        keep = F.lit(True)
    least = near.groupBy("u").agg(F.count("*").alias("n_rows"), F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    least = cut(least, "least-neighbours")
    linked = join_groups(near, least, ["u"], F.xxhash64("v")).where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        linked = linked.unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the least node reachable.

    An empty edge table gives an empty result; loops and repeated edges don't matter."""
    now = cut(edges.where("u != v").select("u", "v").distinct(), "edges")
    state = None
    while True:
        after = cut(_star(_star(now, True), False), "edges")
        drop_cut(now)
        now = after
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state or not seen[0]:
            break
        state = seen
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
