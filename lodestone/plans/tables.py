"""The driver's tables read as the engine's own: parts as capability rows, brands as families, years as releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One envelope row for each part; units by type, so that every outcome occurs."""
    p = table(spark, sf_dir, "part")
    kind = F.regexp_extract("p_type", r"^\S+", 0)
    unit = F.create_map(*(F.lit(x) for pair in {"ECONOMY": "Nm3/hr", "STANDARD": "NM³/HR", "LARGE": "SCMD", "PROMO": "Kg/hr", "MEDIUM": "cfm"}.items() for x in pair))
    scale = F.when(kind == "LARGE", 24.0).otherwise(1.0)
    size = F.col("p_size").cast("double")
    return p.select(
        F.col("p_partkey").alias("cap_id"),
        F.col("p_brand").alias("family_id"),
        F.element_at(unit, kind).alias("capacity_unit"),
        F.when(F.col("p_partkey") % 4 != 0, size * 10 * scale).alias("capacity_min"),
        (size * 200 * scale).alias("capacity_max"),
        F.lit(None).cast("double").alias("discharge_p_min"),
        ((F.col("p_partkey") % 20 + 1) * 100).cast("double").alias("discharge_p_max"),
        F.lit("barg").alias("pressure_unit"),
        F.when(F.col("p_partkey") % 3 == 1, True).when(F.col("p_partkey") % 3 == 2, False).alias("lubricated"),
        F.array(F.concat(F.lit("STD-"), (F.col("p_partkey") % 7).cast("string"))).alias("standards"),
    )


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("family_id")).distinct()
    return brands.select("family_id", F.concat(F.lit("Family "), "family_id").alias("name"))


def gases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hydrogen under two names; every fifth part serves air instead."""
    key = F.col("p_partkey")
    gas = F.when(key % 5 == 0, "air").when(key % 2 == 0, "Hydrogen").otherwise(" h2")
    return table(spark, sf_dir, "part").select(key.alias("cap_id"), gas.alias("gas"))


CAPABILITY_SQL = """
cap AS (SELECT p_partkey AS cap_id, p_brand AS family_id,
               CASE split_part(p_type, ' ', 1) WHEN 'ECONOMY' THEN 'Nm3/hr' WHEN 'STANDARD' THEN 'Nm3/hr' WHEN 'LARGE' THEN 'SCMD'
                    WHEN 'PROMO' THEN 'kg/hr' WHEN 'MEDIUM' THEN 'cfm' END AS unit,
               CASE WHEN p_partkey % 4 <> 0 THEN p_size * 10.0 * CASE WHEN p_type LIKE 'LARGE%' THEN 24 ELSE 1 END END AS cmin,
               p_size * 200.0 * CASE WHEN p_type LIKE 'LARGE%' THEN 24 ELSE 1 END AS cmax,
               (p_partkey % 20 + 1) * 100.0 AS pmax,
               CASE p_partkey % 3 WHEN 1 THEN true WHEN 2 THEN false END AS lubricated, p_partkey % 7 AS std
        FROM part WHERE p_partkey % 5 <> 0)
"""


def assess_sql(where: str, capacity: float = 3000, pressure: float = 350) -> str:
    """Common table expressions ending in ``a``: the outcome of each row for a duty in Nm3/hr and barg."""
    return f"""WITH {CAPABILITY_SQL},
v AS (SELECT *, CASE unit WHEN 'Nm3/hr' THEN CAST({capacity} AS DOUBLE) WHEN 'SCMD' THEN {capacity} * 24.0 END AS val FROM cap WHERE {where}),
s AS (SELECT *, CASE WHEN coalesce(val < cmin OR val > cmax, false) OR coalesce(val > cmax, false) OR {pressure} > pmax THEN 'failed'
                     WHEN val IS NULL THEN 'candidate' ELSE 'match' END AS status FROM v),
a AS (SELECT *, coalesce(unit = 'Nm3/hr', false) AS same_unit, 1 - val / nullif(cmax, 0) AS h1, 1 - {pressure} / nullif(pmax, 0) AS h2,
             coalesce(val / nullif(cmax, 0) > 0.9, false) OR {pressure} / pmax > 0.9 AS near_edge FROM s)
"""
