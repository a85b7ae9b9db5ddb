"""Graphs derived from the ``lineitem`` table, with the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.graph import Graph


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def sparse(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts (even ids) and suppliers (odd ids) of large discounted lines, both ways, with the lowest price as weight."""
    rows = lineitem(spark, sf_dir).where("l_discount >= 0.10 and l_quantity >= 45")
    pairs = rows.groupBy((2 * F.col("l_partkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst")).agg(F.min("l_extendedprice").alias("weight"))
    return Graph(None, pairs).symmetrize()


def part_supplier(spark: SparkSession, sf_dir: str) -> Graph:
    """Every part to its suppliers; suppliers have no out-edges."""
    return Graph(None, lineitem(spark, sf_dir).select((2 * F.col("l_partkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst")).distinct())


def order_chain(spark: SparkSession, sf_dir: str) -> Graph:
    """Each part to the next one of its order: directed, cyclic, with parallel edges."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = lineitem(spark, sf_dir).select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return Graph(None, rows.where("dst is not null"))


SPARSE = """p AS MATERIALIZED (SELECT 2*l_partkey AS a, 2*l_suppkey+1 AS b, min(l_extendedprice) AS weight FROM lineitem WHERE l_discount >= 0.10 AND l_quantity >= 45 GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a AS src, b AS dst, weight FROM p UNION ALL SELECT b, a, weight FROM p),
v AS MATERIALIZED (SELECT DISTINCT src AS id FROM e)"""

PART_SUPPLIER = """e AS MATERIALIZED (SELECT DISTINCT 2*l_partkey AS src, 2*l_suppkey+1 AS dst FROM lineitem),
v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)"""

ORDER_CHAIN = """c AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem),
e AS MATERIALIZED (SELECT src, dst FROM c WHERE dst IS NOT NULL),
v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)"""
