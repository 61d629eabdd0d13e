"""Loading the base tables and the cell, mesh and asset views derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparcel.session import dealt


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CELL_KEYS = ["batch", "x", "y", "z"]


def cells(spark: SparkSession, sf_dir: str, together: Sequence[str] = CELL_KEYS) -> DataFrame:
    """Sparse cells from line items: unique (batch, x, y, z) with summed, maximal and packed features.

    A batch spans 2,000 orders, so batches grow with the data and their density stays put. Cells that agree in ``together`` are in one
    partition, and partitions grow in number and not in size. By all keys suits lookups of cells; by ``batch`` whatever is grouped
    by batch and more stays where it is, and a batch is bounded by its positions.
    """
    table = load(spark, sf_dir, "lineitem")
    items = table.select(
        F.expr("cast(l_orderkey div 2000 as int)").alias("batch"),
        F.expr("cast(l_partkey % 64 as int)").alias("x"),
        F.expr("cast(l_suppkey % 64 as int)").alias("y"),
        F.col("l_linenumber").alias("z"),
        "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus",
    )
    return dealt(items, table.count(), *together).groupBy(*CELL_KEYS).agg(
        F.sum("l_quantity").alias("qty"),
        F.max("l_extendedprice").alias("price"),
        F.max("l_discount").alias("disc"),
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("fa"),
        F.max(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("fb"),
        F.max(F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).alias("fc"),
    )


# SQL twin of cells()
CELLS_SQL = """
cells AS (
  SELECT CAST(l_orderkey // 2000 AS INTEGER) AS batch, CAST(l_partkey % 64 AS INTEGER) AS x,
         CAST(l_suppkey % 64 AS INTEGER) AS y, l_linenumber AS z, sum(l_quantity) AS qty, max(l_extendedprice) AS price,
         max(l_discount) AS disc, count(*) AS n, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS fa,
         max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS fb, max(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS fc
  FROM lineitem GROUP BY 1, 2, 3, 4)
"""
