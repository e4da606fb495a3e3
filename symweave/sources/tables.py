"""Input tables, and sequences, dictionaries and trees made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, bit): whether an order is finished."""
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("bit"))


def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s): distinct space-separated words of the benchmark items."""
    return table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("s")).where("s <> ''").distinct()


def bfs_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, degree) of root, regions and nations, breadth first. Both tables are of fixed size."""
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("degree"))
    regions = table(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("k"), "left")
    regions = regions.select(F.row_number().over(Window.orderBy("r_regionkey")).cast("long").alias("node"), F.coalesce("degree", F.lit(0)).alias("degree"))
    n = regions.count()
    leaves = table(spark, sf_dir, "nation").select((F.row_number().over(Window.orderBy("n_regionkey", "n_nationkey")) + n).cast("long").alias("node"), F.lit(0).cast("long").alias("degree"))
    root = spark.range(0, 1, 1, 1).select(F.col("id").alias("node"), F.lit(n).cast("long").alias("degree"))  # local rows would pass through Python workers of their own
    return root.unionByName(regions).unionByName(leaves)
