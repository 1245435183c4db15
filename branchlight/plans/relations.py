"""The driver's tables in the shape of the engine's relations, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line is a rollout: its customer is the prompt (uid), its order the tree, its discount the reward."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tree_uid"), F.col("o_custkey").alias("uid"), F.col("o_orderpriority").alias("data_source"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tree_uid"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), (F.col("l_discount") * 10).alias("score"), F.col("l_quantity").alias("tokens"))
    return lines.join(orders, "tree_uid")


ROLLOUTS = """rollouts AS (
  SELECT l_orderkey AS tree_uid, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, l_discount * 10 AS score, l_quantity AS tokens, o_custkey AS uid, o_orderpriority AS data_source
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def r6(column, name: str):
    """Six decimals, without a negative zero."""
    return (F.round(column, 6) + F.lit(0.0)).alias(name)


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer trees as an edge list: the customer is the root, orders its children, lines the leaves."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    root = orders.select("o_custkey").distinct().select(F.col("o_custkey").alias("tree_uid"), F.concat(F.lit("c"), "o_custkey").alias("node_uid"), F.lit(None).cast("string").alias("parent_node_uid"), F.lit(0).alias("depth"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("log_prob_node"))
    middle = orders.select(F.col("o_custkey").alias("tree_uid"), F.concat(F.lit("o"), "o_orderkey").alias("node_uid"), F.concat(F.lit("c"), "o_custkey").alias("parent_node_uid"), F.lit(1).alias("depth"), (F.col("o_totalprice") % 1).alias("score"), (-F.col("o_totalprice") / 100000).alias("log_prob_node"))
    leaf = lines.select(F.col("o_custkey").alias("tree_uid"), _leaf_name().alias("node_uid"), F.concat(F.lit("o"), "l_orderkey").alias("parent_node_uid"), F.lit(2).alias("depth"), (F.col("l_discount") * 10).alias("score"), (-F.col("l_tax") * 10).alias("log_prob_node"))
    return root.unionByName(middle).unionByName(leaf)


def _leaf_name():
    return F.concat_ws("-", F.lit("l"), *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])


#: Orders without lines are childless nodes, that is leaves with their own score.
NODES = """nodes AS (
  SELECT DISTINCT o_custkey AS tree_uid, 'c' || o_custkey AS node_uid, CAST(NULL AS VARCHAR) AS parent_node_uid, 0 AS depth, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS DOUBLE) AS log_prob_node FROM orders
  UNION ALL SELECT o_custkey, 'o' || o_orderkey, 'c' || o_custkey, 1, o_totalprice % 1, -o_totalprice / 100000 FROM orders
  UNION ALL SELECT o_custkey, 'l-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'o' || l_orderkey, 2, l_discount * 10, -l_tax * 10 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
