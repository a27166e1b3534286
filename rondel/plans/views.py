"""Views that map the synthetic tables to the engine's concepts.

They stand in for step logs, outcomes, call ledgers and source texts so that the
operators can run and be checked; their numbers say nothing about real chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCKS = 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recorded outcome for each order: problem block, route, attempt, category, reached_step."""
    status = F.col("o_orderstatus")
    category = F.when(status == "F", "success").when(status == "P", "functional_failure").otherwise("hop_limit")
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % BLOCKS).alias("problem"),
        F.col("o_orderpriority").alias("route"),
        F.col("o_orderkey").alias("attempt"),
        category.alias("category"),
        F.when(status == "F", 2 * (1 + F.col("o_orderkey") % 5)).alias("reached_step"),
        F.col("o_totalprice").alias("price"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of each order's chain, numbered within it.

    Chains meet by order key, which both tables shuffle on once; numbering and all
    windows over a chain reuse that partitioning.
    """
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    lines = table(spark, sf_dir, "lineitem").withColumn("step", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("l_orderkey").alias("trial"),
        (F.col("o_custkey") % BLOCKS).alias("problem"),
        F.col("o_orderpriority").alias("route"),
        "step",
        (F.col("step") % 2 == 0).alias("restored"),
        F.when(F.col("l_returnflag") == "R", "wrong_answer").otherwise("success").alias("status"),
        (F.col("l_returnflag") != "R").alias("functional"),
        F.round(F.col("l_discount") * 10, 2).alias("similarity"),
        F.round(F.col("l_tax") * 10, 2).alias("origin_similarity"),
        F.when(F.col("step") % 2 == 0, "cpp").otherwise(F.col("o_orderpriority")).alias("language"),
        F.concat("l_returnflag", "l_linestatus").alias("state"),
        F.when(F.col("l_orderkey") % 2 == 0, "NO").otherwise("AF").alias("seed_state"),
        F.when(F.col("step") <= 10, "discovery").otherwise("confirmation").alias("phase"),
        F.when(F.col("l_quantity") >= 5, F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1e6, 6)).alias("cost"),
        (1 + F.col("l_suppkey") % 3).alias("transports"),
    )


#: The same views for DuckDB.
OUTCOMES_SQL = f"""outcomes AS (SELECT o_custkey % {BLOCKS} AS problem, o_orderpriority AS route, o_orderkey AS attempt,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'functional_failure' ELSE 'hop_limit' END AS category,
  CASE WHEN o_orderstatus = 'F' THEN 2 * (1 + o_orderkey % 5) END AS reached_step, o_totalprice AS price FROM orders)"""

STEPS_SQL = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS step FROM lineitem),
steps AS (SELECT l_orderkey AS trial, o_custkey % {BLOCKS} AS problem, o_orderpriority AS route, step, step % 2 = 0 AS restored,
  CASE WHEN l_returnflag = 'R' THEN 'wrong_answer' ELSE 'success' END AS status, l_returnflag <> 'R' AS functional,
  round(l_discount * 10, 2) AS similarity, round(l_tax * 10, 2) AS origin_similarity,
  CASE WHEN step % 2 = 0 THEN 'cpp' ELSE o_orderpriority END AS language, l_returnflag || l_linestatus AS state, CASE WHEN l_orderkey % 2 = 0 THEN 'NO' ELSE 'AF' END AS seed_state,
  CASE WHEN step <= 10 THEN 'discovery' ELSE 'confirmation' END AS phase,
  CASE WHEN l_quantity >= 5 THEN round(l_extendedprice * (1 - l_discount) / 1e6, 6) END AS cost, 1 + l_suppkey % 3 AS transports
  FROM numbered JOIN orders ON l_orderkey = o_orderkey)"""
