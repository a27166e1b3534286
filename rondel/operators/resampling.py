"""Problem-block bootstraps.

Draws become weights (replicate, block, weight): how often a block is drawn. They
come from NumPy on the driver, or from md5 so that any engine can repeat them. All
routes share the same draws. Rows are aggregated to block totals first, so a
replicate costs blocks, not rows, and the weights' size is replicates x blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rondel.functions.stats import HOPS_VALID, ratio
from rondel.operators.outcomes import r6


def md5_weights(spark: SparkSession, replicates: int, blocks: int) -> DataFrame:
    """Draw i of replicate r is the first 8 hex digits of md5('r-i'), mod blocks."""
    draws = spark.range(replicates * blocks).select((F.col("id") / blocks).cast("long").alias("replicate"), (F.col("id") % blocks).alias("i"))
    picked = F.conv(F.substring(F.md5(F.concat_ws("-", "replicate", "i")), 1, 8), 16, 10).cast("long") % blocks
    return draws.groupBy("replicate", picked.alias("problem")).agg(F.count("*").alias("weight"))


def numpy_weights(spark: SparkSession, replicates: int, blocks: int, seed: int) -> DataFrame:
    """The draws of NumPy's default generator, counted; block i is the i-th problem in order."""
    import numpy as np

    drawn = np.random.default_rng(seed).integers(0, blocks, (replicates, blocks))
    rows = [(r, int(b), int(n)) for r, row in enumerate(drawn) for b, n in zip(*np.unique(row, return_counts=True))]
    return spark.createDataFrame(rows, "replicate bigint, problem bigint, weight bigint")


def choices_weights(spark: SparkSession, replicates: int, blocks: int, seed: int) -> DataFrame:
    """The draws of random.Random(seed).choices, counted."""
    import random
    from collections import Counter

    rng = random.Random(seed)
    rows = [(r, b, n) for r in range(replicates) for b, n in Counter(rng.choices(range(blocks), k=blocks)).items()]
    return spark.createDataFrame(rows, "replicate bigint, problem bigint, weight bigint")


def block_totals(outcomes: DataFrame) -> DataFrame:
    hit = F.col("category") == "success"
    return outcomes.groupBy("route", "problem").agg(F.count_if(F.col("category").isin(*HOPS_VALID)).alias("valid"), F.count_if(hit).alias("hits"), F.coalesce(F.sum(F.when(hit, F.col("reached_step"))), F.lit(0)).alias("hops"))


def replicate_metrics(outcomes: DataFrame, weights: DataFrame) -> DataFrame:
    """(route, replicate, P, H, D) of each draw, from weighted block totals."""
    sums = [F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("valid", "hits", "hops")]
    out = block_totals(outcomes).join(weights, "problem").groupBy("route", "replicate").agg(*sums)
    p, h = ratio(F.col("hits"), F.col("valid")), ratio(F.col("hops"), F.col("hits"))
    return out.select("route", "replicate", p.alias("P"), h.alias("H"), ratio(h, p).alias("D"))


def interval(replicates: DataFrame, value: str, by: list[str], alpha: float = 0.05, policy: str = "refuse", total: int | None = None) -> DataFrame:
    """Percentile interval of the replicates, by the protocol's rule for undefined ones.

    refuse: any makes it null. drop: they are left out. most: at least 95 % must be defined.
    """
    low, high = F.percentile(value, alpha / 2), F.percentile(value, 1 - alpha / 2)
    n = F.lit(total) if total else F.count("*")
    missing = 1 - F.count(value) / n
    usable = {"refuse": missing == 0, "drop": F.count(value) > 0, "most": missing <= 0.05}[policy]
    return replicates.groupBy(*by).agg(r6(F.when(usable, low)).alias("low"), r6(F.when(usable, high)).alias("high"), r6(missing).alias("missing_fraction"))


def paired_differences(outcomes: DataFrame, weights: DataFrame, value: str = "P", family: int | None = None) -> DataFrame:
    """Interval of each pair of routes' difference over shared draws, Bonferroni-corrected for ``family`` pairs."""
    one = replicate_metrics(outcomes, weights)
    a, b = one.select("replicate", F.col("route").alias("left_route"), F.col(value).alias("x")), one.select("replicate", F.col("route").alias("right_route"), F.col(value).alias("y"))
    pairs = a.join(b, "replicate").filter("left_route < right_route").withColumn("difference", F.col("x") - F.col("y"))
    return interval(pairs, "difference", ["left_route", "right_route"], 0.05 / (family or 1))


def problem_rates(outcomes: DataFrame, weights: DataFrame) -> DataFrame:
    """(route, replicate, rate): mean of the drawn problems' rates; undefined problems drop out."""
    cells = block_totals(outcomes).withColumn("p", ratio(F.col("hits"), F.col("valid"))).filter("p is not null")
    return cells.join(weights, "problem").groupBy("route", "replicate").agg((F.sum(F.col("weight") * F.col("p")) / F.sum("weight")).alias("rate"))


def common_problem_differences(outcomes: DataFrame, weights: DataFrame, family: int = 1) -> DataFrame:
    """Rate differences over the problems that both routes define, per pair of routes."""
    cells = block_totals(outcomes).withColumn("p", ratio(F.col("hits"), F.col("valid"))).filter("p is not null").select("problem", "route", "p")
    a, b = cells.select("problem", F.col("route").alias("left_route"), F.col("p").alias("x")), cells.select("problem", F.col("route").alias("right_route"), F.col("p").alias("y"))
    both = a.join(b, "problem").filter("left_route < right_route").withColumn("difference", F.col("x") - F.col("y"))
    drawn = both.join(weights, "problem").groupBy("left_route", "right_route", "replicate").agg((F.sum(F.col("weight") * F.col("difference")) / F.sum("weight")).alias("difference"))
    return interval(drawn, "difference", ["left_route", "right_route"], 0.05 / family, "drop")


def conditional_medians(outcomes: DataFrame, weights: DataFrame, value: str) -> DataFrame:
    """(route, replicate, median) of the pooled values of drawn problems' successes.

    Medians don't add, so values are first counted by (route, problem, value) and
    weigh by count times draws: replicates cost distinct values, not rows.
    """
    counted = outcomes.filter("category = 'success'").groupBy("route", "problem", F.col(value).alias("x")).agg(F.count("*").alias("n"))
    drawn = counted.join(weights, "problem").groupBy("route", "replicate", "x").agg(F.sum(F.col("weight") * F.col("n")).alias("n"))
    return drawn.groupBy("route", "replicate").agg(F.percentile("x", 0.5, F.col("n")).alias("median"))
