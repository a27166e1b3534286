"""Rankings of routes, their stability, and support of neighbours by intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(summary: DataFrame, metric: str, *by: str) -> DataFrame:
    """rank by metric, smallest first; routes without one have no rank; ties by route."""
    order = Window.partitionBy(*by).orderBy(metric, "route")
    return summary.filter(F.col(metric).isNotNull()).withColumn("rank", F.row_number().over(order))


def stability(ranks: DataFrame, by: str) -> DataFrame:
    """One row: number of different orders over the values of ``by``, and whether they agree."""
    orders = ranks.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "route"))), lambda x: x["route"]), ",").alias("order"))
    return orders.agg(F.count("*").alias("n"), F.count_distinct("order").alias("orders"), (F.count_distinct("order") == 1).alias("stable"))


def neighbour_support(ranks: DataFrame, differences: DataFrame) -> DataFrame:
    """Each neighbour pair of the ranking with its difference's interval; supported if it lies below 0. Stored pairs may be reversed."""
    a = ranks.select(F.col("route").alias("first"), F.col("rank").alias("position"))
    b = ranks.select(F.col("route").alias("second"), (F.col("rank") - 1).alias("position"))
    turned = differences.select(F.col("right_route").alias("first"), F.col("left_route").alias("second"), (-F.col("high")).alias("low"), (-F.col("low")).alias("high"))
    both = differences.select(F.col("left_route").alias("first"), F.col("right_route").alias("second"), "low", "high").unionByName(turned)
    return a.join(b, "position").join(both, ["first", "second"], "left").withColumn("supported", F.coalesce(F.col("high") < 0, F.lit(False)))
