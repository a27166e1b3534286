"""Grouped statistics of recorded outcomes, with explicit denominators.

``outcomes``: (problem, route, attempt, category, reached_step), one row for each
slot. Every summary is one hash aggregate, or two levels of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rondel.functions.stats import HOPS_CATEGORIES, HOPS_VALID, ratio, wilson

#: What a failure counts as in the penalised distance.
PENALTY = 11


def r6(x: Column) -> Column:
    return F.round(x, 6)


def _counts() -> list[Column]:
    valid, hit = F.col("category").isin(*HOPS_VALID), F.col("category") == "success"
    return [F.count_if(valid).alias("valid"), F.count_if(hit).alias("hits"), F.sum(F.when(hit, F.col("reached_step"))).alias("hops")]


def _metrics(out: DataFrame) -> DataFrame:
    """P = hits / valid, H = hops / hits, D = H / P of the pooled sums; null where a denominator is 0."""
    p, h = ratio(F.col("hits"), F.col("valid")), ratio(F.col("hops"), F.col("hits"))
    return out.withColumn("P", r6(p)).withColumn("H", r6(h)).withColumn("D", r6(ratio(h, p)))


def reach_metrics(outcomes: DataFrame, *by: str) -> DataFrame:
    return _metrics(outcomes.groupBy(*by).agg(*_counts())).drop("hops")


def route_summary(plan: DataFrame, recorded: DataFrame) -> DataFrame:
    """Per route, from the plan: slots that were never recorded are incomplete, never failures."""
    slots = plan.join(recorded, ["problem", "route", "attempt"], "left")
    slots = slots.withColumn("recorded", F.col("category").isNotNull()).withColumn("category", F.coalesce("category", F.lit("incomplete")))
    counts = [F.count_if(F.col("category") == c).alias(c) for c in HOPS_CATEGORIES]
    out = slots.groupBy("route").agg(F.count("*").alias("planned"), F.count_if("recorded").alias("n_recorded"), *counts, *_counts())
    return _metrics(out).drop("hops", "hits")


def per_problem(plan: DataFrame, recorded: DataFrame) -> DataFrame:
    """P, H and D of each planned (problem, route); all are there, even without a record."""
    return _metrics(plan.select("problem", "route", "attempt").join(recorded, ["problem", "route", "attempt"], "left").groupBy("problem", "route").agg(*_counts())).drop("hops")


def problem_mean(outcomes: DataFrame) -> DataFrame:
    """Mean of the problems' P, each of equal weight, beside the pooled P."""
    cells = outcomes.groupBy("route", "problem").agg(*_counts())
    out = cells.withColumn("p", ratio(F.col("hits"), F.col("valid"))).groupBy("route").agg(F.count("p").alias("problems"), r6(F.avg("p")).alias("problem_mean"), r6(ratio(F.sum("hits"), F.sum("valid"))).alias("pooled"))
    return out


def failure_reasons(outcomes: DataFrame, reason: Column) -> DataFrame:
    """Counts by route and reason, else category, of what neither succeeded nor is incomplete."""
    return outcomes.filter(~F.col("category").isin("success", "incomplete")).groupBy("route", F.coalesce(reason, F.col("category")).alias("reason")).agg(F.count("*").alias("n"))


def with_wilson(outcomes: DataFrame, *by: str) -> DataFrame:
    """Rate and both Wilson intervals: clamped, and not."""
    out = outcomes.groupBy(*by).agg(*_counts())
    low, high = wilson(F.col("hits"), F.col("valid"))
    free_low, free_high = wilson(F.col("hits"), F.col("valid"), clamp=False)
    return out.select(*by, "valid", "hits", r6(low).alias("low"), r6(high).alias("high"), r6(free_low).alias("free_low"), r6(free_high).alias("free_high"))


def retention(outcomes: DataFrame, *by: str) -> DataFrame:
    """confirmation of primary successes: passed / (passed + failed), and the share that is unavailable."""
    hit = F.col("category") == "success"
    count = lambda x: F.count_if(hit & (F.col("confirmation") == x))
    out = outcomes.groupBy(*by).agg(F.count_if(hit).alias("successes"), count("passed").alias("passed"), count("failed").alias("failed"), F.count_if(hit & (F.col("confirmation").isNull() | (F.col("confirmation") == "unavailable"))).alias("unavailable"))
    return out.withColumn("retention", r6(ratio(F.col("passed"), F.col("passed") + F.col("failed")))).withColumn("unavailable_share", r6(ratio(F.col("unavailable"), F.col("successes"))))


def fps_summary(outcomes: DataFrame) -> DataFrame:
    """Per route: problem mean of success, pooled rate, mean d_n, and the penalised distance d+.

    ``outcomes``: (problem, route, category, d_n). Anything but invalid is valid; an
    undefined problem drops out of the means.
    """
    valid, hit = F.col("category") != "invalid", F.col("category") == "success"
    cells = outcomes.groupBy("route", "problem").agg(F.count_if(valid).alias("valid"), F.count_if(hit).alias("hits"), F.sum(F.when(hit, F.col("d_n"))).alias("d_sum"))
    penalised = ratio(F.coalesce("d_sum", F.lit(0)) + PENALTY * (F.col("valid") - F.col("hits")), F.col("valid"))
    out = cells.withColumn("p", ratio(F.col("hits"), F.col("valid"))).withColumn("d_plus", penalised).groupBy("route").agg(
        r6(F.avg("p")).alias("p_sf"), r6(ratio(F.sum("hits"), F.sum("valid"))).alias("pooled_p"), F.sum("valid").alias("valid"), r6(ratio(F.sum("d_sum"), F.sum("hits"))).alias("d_n"), F.count("d_sum").alias("d_n_problems"), r6(F.avg("d_plus")).alias("d_plus"),
    )
    return out


def research_estimates(outcomes: DataFrame, weighting: str, penalty: float = PENALTY) -> DataFrame:
    """success_rate (pooled, or the problems' mean), mean_hops, hop_adjusted_distance = hops / rate, penalised state distance."""
    cells = outcomes.groupBy("route", "problem").agg(*_counts())
    penalised = F.coalesce("hops", F.lit(0)) + penalty * (F.col("valid") - F.col("hits"))
    grouped = cells.withColumn("p", ratio(F.col("hits"), F.col("valid"))).withColumn("pen", penalised).groupBy("route")
    pooled = weighting == "pooled"
    rate = ratio(F.sum("hits"), F.sum("valid")) if pooled else F.avg("p")
    distance = ratio(F.sum("pen"), F.sum("valid")) if pooled else F.avg(ratio(F.col("pen"), F.col("valid")))
    out = grouped.agg(rate.alias("rate"), ratio(F.sum("hops"), F.sum("hits")).alias("mean"), distance.alias("pen"))
    return out.select("route", F.lit(weighting).alias("weighting"), r6(F.col("rate")).alias("success_rate"), r6(F.col("mean")).alias("mean_hops"), r6(ratio(F.col("mean"), F.col("rate"))).alias("hop_adjusted_distance"), r6(F.col("pen")).alias("penalised_distance"))


def measurement_summary(measurements: DataFrame, *by: str) -> DataFrame:
    """Mean, n and status counts of (metric, status, value)."""
    return measurements.groupBy(*by, "metric").agg(
        r6(F.avg(F.when(F.col("status") == "measured", F.col("value")))).alias("mean"), F.count_if(F.col("status") == "measured").alias("measured"), F.count_if(F.col("status") != "measured").alias("unmeasured"),
    )


def legacy_aggregate(outcomes: DataFrame, value: Column) -> DataFrame:
    """Measured, unavailable, mean and population deviation; divergent are the measured that aren't a fixed point."""
    measured = F.col("category").isin("success", "hop_limit")
    return outcomes.groupBy("route").agg(
        F.count_if(measured).alias("measured"), F.count_if(~measured).alias("unavailable"), r6(F.avg(F.when(measured, value))).alias("mean"), F.round(F.stddev_pop(F.when(measured, value)), 4).alias("stddev"),
        r6(ratio(F.count_if(F.col("category") == "hop_limit"), F.count_if(measured))).alias("divergence_rate"),
    )


def by_confirmation(outcomes: DataFrame, most: int) -> DataFrame:
    """Per route and number of confirmations c: success (held >= c), rate and distance 1 - rate; success never grows with c."""
    rows = outcomes.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(most))))
    hit = F.col("tau").isNotNull() & (F.col("held") >= F.col("c"))
    out = rows.groupBy("route", "c").agg(F.count("*").alias("n"), F.count_if(hit).alias("successes"))
    return out.withColumn("p", r6(ratio(F.col("successes"), F.col("n")))).withColumn("d", r6(1 - ratio(F.col("successes"), F.col("n"))))


def failure_table(outcomes: DataFrame, categories: list[str]) -> DataFrame:
    """Every category of every route, with 0 where there is none; the denominator is all of the route."""
    counted = outcomes.groupBy("route").agg(F.count("*").alias("total"), *[F.count_if(F.col("category") == c).alias(f"n_{i}") for i, c in enumerate(categories)])
    row = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"n_{i}").alias("n")) for i, c in enumerate(categories)]))
    return counted.select("route", "total", row.alias("r")).select("route", "r.category", "r.n", r6(ratio(F.col("r.n"), F.col("total"))).alias("share"))


def conditional_quartiles(outcomes: DataFrame, value: str, *by: str) -> DataFrame:
    """Median and quartiles among successes that have a value, and how often they have."""
    hit = F.col("category") == "success"
    x = F.when(hit, F.col(value))
    return outcomes.groupBy(*by).agg(F.count(x).alias("n"), r6(F.percentile(x, 0.5)).alias("median"), r6(F.percentile(x, 0.25)).alias("q1"), r6(F.percentile(x, 0.75)).alias("q3"), r6(ratio(F.count(x), F.count_if(hit))).alias("measured_share"))


def run_spread(outcomes: DataFrame, run: Column) -> DataFrame:
    """Mean, least and largest of the runs' rates."""
    cells = outcomes.groupBy("route", run.alias("run")).agg(*_counts()).withColumn("p", ratio(F.col("hits"), F.col("valid")))
    return cells.groupBy("route").agg(r6(F.avg("p")).alias("mean"), r6(F.min("p")).alias("low"), r6(F.max("p")).alias("high"))


def group_contrast(outcomes: DataFrame, groups: DataFrame) -> DataFrame:
    """P and D by group of problems, side by side: group first, the others second, and the difference."""
    cells = _metrics(outcomes.join(groups, "problem", "left").groupBy("route", "in_group").agg(*_counts()))
    side = lambda test, name: F.max(F.when(F.col("in_group") == test, F.col(name)))
    out = cells.groupBy("route").agg(*[side(t, n).alias(f"{n}_{w}") for n in ("P", "D") for t, w in ((True, "in"), (False, "out"))])
    return out.withColumn("P_difference", r6(F.col("P_in") - F.col("P_out"))).withColumn("D_difference", r6(F.col("D_in") - F.col("D_out")))


def grouping_sets(by_threshold: DataFrame) -> DataFrame:
    """Completeness over (route, threshold), threshold and all together in one pass; level tells which."""
    valid = F.col("category").isin(*HOPS_VALID)
    out = by_threshold.rollup("threshold", "route").agg(F.grouping_id().alias("level"), F.count("*").alias("slots"), F.count_if(valid).alias("valid"), F.bool_and(valid).alias("complete"), F.count_if(F.col("category") == "success").alias("successes"))
    return out


def bounds(outcomes: DataFrame) -> DataFrame:
    """Rates if all unmeasured slots had failed, and if all had succeeded."""
    hit, valid = F.count_if(F.col("category") == "success"), F.count_if(F.col("category").isin(*HOPS_VALID))
    return outcomes.groupBy("route").agg(r6(ratio(hit, F.count("*"))).alias("low"), r6(ratio(hit + F.count("*") - valid, F.count("*"))).alias("high"))


def wide(by_threshold: DataFrame, value: str, thresholds: list[str]) -> DataFrame:
    """One column for each threshold."""
    return by_threshold.groupBy("route").pivot("threshold", thresholds).agg(F.first(value))


def fps_totals(outcomes: DataFrame, planned: int) -> DataFrame:
    """Per route of the state-distance protocol: what was planned and recorded, success by problem and pooled with Wilson's interval, and totals.

    ``outcomes``: (problem, route, category, d_n, duplicate_steps, translation_steps, cost_usd). Anything but invalid is valid; ``planned`` slots are each route's. The cost
    is that of the known ones, null if none is.
    """
    valid, hit = F.col("category") != "invalid", F.col("category") == "success"
    totals = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("duplicate_steps", "translation_steps")]
    cells = outcomes.groupBy("route", "problem").agg(F.count("*").alias("recorded"), F.count_if(valid).alias("valid"), F.count_if(hit).alias("success"), F.count_if(F.col("category") == "invalid").alias("invalid"), F.count(F.when(hit, F.col("d_n"))).alias("told"), *totals, F.sum("cost_usd").alias("cost_usd"))
    out = cells.withColumn("p", ratio(F.col("success"), F.col("valid"))).groupBy("route").agg(
        *[F.sum(c).alias(c) for c in ("recorded", "valid", "success", "invalid", "duplicate_steps", "translation_steps", "cost_usd")], F.avg("p").alias("p_sf"), F.count("p").alias("p_sf_problems"), F.count_if(F.col("told") > 0).alias("d_n_problems"),
    )
    low, high = wilson(F.col("success"), F.col("valid"))
    return out.select(
        "route", F.lit(planned).cast("bigint").alias("planned"), "recorded", (F.lit(planned) - F.col("recorded")).alias("incomplete"), "valid", "success", "invalid", r6(F.col("p_sf")).alias("p_sf"), "p_sf_problems",
        r6(ratio(F.col("success"), F.col("valid"))).alias("p_sf_pooled"), r6(low).alias("wilson_low"), r6(high).alias("wilson_high"), "d_n_problems", "duplicate_steps", "translation_steps", F.round("cost_usd", 4).alias("cost_usd"),
    )


def downgraded(category: Column, measured: Column, terminal: Column) -> Column:
    """The category, but invalid for what wasn't reached where a limit stopped a chain of which nothing was measured."""
    blind = (measured == 0) & terminal.isin("max_distance_reached", "translation_budget_reached")
    return F.when(F.coalesce(blind, F.lit(False)) & (category != "success"), "invalid").otherwise(category)
