"""Operators over the ordered steps of a chain.

Every window is partitioned by the chain, so all of them share one shuffle, and a
chain is bounded by its protocol's step limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rondel.functions.stats import assessable, ratio, sum_all_known, threshold_key


def _so_far(key: str = "trial", order: str = "step"):
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def _ordered(key: str = "trial", order: str = "step"):
    return Window.partitionBy(key).orderBy(order)


def running_functional(steps: DataFrame) -> DataFrame:
    """functional_so_far: this step and all before it passed."""
    return steps.withColumn("functional_so_far", F.min("functional").over(_so_far()))


def first_reach(steps: DataFrame, thresholds: list[float]) -> DataFrame:
    """(trial, problem, route, threshold, reached_step): the first restored step of at least the threshold, all steps so far functional; null if none."""
    ok = running_functional(steps)
    hit = [F.min(F.when(F.col("restored") & F.col("functional_so_far") & (F.col("similarity") >= t), F.col("step"))).alias(f"r{i}") for i, t in enumerate(thresholds)]
    found = ok.groupBy("trial").agg(F.first("problem").alias("problem"), F.first("route").alias("route"), *hit)
    rows = F.explode(F.array(*[F.struct(threshold_key(F.lit(t)).alias("threshold"), F.col(f"r{i}").alias("reached_step")) for i, t in enumerate(thresholds)]))
    return found.select("trial", "problem", "route", rows.alias("o")).select("trial", "problem", "route", "o.threshold", "o.reached_step")


def state_growth(steps: DataFrame, seed: str = "cpp") -> DataFrame:
    """first_seen_step, duplicate and state_count of each step.

    The seed's state counts as one, seen at step 0; where ``seed_state`` tells it, a
    step that returns to it is a duplicate.
    """
    same = Window.partitionBy("trial", "language", "state")
    first = F.min("step").over(same)
    if "seed_state" in steps.columns:
        first = F.when((F.col("language") == seed) & F.col("state").eqNullSafe(F.col("seed_state")), 0).otherwise(first)
    marked = steps.withColumn("first_seen_step", first).withColumn("duplicate", F.col("step") != first)
    return marked.withColumn("state_count", 1 + F.sum((~F.col("duplicate")).cast("int")).over(_so_far()))


def completed_round_trips(steps: DataFrame) -> DataFrame:
    """round_trips: restored steps so far that passed."""
    return steps.withColumn("round_trips", F.sum((F.col("restored") & F.col("functional")).cast("int")).over(_so_far()))


def restored_states(steps: DataFrame) -> DataFrame:
    """(trial, t, state) of the restored steps, t = 1, 2, ..."""
    return steps.filter("restored").withColumn("t", F.row_number().over(_ordered())).select("trial", "problem", "route", "t", "state")


def fixed_points(states: DataFrame) -> DataFrame:
    """(trial, tau, period, first_period_at): the first t that repeats its predecessor, and the first repetition of period 2 to 4 before that.

    A period p repeats at t if the last p states equal the p before them; it counts
    only while no fixed point was found.
    """
    w = _ordered(order="t")
    back = {k: F.lag("state", k).over(w) for k in range(1, 8)}
    state = F.col("state")
    marked = states.select("trial", "problem", "route", "t", "state", *[c.alias(f"b{k}") for k, c in back.items()])
    value = {0: state} | {k: F.col(f"b{k}") for k in range(1, 8)}
    fixed = value[0] == value[1]

    def repeats(p: int) -> Column:
        test = F.lit(True)
        for k in range(p):
            test = test & (value[k] == value[k + p])
        return test

    period = F.when(F.coalesce(fixed, F.lit(False)), None)
    for p in (2, 3, 4):
        period = period.when(F.coalesce(repeats(p), F.lit(False)), p)
    marked = marked.withColumn("fixed", F.coalesce(fixed, F.lit(False))).withColumn("p", period)
    found = marked.groupBy("trial").agg(
        F.first("problem").alias("problem"), F.first("route").alias("route"), F.min(F.when(F.col("fixed"), F.col("t"))).alias("tau"), F.min_by("p", F.when(F.col("p").isNotNull(), F.col("t"))).alias("p"), F.min(F.when(F.col("p").isNotNull(), F.col("t"))).alias("at"),
    )
    before = F.col("at") < F.coalesce("tau", F.lit(1 << 30))
    return found.select("trial", "problem", "route", "tau", F.when(before, F.col("p")).alias("period"), F.when(before, F.col("at")).alias("period_at"))


def legacy_oscillation(states: DataFrame) -> DataFrame:
    """oscillates: at t, the older rule of period 2 with unequal neighbours."""
    w = _ordered(order="t")
    lag = lambda k: F.lag("state", k).over(w)
    test = (F.col("state") == lag(2)) & (lag(1) == lag(3)) & (F.col("state") != lag(1))
    return states.withColumn("oscillates", F.coalesce(test, F.lit(False)))


def confirmations_held(states: DataFrame) -> DataFrame:
    """(trial, problem, route, tau, held, run): after tau, how many states in a row stay, and how many there are."""
    tau = fixed_points(states).select("trial", "tau")
    after = states.join(tau, "trial").filter("t >= tau")
    same = F.col("state") == F.first("state").over(_ordered(order="t"))
    kept = after.withColumn("kept", F.min(same).over(Window.partitionBy("trial").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    return kept.groupBy("trial").agg(
        F.first("problem").alias("problem"), F.first("route").alias("route"), F.first("tau").alias("tau"), F.sum((F.col("kept") & (F.col("t") > F.col("tau"))).cast("int")).alias("held"), F.sum((F.col("t") > F.col("tau")).cast("int")).alias("run"),
    )


def directed(steps: DataFrame, seed: str = "cpp") -> DataFrame:
    """direction: previous language -> language, the seed's before the first step."""
    return steps.withColumn("direction", F.concat_ws("->", F.lag("language", 1, seed).over(_ordered()), "language"))


def stage_pass_rates(steps: DataFrame) -> DataFrame:
    """Per phase, step and direction: attempts, assessable, unavailable, passed, pass_rate (null if none could be assessed)."""
    ok = assessable(F.col("status"), F.col("functional"))
    grouped = directed(steps).withColumn("ok", ok).groupBy("phase", "step", "direction")
    out = grouped.agg(F.count("*").alias("attempts"), F.count("ok").alias("assessable"), F.count_if(F.col("ok").isNull()).alias("unavailable"), F.count_if("ok").alias("passed"))
    return out.withColumn("pass_rate", F.round(ratio(F.col("passed"), F.col("assessable")), 6))


def call_accounting(steps: DataFrame, by: str = "route") -> DataFrame:
    """Logical and transport calls, retries, and the cost: of the known calls, and strictly of all (null unless all are known)."""
    return steps.groupBy(by).agg(
        F.count("*").alias("logical"),
        F.sum("transports").alias("transport"),
        F.sum(F.greatest(F.lit(0), F.col("transports") - 1)).alias("retries"),
        F.count("cost").alias("known"),
        F.round(F.sum("cost"), 4).alias("known_cost"),
        F.round(sum_all_known(F.col("cost")), 4).alias("total_cost"),
    )


def similarity_scopes(steps: DataFrame) -> DataFrame:
    """Per route and scope (first restoration, all restorations, origin): n, mean, median and quartiles by linear interpolation."""
    scopes = [("first_restoration", F.col("step") == 2, "similarity"), ("all_restorations", F.col("restored"), "similarity"), ("origin", F.col("restored"), "origin_similarity")]
    picked = F.explode(F.filter(F.array(*[F.when(F.col("functional") & test, F.struct(F.lit(name).alias("scope"), F.col(value).alias("x"))) for name, test, value in scopes]), lambda s: s.isNotNull()))
    return steps.select("route", picked.alias("s")).groupBy("route", F.col("s.scope").alias("scope")).agg(
        F.count("s.x").alias("n"), F.round(F.avg("s.x"), 6).alias("mean"), F.round(F.percentile("s.x", 0.5), 6).alias("median"), F.round(F.percentile("s.x", 0.25), 6).alias("q1"), F.round(F.percentile("s.x", 0.75), 6).alias("q3"),
    )


def numbering_faults(steps: DataFrame) -> DataFrame:
    """Chains whose steps aren't 1, 2, ..., n."""
    return steps.groupBy("trial").agg(F.count("*").alias("n"), F.min("step").alias("low"), F.max("step").alias("high"), F.count_distinct("step").alias("distinct")).filter("low <> 1 or high <> n or distinct <> n")


def after_terminal(steps: DataFrame, terminal: Column) -> DataFrame:
    """Steps that follow a terminal one."""
    before = Window.partitionBy("trial").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("ended", F.max(terminal).over(before)).filter("ended").drop("ended")


def status_transitions(steps: DataFrame) -> DataFrame:
    """from_status of each step: the one before, ``running`` at first."""
    return steps.withColumn("from_status", F.lag("status", 1, "running").over(_ordered()))


def contiguous_prefix(steps: DataFrame, complete: Column) -> DataFrame:
    """The steps 1..k up to the first gap or incomplete step: what a resumed run can keep."""
    good = complete & (F.row_number().over(_ordered()) == F.col("step"))
    marked = steps.withColumn("good", good)
    return marked.withColumn("keep", F.min("good").over(_so_far())).filter("keep").drop("good", "keep")


def previous_restored(steps: DataFrame, value: str) -> DataFrame:
    """previous: ``value`` of the restored step before, of an adjacent self-join without a join."""
    held = F.when(F.col("restored"), F.col(value))
    before = Window.partitionBy("trial").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("previous", F.last(held, ignorenulls=True).over(before))


def first_evaluable(attempts: DataFrame, keys: list[str], evaluable: Column) -> DataFrame:
    """The first evaluable attempt of each key; a later one never replaces it."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("attempt"))
    return attempts.filter(evaluable).withColumn("rank_", rank).filter("rank_ = 1").drop("rank_")


def selected_trials(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the first finished attempt, else the last in progress."""
    order = Window.partitionBy(*keys).orderBy(F.desc("finished"), F.when(F.col("finished"), F.col("attempt")).otherwise(-F.col("attempt")))
    return attempts.withColumn("rank_", F.row_number().over(order)).filter("rank_ = 1").drop("rank_")


def first_distinct(rows: DataFrame, keys: list[str], name: str, order: str, k: int = 2) -> DataFrame:
    """The first k rows of distinct ``name`` in each key."""
    first = F.row_number().over(Window.partitionBy(*keys, name).orderBy(order))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("first_", first).filter("first_ = 1").withColumn("rank_", rank).filter(F.col("rank_") <= k).drop("first_", "rank_")


def repeatability(states: DataFrame, instance: Column, run: Column, runs: int) -> DataFrame:
    """Per route: positions that all runs reach, of which all agree, and positions that some run doesn't reach."""
    cells = states.withColumn("instance", instance).withColumn("run", run).groupBy("route", "instance", "t").agg(F.count_distinct("run").alias("n"), F.count_distinct("state").alias("kinds"))
    return cells.groupBy("route").agg(
        F.count_if(F.col("n") == runs).alias("comparable"), F.count_if((F.col("n") == runs) & (F.col("kinds") == 1)).alias("matched"), F.count_if(F.col("n") < runs).alias("unreached"),
    )
