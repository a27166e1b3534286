"""Decisions stored with their state, folded on from there, and replayed from the saved steps.

A stored state is what a protocol's fold knows after a chain's steps so far. Going on reads
only the steps behind it; a chain's later steps meet its state by the chain's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rondel.operators.chains import contiguous_prefix
from rondel.operators.folds import Protocol, collected


def states(steps: DataFrame, protocol: Protocol) -> DataFrame:
    """(trial, problem, route, seed_state, through, end): the state of each chain and the number of the last step in it."""
    chains = collected(steps)
    return chains.select("trial", "problem", "route", "seed_state", F.element_at("steps", -1)["step"].alias("through"), F.aggregate("steps", protocol.zero, protocol.step).alias("end"))


def resumed(before: DataFrame, steps: DataFrame, protocol: Protocol) -> DataFrame:
    """``before``, states of ``states``, with the steps behind them folded in; chains that are new begin from nothing.

    ``steps`` may hold old steps too; they are left out before anything is gathered.
    """
    known = before.select("trial", "through")
    later = steps.join(known, "trial", "left").filter(F.col("step") > F.coalesce("through", F.lit(0))).drop("through")
    new = collected(later).select("trial", F.col("problem").alias("problem_"), F.col("route").alias("route_"), F.col("seed_state").alias("seed_"), "steps")
    both = before.join(new, "trial", "full_outer")
    both = both.select("trial", *[F.coalesce(c, n).alias(c) for c, n in (("problem", "problem_"), ("route", "route_"), ("seed_state", "seed_"))], "through", "end", "steps")
    folded = F.aggregate("steps", F.coalesce("end", protocol.zero), protocol.step)
    return both.select("trial", "problem", "route", "seed_state", F.coalesce(F.element_at("steps", -1)["step"], "through").alias("through"), F.when(F.col("steps").isNull(), F.col("end")).otherwise(folded).alias("end"))


def next_steps(states: DataFrame, max_hops: int = 10) -> DataFrame:
    """(trial, kind) of the step that each chain of the hop protocol does next: ``discovery``, a ``confirmation`` that is due, or ``stop``."""
    n = F.col("end.n")
    kind = F.when(F.col("end.ended"), "stop").when(n < max_hops, "discovery").when(F.col("end.due").isNotNull() & F.col("end.confirmation").isNull(), "confirmation").otherwise("stop")
    return states.select("trial", kind.alias("kind"))


def resume_plan(steps: DataFrame, complete: Column) -> DataFrame:
    """(trial, kept, start, previous_status, dropped): what a run of each chain can keep, and where it goes on.

    Steps 1 to k up to the first gap or incomplete step are kept; what follows is dropped and done again. A chain without
    such steps starts at 1, from the status ``running``.
    """
    whole = steps.groupBy("trial").agg(F.count("*").alias("n"))
    kept = contiguous_prefix(steps, complete).groupBy("trial").agg(F.max("step").alias("kept"), F.max_by("status", "step").alias("previous_status"))
    out = whole.join(kept, "trial", "left")
    number = F.coalesce("kept", F.lit(0)).cast("int")
    return out.select("trial", number.alias("kept"), (number + 1).alias("start"), F.coalesce("previous_status", F.lit("running")).alias("previous_status"), (F.col("n") - number).alias("dropped"))


def replayed(recorded: DataFrame, steps: DataFrame, protocol: Protocol, fields: list[str]) -> DataFrame:
    """(trial, reason, matches, differences): each chain decided anew from its saved steps, against the recorded decision.

    reason is ``saved_history_exhausted`` where the steps end before the protocol does. differences: array of (field, recorded,
    derived); nulls are equal to each other. A chain on one side only doesn't match.
    """
    return replayed_chains(recorded, collected(steps), protocol, fields)


def replayed_chains(recorded: DataFrame, chains: DataFrame, protocol: Protocol, fields: list[str]) -> DataFrame:
    """``replayed`` from chains of ``collected``; a chain's recorded and derived decisions meet in one join."""
    again = protocol.fold(chains).select("trial", "terminal", F.lit(True).alias("steps"), *[F.col(f).alias(f"{f}__derived") for f in fields])
    told = recorded.select("trial", F.lit(True).alias("told"), *[F.col(f).alias(f"{f}__recorded") for f in fields])
    both = told.join(again, "trial", "full_outer")
    one = lambda f: F.when(~F.col(f"{f}__recorded").eqNullSafe(F.col(f"{f}__derived")), F.struct(F.lit(f).alias("field"), F.col(f"{f}__recorded").cast("string").alias("recorded"), F.col(f"{f}__derived").cast("string").alias("derived")))
    differences = F.array_sort(F.filter(F.array(*map(one, fields)), lambda x: x.isNotNull()))
    reason = F.when(F.col("steps").isNull(), "no_steps").when(F.col("told").isNull(), "not_recorded").when(F.col("terminal").isNull(), "saved_history_exhausted")
    both = both.withColumn("differences", differences)
    return both.select("trial", reason.alias("reason"), ((F.size("differences") == 0) & F.col("steps").isNotNull() & F.col("told").isNotNull()).alias("matches"), "differences")


def replay_summary(replays: DataFrame) -> DataFrame:
    """One row: chains, how many match, and whether all do."""
    return replays.agg(F.count("*").alias("recorded"), F.count_if("matches").alias("matched"), F.coalesce(F.bool_and("matches"), F.lit(True)).alias("matches_original"))


def iteration_outcomes(iterations: DataFrame) -> DataFrame:
    """(trial, iteration, status, passed, duplicate, from_status): each round trip of two steps as one row.

    ``iterations``: (trial, iteration, step, status, hash). It passed if it has two steps that both did; its status is that of the first
    step that failed. A hash that an earlier iteration of the chain had is a duplicate.
    """
    failed = F.min(F.when(F.col("status") != "success", F.struct("step", "status")))
    rows = iterations.groupBy("trial", "iteration").agg(F.count("*").alias("n"), failed["status"].alias("failed"), F.max_by("hash", "step").alias("hash"))
    rows = rows.withColumn("passed", (F.col("n") == 2) & F.col("failed").isNull())
    rows = rows.withColumn("status", F.coalesce("failed", F.when(F.col("n") == 2, "success").otherwise("incomplete")))
    order, seen = Window.partitionBy("trial").orderBy("iteration"), Window.partitionBy("trial", "hash").orderBy("iteration")
    duplicate = F.col("hash").isNotNull() & (F.row_number().over(seen) > 1)
    return rows.select("trial", "iteration", "status", "passed", duplicate.alias("duplicate"), F.lag("status", 1, "running").over(order).alias("from_status"))
