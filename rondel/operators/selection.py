"""Selection of one attempt for each planned slot, with the reason of every slot that has none.

One pass over the joined plan gives each slot its attempt, or the reason it is left out, or the first
rule that its records break; ``chosen``, ``excluded`` and ``faults`` are filters of that one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT = ["run", "problem", "target"]
#: What a chosen attempt's manifest must repeat.
IDENTITY = ("condition_hash", "validation_hash")
# What an active attempt of an infrastructure failure has as status, and what no chosen attempt may have.
_INFRASTRUCTURE, _UNEVALUABLE = ["api_error", "compile_error"], ["running", "api_error"]


def run_faults(runs: DataFrame) -> DataFrame:
    """(run, fault) of runs that can't be pooled: listed twice, of several conditions, or pilots among others.

    ``runs``: (run, condition_hash, phase). A null hash is a condition of its own.
    """
    listed = runs.groupBy("run").agg(F.count("*").alias("times"))
    whole = runs.agg(F.count("*").alias("runs"), F.count_distinct(F.coalesce("condition_hash", F.lit(""))).alias("conditions"), F.count_if(F.coalesce(F.col("phase") != "main", F.lit(True))).alias("pilots"))
    fault = F.when(F.col("times") > 1, "duplicate_run").when(F.col("conditions") > 1, "mixed_conditions").when((F.col("runs") > 1) & (F.col("pilots") > 0), "pooled_pilots")
    # ``whole`` is one row.
    return listed.crossJoin(F.broadcast(whole)).select("run", fault.alias("fault")).filter("fault is not null")


def attempts_of(attempts: DataFrame) -> DataFrame:
    """One row for each slot and attempt id, with ``times``, the number of its records."""
    fields = [c for c in attempts.columns if c not in (*SLOT, "attempt")]
    return attempts.groupBy(*SLOT, "attempt").agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in fields])


def selected(plan: DataFrame, runs: DataFrame, index: DataFrame, attempts: DataFrame) -> DataFrame:
    """(run, problem, target, attempt, status, reason, fault) of each planned slot.

    plan: slots. runs: (run, condition_hash, validation_hash, phase). index: slot, condition_hash, selected, active (attempt ids; null if
    none). attempts: slot, attempt, status, condition_hash, validation_hash, missing_toolchain. ``reason`` tells why a slot is rightly left out:
    ``incomplete`` (no index entry, or what runs isn't done) or ``infrastructure``. ``fault`` is the first broken rule, in the
    order of the checks; a slot with one has no attempt. Nulls in a compared field differ from everything.
    """
    known = attempts_of(attempts)
    doubled = known.groupBy(*SLOT).agg((F.max("times") > 1).alias("doubled"))
    named = lambda prefix: known.select(*SLOT, *[F.col(c).alias(f"{prefix}_{c}") for c in ("attempt", "status", *IDENTITY, "missing_toolchain")])
    per_run = runs.groupBy("run").agg(*[F.first(c).alias(f"run_{c}") for c in IDENTITY]).join(run_faults(runs).withColumnRenamed("fault", "run_fault"), "run", "left")
    rows = plan.select(*SLOT).join(per_run, "run", "left").join(index.select(*SLOT, F.col("condition_hash").alias("index_hash"), "selected", "active", F.lit(True).alias("indexed")), SLOT, "left")
    rows = rows.join(doubled, SLOT, "left")
    rows = rows.withColumn("wanted", F.coalesce("selected", "active"))
    found = named("a").withColumnRenamed("a_attempt", "wanted")
    rows = rows.join(found.withColumn("found", F.lit(True)), [*SLOT, "wanted"], "left")
    same: Column = F.lit(True)
    for field in IDENTITY:
        same = same & F.coalesce(F.col(f"a_{field}") == F.col(f"run_{field}"), F.lit(False))
    indexed, no = F.col("indexed").isNotNull(), F.lit(False)
    has = F.col("selected").isNotNull()
    fault = (
        F.when(F.col("run_fault").isNotNull(), F.col("run_fault"))
        .when(~indexed, F.lit(None))
        .when(F.coalesce("doubled", no), "duplicate_attempt")
        .when(~F.coalesce(F.col("index_hash") == F.col("run_condition_hash"), no), "index_condition_mismatch")
        .when(~has & F.col("found").isNull(), "invalid_active_attempt")
        .when(has & F.col("found").isNull(), "invalid_selected_attempt")
        .when(has & ~same, "manifest_identity_mismatch")
        .when(has & (F.coalesce(F.col("a_status").isin(_UNEVALUABLE), no) | F.coalesce("a_missing_toolchain", no)), "unevaluable_attempt")
    )
    rows = rows.withColumn("fault", fault)
    sound = F.col("fault").isNull()
    reason = F.when(sound & ~indexed, "incomplete").when(sound & ~has, F.when(F.col("a_status").isin(_INFRASTRUCTURE), "infrastructure").otherwise("incomplete"))
    taken = sound & has
    return rows.select(*SLOT, F.when(taken, F.col("wanted")).alias("attempt"), F.when(taken, F.col("a_status")).alias("status"), reason.alias("reason"), "fault")


def chosen(selection: DataFrame) -> DataFrame:
    return selection.filter("attempt is not null").select(*SLOT, "attempt", "status")


def excluded(selection: DataFrame) -> DataFrame:
    return selection.filter("reason is not null").select(*SLOT, "reason")


def faults(selection: DataFrame) -> DataFrame:
    return selection.filter("fault is not null").select(*SLOT, "fault")


def strict(selection: DataFrame) -> DataFrame:
    """``selection``; a fault ends the job and names its slot."""
    told = F.concat_ws(" ", F.col("fault"), F.lit("at"), *SLOT)
    return selection.withColumn("fault", F.when(F.col("fault").isNotNull(), F.raise_error(told)).otherwise(F.col("fault")))


def first_contract(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, contract): of a campaign's candidates (keys, place, contract) that of the least place that there is.

    Places are the order of precedence: the phase's run contract, its contract, the campaign's run contract, its contract.
    """
    return candidates.filter("contract is not null").groupBy(*keys).agg(F.min(F.struct("place", "contract")).alias("c")).select(*keys, "c.place", "c.contract")


def with_pilot(contracts: DataFrame) -> DataFrame:
    """``contracts`` (phase, problem_ids, repeats, pilot_problem_ids, pilot_repeats): in a pilot its own ids and repeats (1 if not told) hold."""
    pilot = F.col("phase") == "pilot"
    return contracts.withColumns({"problem_ids": F.when(pilot, F.col("pilot_problem_ids")).otherwise(F.col("problem_ids")), "repeats": F.when(pilot, F.coalesce("pilot_repeats", F.lit(1))).otherwise(F.col("repeats"))})
