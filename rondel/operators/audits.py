"""Integrity audits: expected against actual sets, and rules over observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOT = ["problem", "route", "attempt"]


def planned_slots(problems: DataFrame, routes: DataFrame, attempts: int) -> DataFrame:
    """Every problem, route and attempt that a campaign plans; all three are small, given lists."""
    numbered = problems.select("problem").withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(attempts))))
    return numbered.join(routes.select("route"), how="cross").select(*SLOT)


def missing(expected: DataFrame, actual: DataFrame, keys: list[str] = SLOT) -> DataFrame:
    return expected.select(*keys).join(actual.select(*keys), keys, "left_anti")


def unplanned(expected: DataFrame, actual: DataFrame, keys: list[str] = SLOT) -> DataFrame:
    return actual.select(*keys).join(expected.select(*keys), keys, "left_anti")


def duplicated(rows: DataFrame, keys: list[str] = SLOT) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def inventory_differences(expected: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, fault) where a hash inventory lacks, adds or changes an entry."""
    a, b = expected.select(key, F.col(digest).alias("expected")), actual.select(key, F.col(digest).alias("actual"))
    fault = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("expected") != F.col("actual"), "changed")
    return a.join(b, key, "full_outer").withColumn("fault", fault).filter("fault is not null").select(key, "fault")


def same_sets(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def leaks(evaluation: DataFrame, prompts: DataFrame, key: str) -> DataFrame:
    """Evaluation rows whose ``key`` is among the prompts'."""
    return evaluation.join(prompts.select(key).distinct(), key, "left_semi")


def duplicate_groups(rows: DataFrame, digest: str) -> DataFrame:
    """(digest, n, first_id) of contents that occur more than once."""
    return rows.groupBy(digest).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


#: rule -> SQL condition that an observation of the hop protocol breaks.
OBSERVATION_RULES = {
    "success_without_step": "category = 'success' and reached_step is null",
    "step_without_success": "category <> 'success' and reached_step is not null",
    "odd_step": "reached_step % 2 <> 0",
    "step_out_of_range": "reached_step < 2 or reached_step > 10",
    "unknown_category": "category not in ('success', 'functional_failure', 'hop_limit', 'invalid', 'incomplete')",
    "no_problem": "problem is null",
}


def violations(outcomes: DataFrame, rules: dict[str, str] = OBSERVATION_RULES) -> DataFrame:
    """(rule, problem, route, attempt) of every broken rule, in one pass over the observations."""
    broken = F.filter(F.array(*[F.when(F.expr(test), F.lit(rule)) for rule, test in rules.items()]), lambda r: r.isNotNull())
    return outcomes.select(F.explode(broken).alias("rule"), *SLOT)


def rederived(recorded: DataFrame, derived: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, recorded, derived) where a replay gives another value, nulls being equal to each other."""
    joined = recorded.alias("r").join(derived.alias("d"), keys, "full_outer")
    pairs = F.filter(F.array(*[F.when(~F.col(f"r.{f}").eqNullSafe(F.col(f"d.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"r.{f}").cast("string").alias("recorded"), F.col(f"d.{f}").cast("string").alias("derived"))) for f in fields]), lambda x: x.isNotNull())
    return joined.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.field", "x.recorded", "x.derived")


def reach_evidence_faults(first_reach: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes whose reached_step isn't the first reach of the steps."""
    return rederived(outcomes, first_reach, ["trial", "threshold"], ["reached_step"])


def complete(outcomes: DataFrame, planned: int) -> DataFrame:
    """Per threshold: whether all planned slots are there and valid."""
    valid = F.col("category").isin("success", "functional_failure", "hop_limit")
    return outcomes.groupBy("threshold").agg(((F.count("*") == planned) & F.bool_and(valid)).alias("complete"))


def eligible(primary: bool, completed: bool, problems: int, routes: int, attempts: int, replicates: int, through_sdk: bool) -> bool:
    """Whether a campaign's intervals may be read as confirmatory."""
    return primary and completed and (problems, routes, attempts) == (15, 4, 5) and replicates == 10_000 and not through_sdk


def case_pairs(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Fixture pairs by (problem, role, case), with the side that is missing."""
    joined = inputs.join(outputs, ["problem", "role", "case"], "full_outer")
    return joined.withColumn("fault", F.when(F.col("input").isNull(), "no_input").when(F.col("expected").isNull(), "no_output"))


def corpus_profile(pairs: DataFrame) -> DataFrame:
    """Per problem: cases, distinct inputs and the largest input."""
    return pairs.groupBy("problem").agg(F.count("*").alias("cases"), F.count_distinct("input").alias("distinct_inputs"), F.max(F.octet_length("input")).alias("max_bytes"), F.count("fault").alias("incomplete"))


def mutant_panel(runs: DataFrame) -> DataFrame:
    """(fault, detected_before, detected_after): whether any case of either suite tells the mutant."""
    seen = lambda suite: F.coalesce(F.bool_or(F.when(F.col("suite") == suite, F.col("actual") != F.col("expected"))), F.lit(False))
    return runs.groupBy("fault").agg(seen("before").alias("detected_before"), seen("after").alias("detected_after"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
