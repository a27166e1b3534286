"""Sequential reducers: one fold over a chain's steps gives its outcome.

``aggregate`` can't stop early, so each state carries whether the chain has ended;
steps after that change nothing. Arrays are bounded by the protocol's step limit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rondel.functions.stats import ABORTING, fps_category, threshold_key

STEP = ["step", "restored", "status", "similarity", "language", "state"]


@dataclass(frozen=True)
class Protocol:
    """A fold: its state before any step, what a step makes of it, and the decision of chains with the state ``end``, beside columns to keep."""

    zero: Column
    step: Callable[[Column, Column], Column]
    decided: Callable[..., DataFrame]

    def fold(self, chains: DataFrame, *keep: str) -> DataFrame:
        return self.decided(chains.withColumn("end", F.aggregate("steps", self.zero, self.step)), *keep)


def collected(steps: DataFrame, most: int | None = None) -> DataFrame:
    """One row for each chain with its steps in order, and seed_state, the seed's own (null where unknown).

    ``most``: the last step at which the protocol can still decide anything; the
    steps after it change no outcome and aren't gathered.
    """
    if most is not None:
        steps = steps.filter(F.col("step") <= most)
    seed = F.first("seed_state") if "seed_state" in steps.columns else F.lit(None).cast("string")
    return steps.groupBy("trial").agg(F.first("problem").alias("problem"), F.first("route").alias("route"), seed.alias("seed_state"), F.array_sort(F.collect_list(F.struct(*STEP))).alias("steps"))


def _with(a: Column, fields: dict[str, str], **changes: Column) -> Column:
    return F.struct(*[(changes[n] if n in changes else a[n]).cast(t).alias(n) for n, t in fields.items()])


def _by_threshold(thresholds: list[float], of) -> Column:
    return F.array(*[F.struct(threshold_key(F.lit(t)).alias("threshold"), *of(i, t)) for i, t in enumerate(thresholds)])


def hops(chains: DataFrame, thresholds: list[float], primary: float, max_hops: int = 10) -> DataFrame:
    """``hops_protocol`` folded over whole chains."""
    return hops_protocol(thresholds, primary, max_hops).fold(chains)


def hops_protocol(thresholds: list[float], primary: float, max_hops: int = 10) -> Protocol:
    """First-reach hops with one confirmation: (trial, problem, route, confirmation, terminal, outcomes).

    outcomes: array of (threshold, category, reached_step). A functional failure or
    an aborted step ends the chain; a restored step needs a similarity in [0, 1];
    reaching is for steps up to ``max_hops``; the primary threshold asks for one
    confirmation two steps later.
    """
    thresholds = sorted(thresholds)
    k = thresholds.index(primary)
    fields = {"ended": "boolean", "n": "int", "confirmation": "string", "due": "int", "terminal": "string"}
    fields |= {f"{x}{i}": t for i in range(len(thresholds)) for x, t in (("c", "string"), ("r", "int"))}
    zero = F.struct(*[F.lit({"boolean": False, "int": 0 if n == "n" else None, "string": "incomplete" if n.startswith("c") and n != "confirmation" else None}[t]).cast(t).alias(n) for n, t in fields.items()])

    def step(a: Column, s: Column) -> Column:
        n = a["n"] + 1
        failed = s["status"] != "success"
        unmeasured = (n % 2 == 0) & ~F.coalesce((s["similarity"] >= 0) & (s["similarity"] <= 1) & ~F.isnan(s["similarity"]), F.lit(False))
        abort = (failed & s["status"].isin(*ABORTING)) | (~failed & unmeasured)
        fail = failed & ~abort
        good = ~abort & ~fail
        pending = a["due"].isNotNull() & a["confirmation"].isNull()
        changes = {"n": n}
        reached = {}
        for i, t in enumerate(thresholds):
            free = a[f"c{i}"] == "incomplete"
            hit = good & free & (n % 2 == 0) & (n <= max_hops) & (s["similarity"] >= t)
            reached[i] = hit
            rest = F.when(abort, "invalid").when(fail, "functional_failure").when(n == max_hops, "hop_limit")
            changes[f"c{i}"] = F.when(hit, "success").when(free & rest.isNotNull(), rest).otherwise(a[f"c{i}"])
            changes[f"r{i}"] = F.when(hit, n).otherwise(a[f"r{i}"])
        due = F.when(reached[k], n + 2).otherwise(a["due"])
        changes["due"] = due
        told = F.when(pending & abort, "unavailable").when(pending & fail, "failed").when(pending & good & (a["due"] == n), F.when(s["similarity"] >= primary, "passed").otherwise("failed"))
        confirmation = F.coalesce(a["confirmation"], told)
        changes["confirmation"] = confirmation
        every = F.lit(True)
        for i in range(len(thresholds)):
            every = every & (changes[f"c{i}"] == "success")
        terminal = F.when(abort, "infrastructure_error").when(fail, "functional_failure").when(confirmation.isNotNull() & (every | (n >= max_hops)), "collection_complete").when((n >= max_hops) & due.isNull(), "hop_limit")
        changes["terminal"] = terminal
        changes["ended"] = terminal.isNotNull()
        return F.when(a["ended"], a).otherwise(_with(a, fields, **changes))

    out = _by_threshold(thresholds, lambda i, t: (F.col(f"end.c{i}").alias("category"), F.col(f"end.r{i}").alias("reached_step")))
    return Protocol(zero, step, lambda done, *keep: done.select("trial", "problem", "route", F.col("end.confirmation").alias("confirmation"), F.col("end.terminal").alias("terminal"), F.col("end.n").alias("n_steps"), out.alias("outcomes"), *keep))


def fps(chains: DataFrame, thresholds: list[float], max_states: int = 10, max_steps: int = 20, seed: str = "cpp") -> DataFrame:
    """``fps_protocol`` folded over whole chains."""
    return fps_protocol(thresholds, max_states, max_steps, seed).fold(chains)


def fps_protocol(thresholds: list[float], max_states: int = 10, max_steps: int = 20, seed: str = "cpp") -> Protocol:
    """Unique-state distance: (trial, problem, route, terminal, states_at_stop, outcomes).

    outcomes: array of (threshold, category, d_n, reached_step, reached_roundtrip).
    In each step: a failure ends; then too many states end, before similarity is
    looked at; an unmeasured similarity is skipped; the largest threshold reached
    ends; then the step budget. The first state is the seed's: its language ``seed``
    and ``seed_state``, so a step that returns to it is no new state.
    """
    thresholds = sorted(thresholds)
    fields = {"ended": "boolean", "n": "int", "trips": "int", "terminal": "string", "seen": "array<string>", "measured": "int"}
    fields |= {f"{x}{i}": "int" for i in range(len(thresholds)) for x in ("d", "r", "t")}
    begin = {"boolean": F.lit(False), "string": F.lit(None), "int": F.lit(None), "array<string>": F.array(F.concat_ws(":", F.lit(seed), F.col("seed_state")))}
    zero = F.struct(*[(F.lit(0) if n in ("n", "trips", "measured") else begin[t]).cast(t).alias(n) for n, t in fields.items()])

    def step(a: Column, s: Column) -> Column:
        n, key = a["n"] + 1, F.concat_ws(":", s["language"], s["state"])
        seen = F.when(F.array_contains(a["seen"], key), a["seen"]).otherwise(F.concat(a["seen"], F.array(key)))
        failed = s["status"] != "success"
        trips = a["trips"] + F.when(~failed & s["restored"], 1).otherwise(0)
        over = ~failed & (F.size(seen) > max_states)
        measured = ~failed & ~over & s["restored"] & s["similarity"].isNotNull()
        changes = {"n": n, "trips": trips, "seen": seen, "measured": a["measured"] + measured.cast("int")}
        for i, t in enumerate(thresholds):
            hit = measured & a[f"d{i}"].isNull() & (s["similarity"] >= t)
            for x, value in (("d", F.size(seen)), ("r", n), ("t", trips)):
                changes[f"{x}{i}"] = F.when(hit, value).otherwise(a[f"{x}{i}"])
        complete = measured & changes[f"d{len(thresholds) - 1}"].isNotNull()
        changes["terminal"] = F.when(failed, s["status"]).when(over, "max_distance_reached").when(complete, "collection_complete").when(n >= max_steps, "translation_budget_reached")
        changes["ended"] = changes["terminal"].isNotNull()
        return F.when(a["ended"], a).otherwise(_with(a, fields, **changes))

    # Never measured, and stopped by a limit: what wasn't reached tells nothing.
    blind = (F.col("end.measured") == 0) & F.col("end.terminal").isin("max_distance_reached", "translation_budget_reached")
    unreached = F.when(F.col("end.terminal").isNull(), "incomplete").when(blind, "invalid").otherwise(fps_category(F.col("end.terminal")))
    out = _by_threshold(
        thresholds,
        lambda i, t: (
            F.when(F.col(f"end.d{i}").isNotNull(), "success").otherwise(unreached).alias("category"),
            F.col(f"end.d{i}").alias("d_n"), F.col(f"end.r{i}").alias("reached_step"), F.col(f"end.t{i}").alias("reached_roundtrip"),
        ),
    )
    return Protocol(zero, step, lambda done, *keep: done.select("trial", "problem", "route", F.col("end.terminal").alias("terminal"), F.size("end.seen").alias("states_at_stop"), out.alias("outcomes"), *keep))


def threshold_policy(chains: DataFrame, threshold: float, max_steps: int) -> DataFrame:
    """(trial, status, category, reached_step): converged at the first measured restored step of the threshold."""
    fields = {"ended": "boolean", "n": "int", "measured": "int", "status": "string", "category": "string", "reached": "int"}
    zero = F.struct(F.lit(False).alias("ended"), F.lit(0).alias("n"), F.lit(0).alias("measured"), F.lit(None).cast("string").alias("status"), F.lit("incomplete").alias("category"), F.lit(None).cast("int").alias("reached"))

    def step(a: Column, s: Column) -> Column:
        n, failed = a["n"] + 1, s["status"] != "success"
        measured = ~failed & s["restored"] & s["similarity"].isNotNull()
        count = a["measured"] + measured.cast("int")
        hit = measured & (s["similarity"] >= threshold)
        category = F.when(failed, F.when(s["status"].isin("infrastructure_error", "measurement_error"), "invalid").otherwise("functional_failure")).when(hit, "success").when(n >= max_steps, F.when(count > 0, "budget").otherwise("invalid"))
        status = F.when(failed, s["status"]).when(hit, "converged").when(n >= max_steps, "translation_budget_reached")
        changed = _with(a, fields, n=n, measured=count, ended=status.isNotNull(), status=status, category=F.coalesce(category, F.lit("incomplete")), reached=F.when(hit, s["step"]))
        return F.when(a["ended"], a).otherwise(changed)

    done = chains.withColumn("end", F.aggregate("steps", zero, step))
    return done.select("trial", "problem", "route", "end.status", "end.category", F.col("end.reached").alias("reached_step"))


def fixed_point_policy(chains: DataFrame, confirmations: int, max_steps: int) -> DataFrame:
    """(trial, status, category, reached_step): a restored state that repeats, and holds for so many confirmations more.

    The chain's first state is the seed's (null). A period of 2 to 4 before any
    candidate is an oscillation.
    """
    fields = {"ended": "boolean", "n": "int", "states": "array<string>", "candidate": "int", "held": "int", "status": "string", "category": "string"}
    zero = F.struct(F.lit(False).alias("ended"), F.lit(0).alias("n"), F.array(F.lit("")).alias("states"), F.lit(None).cast("int").alias("candidate"), F.lit(0).alias("held"), F.lit(None).cast("string").alias("status"), F.lit("incomplete").alias("category"))

    def step(a: Column, s: Column) -> Column:
        n, failed = a["n"] + 1, s["status"] != "success"
        states = F.when(s["restored"], F.concat(a["states"], F.array(s["state"]))).otherwise(a["states"])
        size = F.size(states)
        same = s["restored"] & (F.element_at(states, -1) == F.try_element_at(states, F.lit(-2)))
        waiting = a["candidate"].isNotNull()
        broken = ~failed & waiting & s["restored"] & ~same
        candidate = F.when(waiting, a["candidate"]).when(~failed & same, s["step"])
        held = a["held"] + F.when(~failed & waiting & same, 1).otherwise(0)
        period = F.lit(False)
        for p in (2, 3, 4):
            period = period | F.when(size >= 2 * p, F.slice(states, -p, p) == F.slice(states, -2 * p, p)).otherwise(F.lit(False))
        oscillates = ~failed & s["restored"] & ~waiting & ~same & period
        converged = ~failed & s["restored"] & candidate.isNotNull() & ~broken & (held >= confirmations)
        status = F.when(failed, s["status"]).when(broken, "confirmation_failed").when(oscillates, "oscillation").when(converged, "converged").when(n >= max_steps, "translation_budget_reached")
        failure = F.when(s["status"].isin("infrastructure_error", "measurement_error"), "invalid").otherwise("functional_failure")
        category = F.when(failed, failure).when(broken | oscillates, "unstable").when(converged, "success").when(n >= max_steps, "budget").otherwise("incomplete")
        return F.when(a["ended"], a).otherwise(_with(a, fields, n=n, states=states, candidate=candidate, held=held, status=status, category=category, ended=status.isNotNull()))

    done = chains.withColumn("end", F.aggregate("steps", zero, step))
    reached = F.when(F.col("end.category") == "success", F.col("end.candidate"))
    return done.select("trial", "problem", "route", "end.status", "end.category", reached.alias("reached_step"))


def stabilisation(iterations: DataFrame, most: int) -> DataFrame:
    """Candidate and confirmation phases of round trips: (trial, tau, held, first_broken, status, success_by_c).

    ``iterations``: (trial, items: array of (iteration, confirmation, hash, passed,
    status), in order; confirmation is null in the candidate phase).
    """
    fields = {"ended": "boolean", "hashes": "array<string>", "tau": "int", "clean": "boolean", "held": "int", "broken": "int", "reason": "string", "status": "string"}
    zero = F.struct(*[x.cast(fields[n]).alias(n) for n, x in {"ended": F.lit(False), "hashes": F.array().cast("array<string>"), "tau": F.lit(None), "clean": F.lit(True), "held": F.lit(0), "broken": F.lit(None), "reason": F.lit(None), "status": F.lit(None)}.items()])

    def step(a: Column, s: Column) -> Column:
        hashes = F.when(s["hash"].isNotNull(), F.concat(a["hashes"], F.array(s["hash"]))).otherwise(a["hashes"])
        last, before = F.try_element_at(hashes, F.lit(-1)), F.try_element_at(hashes, F.lit(-2))
        confirming = s["confirmation"].isNotNull()
        held = confirming & F.coalesce((last == before) & s["passed"], F.lit(False))
        broken = confirming & ~held
        count = a["held"] + held.cast("int")
        period = F.lit(False)
        for p in (2, 3, 4):
            period = period | F.when(F.size(hashes) >= 2 * p, F.slice(hashes, -p, p) == F.slice(hashes, -2 * p, p)).otherwise(F.lit(False))
        ok = s["status"] == "success"
        fixed = ~confirming & ok & F.coalesce(last == before, F.lit(False))
        status = F.when(confirming & (s["status"] != "success"), s["status"]).when(confirming & (count == most), "success").when(~confirming & ~ok, s["status"]).when(fixed & F.lit(most == 0), "success").when(~confirming & ~fixed & period, "oscillation")
        reason = F.when(s["status"] == "parse_error", "format_error").when(s["status"] != "confirmation_failed", "test_failed").otherwise("hash_changed")
        changed = _with(
            a, fields, hashes=hashes, tau=F.when(fixed, s["iteration"]).otherwise(a["tau"]), clean=a["clean"] & F.when(confirming, True).otherwise(s["passed"]), held=count,
            broken=F.coalesce(a["broken"], F.when(broken, s["confirmation"])), reason=F.coalesce(a["reason"], F.when(broken, reason)), status=status, ended=status.isNotNull(),
        )
        return F.when(a["ended"], a).otherwise(changed)

    done = iterations.withColumn("end", F.aggregate("items", zero, step))
    by_c = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda c: F.struct(c.alias("c"), (F.col("end.tau").isNotNull() & F.col("end.clean") & (F.col("end.held") >= c)).alias("success")))
    return done.select("trial", "end.tau", "end.held", F.col("end.broken").alias("first_broken"), "end.reason", "end.status", by_c.alias("success_by_c"))


def ledger_state(events: DataFrame) -> DataFrame:
    """(call_id, status, cost, reserved, uncertain) by folding a call's events in order.

    reserved -> inflight -> completed, failed or unknown; a completed call frees its
    reservation, an unknown one keeps it as uncertain. Terminal states stay.
    """
    fields = {"status": "string", "cost": "double", "reserved": "double", "uncertain": "double"}
    zero = F.struct(*[F.lit(None).cast("string").alias("status") if n == "status" else F.lit(None if n == "cost" else 0.0).cast("double").alias(n) for n in fields])

    def step(a: Column, e: Column) -> Column:
        done = a["status"].isin("completed", "failed", "unknown")
        kind = e["kind"]
        return F.when(F.coalesce(done, F.lit(False)), a).otherwise(
            _with(
                a, fields, status=kind, cost=F.when(kind == "completed", e["amount"]).otherwise(a["cost"]),
                reserved=F.when(kind == "reserved", e["amount"]).when(kind == "inflight", a["reserved"]).otherwise(0.0), uncertain=F.when(kind == "unknown", a["reserved"]).otherwise(a["uncertain"]),
            )
        )

    folded = events.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "amount"))).alias("events"))
    return folded.withColumn("end", F.aggregate("events", zero, step)).select("call_id", "end.*")


def deadlines(steps: DataFrame, discovery: float, confirmation: float) -> DataFrame:
    """(trial, status): wall time by phase against its limit; a clock that runs back aborts."""
    folded = steps.groupBy("trial").agg(F.array_sort(F.collect_list(F.struct("step", "phase", "seconds"))).alias("items"))
    spent = lambda phase: F.aggregate(F.filter("items", lambda x: x["phase"] == phase), F.lit(0.0), lambda a, x: a + x["seconds"])
    status = F.when(F.exists("items", lambda x: x["seconds"] < 0), "clock_regression").when(spent("discovery") > discovery, "discovery_deadline").when(spent("confirmation") > confirmation, "confirmation_deadline").otherwise("ok")
    return folded.select("trial", status.alias("status"))
