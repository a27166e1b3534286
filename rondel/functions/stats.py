"""Ratios, intervals, costs and category maps as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the normal quantile of a 95 % interval.
Z = 1.959963984540054

# Category maps of the protocols, which disagree on purpose.
FUNCTIONAL_FAILURES = ("format_error", "compile_error", "compile_timeout", "runtime_error", "wrong_answer", "timeout")
FPS_CATEGORY = {"max_distance_reached": "fps_limit", "translation_budget_reached": "budget", "collection_complete": "collection_complete", "infrastructure_error": "invalid"}
PAPER_CATEGORY = {"success": "success", "parse_error": "format_error", "oscillation": "oscillation", "max_iter_no_convergence": "max_iterations", "confirmation_failed": "confirmation_failed"}
REPORT_INFRASTRUCTURE = ("api_error", "parse_error", "compile_error", "runtime_error", "timeout")
ABORTING = ("infrastructure_error", "provider_error", "tool_error", "unavailable")
HOPS_VALID = ("success", "functional_failure", "hop_limit")
HOPS_CATEGORIES = ("success", "functional_failure", "hop_limit", "invalid", "incomplete")
CASE_PRIORITY = {"timeout": 3, "runtime_error": 2, "wrong_answer": 1, "success": 0}


def ratio(a: Column, b: Column) -> Column:
    """a / b; null for a denominator of 0."""
    return a / F.nullif(b, F.lit(0))


def wilson(successes: Column, n: Column, clamp: bool = True) -> tuple[Column, Column]:
    """Bounds of Wilson's interval; null for n = 0. One protocol clamps them to [0, 1], another doesn't."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = successes / n
    scale = 1 + Z * Z / n
    centre = (p + Z * Z / (2 * n)) / scale
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / scale
    low, high = centre - half, centre + half
    # greatest and least skip nulls, so the clamp asks for n again.
    return (F.when(n.isNotNull(), F.greatest(F.lit(0.0), low)), F.when(n.isNotNull(), F.least(F.lit(1.0), high))) if clamp else (low, high)


def threshold_key(x: Column) -> Column:
    return F.format_string("%.2f", x.cast("double"))


def usage_cost(prompt: Column, cached: Column, completion: Column, rates: tuple[float, float, float]) -> Column:
    """Cost by prices per million tokens (fresh, cached, completion).

    Prompt and completion counts that are unknown, negative or not finite make it
    null; cached tokens count up to the prompt's.
    """
    fresh, old, out = rates

    def counted(x: Column) -> Column:
        x = x.cast("double")
        return F.coalesce((x >= 0) & (x < float("inf")) & ~F.isnan(x), F.lit(False))

    held = F.least(F.coalesce(cached, F.lit(0)), prompt)
    return F.when(counted(prompt) & counted(completion), ((prompt - held) * fresh + held * old + completion * out) / 1e6)


def maximum_cost(bound: Column, limit: Column, completion: Column, rates: tuple[float, float, float]) -> Column:
    """The explicit bound, else every prompt token at the dearest rate."""
    return F.coalesce(bound, (limit * max(rates[:2]) + completion * rates[2]) / 1e6)


def retry_delay(attempt: Column, header_seconds: Column) -> Column:
    return F.coalesce(header_seconds.cast("double"), F.least(F.pow(F.lit(2.0), attempt), F.lit(8.0)))


def header_delay(header: Column, attempt: Column, now: Column) -> Column:
    """Seconds to wait by a header of seconds or of an HTTP date (in GMT), not less than 0; without a usable one, ``retry_delay``'s."""
    told = header.try_cast("double")
    usable = told.isNotNull() & ~F.isnan(told) & (F.abs(told) != float("inf"))
    date = F.try_to_timestamp(F.regexp_extract(header, r"^\s*(?:[A-Za-z]{3,9},\s*)?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})(?: (?:GMT|UTC|[+-]0000))?\s*$", 1), F.lit("d MMM yyyy HH:mm:ss"))
    until = (F.unix_micros(date) - F.unix_micros(now)) / 1e6
    return F.when(usable, F.greatest(told, F.lit(0.0))).when(until.isNotNull(), F.greatest(until, F.lit(0.0))).otherwise(F.least(F.pow(F.lit(2.0), attempt), F.lit(8.0)))


def finished(terminal: Column, category: Column) -> Column:
    """Whether an outcome counts: its chain ended, and its category is known and not invalid."""
    return F.coalesce(terminal.isNotNull() & (category != "invalid"), F.lit(False))


def floor_cents(x: Column) -> Column:
    return (F.floor(x.cast("decimal(20,9)") * 100) / 100).cast("decimal(20,2)")


def quantised(x: Column) -> Column:
    return x.cast("decimal(20,9)")


def sum_all_known(x: Column) -> Column:
    """Sum, but null unless every row has a value."""
    return F.when(F.count(x) == F.count("*"), F.sum(x))


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))[key]


def fps_category(status: Column) -> Column:
    return F.when(status.isin(*FUNCTIONAL_FAILURES), "functional_failure").otherwise(F.coalesce(_lookup(FPS_CATEGORY, status), F.lit("invalid")))


def paper_category(status: Column, missing_toolchain: Column) -> Column:
    infrastructure = (status == "api_error") | F.coalesce(missing_toolchain, F.lit(False))
    return F.when(infrastructure, "infrastructure").otherwise(F.coalesce(_lookup(PAPER_CATEGORY, status), F.lit("functionality_error")))


def report_infrastructure(status: Column) -> Column:
    return status.isin(*REPORT_INFRASTRUCTURE)


def assessable(status: Column, functional: Column) -> Column:
    """Whether a step passed; null if it wasn't evaluated; ``functional`` decides where no status is recorded."""
    return F.when(status == "success", True).when(status.isin(*FUNCTIONAL_FAILURES, "parse_error"), False).when(status.isNull(), functional)


def batch_status_by_priority(status: Column) -> Column:
    """Aggregate: the gravest case decides."""
    grave = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in CASE_PRIORITY.items()))[status]
    return F.max_by(status, grave)


def batch_status_by_first(status: Column, case: Column) -> Column:
    """Aggregate: the first case that fails decides."""
    return F.coalesce(F.min_by(status, F.when(status != "success", case)), F.lit("success"))


def case_status(timed_out: Column, exit_code: Column, actual: Column, expected: Column) -> Column:
    return F.when(timed_out, "timeout").when(exit_code != 0, "runtime_error").when(actual == expected, "success").otherwise("wrong_answer")


def valid_identifier(x: Column) -> Column:
    return x.rlike(r"\A[A-Za-z0-9][A-Za-z0-9_.-]{0,99}\z")


def model_matches(asked: Column, got: Column, exact: bool, aliases: Column | None = None) -> Column:
    """Containment either way without regard to case; or equality, or an alias."""
    if exact:
        return (asked == got) | (F.array_contains(aliases, got) if aliases is not None else F.lit(False))
    a, b = F.lower(asked), F.lower(got)
    return a.contains(b) | b.contains(a)
