"""Gates before and after a campaign: the corpus, reference results, reported numbers and ledgers, each as a table of what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rondel.functions.stats import HOPS_VALID, ratio


def canonical_input(text: Column) -> Column:
    """An input as its words, so that white space doesn't tell inputs apart."""
    return F.concat_ws(" ", F.filter(F.split(text, r"\s+"), lambda t: t != ""))


def corpus_faults(cases: DataFrame, evaluations: int) -> DataFrame:
    """(problem, fault, n) of a corpus that can't be frozen.

    ``cases``: (problem, role, input, expected), role ``evaluation`` or ``prompt_examples``. Faults: ``evaluation_count`` (not just ``evaluations``; n is how many),
    ``repeated_input`` (evaluation inputs beyond their first), ``public_input`` (distinct evaluation inputs that an example shows) and ``missing_side``.
    """
    held = F.col("role") == "evaluation"
    rows = cases.withColumn("key", canonical_input(F.col("input")))
    seen = rows.groupBy("problem", "key").agg(F.count_if(held).alias("held"), F.count_if(~held).alias("shown"), F.count_if(F.col("input").isNull() | F.col("expected").isNull()).alias("lacking"))
    per = seen.groupBy("problem").agg(F.sum("held").alias("evaluation_count"), F.sum(F.greatest(F.col("held") - 1, F.lit(0))).alias("repeated_input"), F.count_if((F.col("held") > 0) & (F.col("shown") > 0)).alias("public_input"), F.sum("lacking").alias("missing_side"))
    names = ("evaluation_count", "repeated_input", "public_input", "missing_side")
    told = F.explode(F.array(*[F.struct(F.lit(n).alias("fault"), F.col(n).alias("n")) for n in names]))
    wrong = F.when(F.col("t.fault") == "evaluation_count", F.col("t.n") != evaluations).otherwise(F.col("t.n") > 0)
    return per.select("problem", told.alias("t")).filter(wrong).select("problem", "t.fault", "t.n")


def reference_faults(results: DataFrame, implementations: DataFrame, cases: DataFrame) -> DataFrame:
    """(problem, language, case, fault): cases of each reference implementation that weren't run, weren't passed, ran twice, or belong to none.

    ``results``: (problem, language, case, status); ``implementations``: (problem, language); ``cases``: (problem, case).
    """
    keys = ["problem", "language", "case"]
    planned = implementations.select("problem", "language").join(cases.select("problem", "case"), "problem").select(*keys).distinct()
    ran = results.groupBy(*keys).agg(F.count("*").alias("runs"), F.coalesce(F.bool_and(F.col("status") == "success"), F.lit(False)).alias("passed"))
    joined = planned.withColumn("planned", F.lit(True)).join(ran, keys, "full_outer")
    fault = F.when(F.col("planned").isNull(), "unplanned").when(F.col("runs").isNull(), "not_run").when(F.col("runs") > 1, "repeated").when(~F.col("passed"), "not_passed")
    return joined.select(*keys, fault.alias("fault")).filter("fault is not null")


def gate(facts: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """(open, reasons) for one row of facts: open if every condition (SQL) holds; the reasons are the names of those that don't, or can't be told."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(F.expr(test), F.lit(False)), F.lit(name)) for name, test in conditions.items()]), lambda r: r.isNotNull())
    return facts.select(broken.alias("reasons")).select((F.size("reasons") == 0).alias("open"), "reasons")


def reported_differences(reported: DataFrame, rows: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(route, field, reported, recomputed) where a report's numbers aren't those of its rows.

    ``reported``: (route, hits, valid, planned, P, H, D); ``rows``: (route, category, reached_step). Numbers agree within ``tolerance`` of the larger; nulls agree with each other.
    """
    hit, valid = F.col("category") == "success", F.col("category").isin(*HOPS_VALID)
    sums = rows.groupBy("route").agg(F.count_if(hit).alias("hits"), F.count_if(valid).alias("valid"), F.count("*").alias("planned"), F.sum(F.when(hit, F.col("reached_step"))).alias("hops"))
    p, h = ratio(F.col("hits"), F.col("valid")), ratio(F.col("hops"), F.col("hits"))
    again = sums.select("route", "hits", "valid", "planned", p.alias("P"), h.alias("H"), ratio(h, p).alias("D"))
    fields = ("hits", "valid", "planned", "P", "H", "D")
    joined = reported.alias("a").join(again.alias("b"), "route", "full_outer")

    def differs(f: str) -> Column:
        a, b = F.col(f"a.{f}").cast("double"), F.col(f"b.{f}").cast("double")
        return ~F.coalesce(F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b)), a.isNull() & b.isNull())

    found = F.filter(F.array(*[F.when(differs(f), F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").cast("double").alias("reported"), F.col(f"b.{f}").cast("double").alias("recomputed"))) for f in fields]), lambda x: x.isNotNull())
    return joined.select("route", F.explode(found).alias("x")).select("route", "x.*")


def ledger_split(requests: DataFrame, *by: str) -> DataFrame:
    """Requests, attempts and tokens; costs that were estimated and that were reported (null if none was), and requests of unknown cost.

    ``requests``: (attempts, cost_usd, cost_source, prompt_tokens, completion_tokens), ...
    """
    cost, source = F.col("cost_usd"), F.col("cost_source")
    return requests.groupBy(*by).agg(
        F.count("*").alias("logical_requests"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("transport_attempts"), F.count_if(cost.isNull()).alias("unknown_cost_requests"),
        F.round(F.coalesce(F.sum(F.when(source.isin("estimated", "provider_estimated"), cost)), F.lit(0.0)), 6).alias("estimated_cost_usd"), F.round(F.sum(F.when(source == "reported", cost)), 6).alias("reported_cost_usd"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
    )


def exclusions(outcomes: DataFrame, value: str, reason: str, *by: str) -> DataFrame:
    """(by, reason, n): why successes have no value; ``not_processed`` where nothing is told."""
    left = outcomes.filter((F.col("category") == "success") & F.col(value).isNull())
    return left.groupBy(*by, F.coalesce(reason, F.lit("not_processed")).alias("reason")).agg(F.count("*").alias("n"))


def described(values: DataFrame, replicates: DataFrame, value: str, by: list[str], draws: int) -> DataFrame:
    """(by, n, median, q1, q3, min, max, low, high, ci_status, valid_resamples) of values, and of their median over resamples.

    ``replicates``: (by, median), null or absent where a resample has none. The interval takes 95 % of ``draws`` to be there, else it is
    ``unavailable``; one of no width is ``degenerate``.
    """
    one = values.groupBy(*by).agg(F.count(value).alias("n"), *[F.percentile(value, q).alias(n) for n, q in (("median", 0.5), ("q1", 0.25), ("q3", 0.75))], F.min(value).alias("min"), F.max(value).alias("max"))
    drawn = replicates.groupBy(*by).agg(F.count("median").alias("valid_resamples"), F.percentile("median", 0.025).alias("low"), F.percentile("median", 0.975).alias("high"))
    enough = F.coalesce(F.col("valid_resamples"), F.lit(0)) >= 0.95 * draws
    out = one.join(drawn, by, "left")
    status = F.when(~enough, "unavailable").when(F.col("low") == F.col("high"), "degenerate").otherwise("measured")
    return out.select(*by, "n", "median", "q1", "q3", "min", "max", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"), status.alias("ci_status"), F.coalesce("valid_resamples", F.lit(0)).alias("valid_resamples"))


def side_by_side(rows: DataFrame, key: str, column: str, sides: list[str], values: list[str], required: bool = True) -> DataFrame:
    """One row for each ``key`` with each value of each side, ``value_side``; with ``required`` a key that lacks a side ends the job."""
    picked = [F.max(F.when(F.col(column) == s, F.struct(*values)))[v].alias(f"{v}_{s}") for s in sides for v in values]
    there = [F.count_if(F.col(column) == s).alias(f"__n{i}") for i, s in enumerate(sides)]
    out = rows.groupBy(key).agg(*picked, *there)
    if required:
        lacking = F.lit(False)
        for i in range(len(sides)):
            lacking = lacking | (F.col(f"__n{i}") == 0)
        out = out.withColumn(key, F.when(lacking, F.raise_error(F.concat(F.lit("no row of a side for "), F.col(key).cast("string")))).otherwise(F.col(key)))
    return out.drop(*[f"__n{i}" for i in range(len(sides))])


def subsets(rows: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """``rows`` once for each subset (name -> SQL) that they belong to, with its name: sensitivity to what is left out, in one pass."""
    names = F.filter(F.array(*[F.when(F.expr(test), F.lit(name)) for name, test in conditions.items()]), lambda n: n.isNotNull())
    return rows.withColumn("subset", F.explode(names))


def measurement_faults(raw: DataFrame, measured: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, fault, raw, measured) where recorded measurements aren't those of the tool's own output: missing on a side, repeated, or another value."""
    one = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(f"{name}_rows"), F.max(value).alias(name))
    joined = one(raw, "raw").join(one(measured, "measured"), keys, "full_outer")
    fault = F.when(F.col("raw_rows").isNull(), "no_raw_output").when(F.col("measured_rows").isNull(), "not_recorded").when((F.col("raw_rows") > 1) | (F.col("measured_rows") > 1), "repeated").when(~F.col("raw").eqNullSafe(F.col("measured")), "other_value")
    return joined.select(*keys, fault.alias("fault"), "raw", "measured").filter("fault is not null")


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], mode: str = "report") -> DataFrame:
    """``rows`` with the columns of ``table`` for their keys, and ``found``: one, none or several entries (of several, none is taken).

    With mode ``fail`` anything but one entry ends the job. Nulls in a key find nothing.
    """
    fields = [c for c in table.columns if c not in keys]
    entries = table.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in fields])
    out = rows.join(entries, keys, "left")
    found = F.when(F.col("__n").isNull(), "none").when(F.col("__n") > 1, "several").otherwise("one")
    if mode == "fail":
        found = F.when(found != "one", F.raise_error(F.concat_ws(" ", found, F.lit("for"), *keys))).otherwise(found)
    return out.select(*rows.columns, *[F.when(F.col("__n") == 1, F.col(c)).alias(c) for c in fields], found.alias("found"))
