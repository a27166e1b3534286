"""Diagnostics of recorded runs: where and why chains stop, what was evaluated, how likeness is spread, what a pilot foretells."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rondel.functions.stats import ratio
from rondel.functions.text import FENCE

# Statuses with which a chain ends as planned; evaluations after which an intermediate program goes on.
PLANNED_ENDS = ["collection_complete", "max_distance_reached", "translation_budget_reached"]
GOES_ON = ["wrong_answer", "runtime_error", "timeout"]
CHECKS = {"compile": ["passed", "failed", "skipped", "not_evaluated"], "functionality": ["passed", "failed", "not_run", "not_evaluated"]}


def _evaluated(status: Column) -> Column:
    return F.coalesce(~status.isin("", "not_evaluated"), F.lit(False))


def semantic_preservation(steps: DataFrame) -> DataFrame:
    """(trial, status, final_passed, degraded, reason): pass, degraded, fail or not_evaluated.

    ``steps``: (trial, step, status, compile_status, functionality_status, functionality_passed, execution_status). A chain is degraded if its last step
    passed and an earlier one failed on its functionality. The reason of a failure is the first that the last step tells of: its
    execution, a failed compilation, its functionality, its own status; ``route_incomplete`` if it was not evaluated.
    """
    tested = _evaluated(F.col("compile_status")) | _evaluated(F.col("functionality_status"))
    degraded = F.coalesce(F.col("status") == "completed_with_functionality_failure", F.lit(False)) | (F.coalesce(~F.col("functionality_passed"), F.lit(False)) & F.coalesce(F.col("functionality_status") == "failed", F.lit(False)))
    fields = ("status", "compile_status", "functionality_passed", "functionality_status", "execution_status")
    rows = steps.select("trial", "step", tested.alias("tested"), degraded.alias("bad"), F.struct(*fields, tested.alias("tested")).alias("at"))
    out = rows.groupBy("trial").agg(F.bool_or("tested").alias("any"), F.max_by("at", "step").alias("last"), F.max_by("bad", "step").alias("last_bad"), F.count_if("bad").alias("bad"))
    passed, before = F.coalesce("last.functionality_passed", F.lit(False)), F.col("bad") - F.col("last_bad").cast("int") > 0
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    told = F.coalesce(filled("last.execution_status"), F.when(F.col("last.compile_status") == "failed", "compile_failed"), filled("last.functionality_status"), filled("last.status"), F.lit("route_incomplete"))
    status = F.when(~F.col("any"), "not_evaluated").when(passed & before, "degraded").when(passed, "pass").otherwise("fail")
    reason = F.when(~F.col("any"), "no_evaluation_results").when(passed & before, "route_degraded").when(~passed, F.when(F.col("last.tested"), told).otherwise("route_incomplete"))
    return out.select("trial", status.alias("status"), (F.col("any") & passed).alias("final_passed"), (F.col("any") & before).alias("degraded"), reason.alias("reason"))


def check_counts(steps: DataFrame, *keys: str) -> DataFrame:
    """(keys, check, status, n): evaluation checks by status, with a row for each known status, and for others as they occur; blank ones don't count."""
    told = F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"{c}_status").alias("status"), F.lit(1).alias("n")) for c in CHECKS]))
    known = F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.lit(s).alias("status"), F.lit(0).alias("n")) for c, statuses in CHECKS.items() for s in statuses]))
    rows = steps.select(*keys, told.alias("c")).unionByName(steps.select(*keys).distinct().select(*keys, known.alias("c")))
    return rows.filter(F.coalesce(F.col("c.status") != "", F.lit(False))).groupBy(*keys, F.col("c.check").alias("check"), F.col("c.status").alias("status")).agg(F.sum("c.n").alias("n"))


def translation_counts(steps: DataFrame, *keys: str) -> DataFrame:
    """(keys, attempted, completed, failed): translations by what became of them; one that isn't completed or went on has failed."""
    done = F.coalesce(F.col("status").startswith("completed"), F.lit(False))
    return steps.groupBy(*keys).agg(F.count("*").alias("attempted"), F.count_if(done).alias("completed"), F.count_if(~done).alias("failed"))


def completed_cycles(iterations: DataFrame) -> DataFrame:
    """(trial, cycles): iterations whose restored source is there and not blank."""
    return iterations.groupBy("trial").agg(F.count_if(F.trim(F.coalesce("source", F.lit("")), F.lit(" \t\n\r\x0b\x0c")) != "").alias("cycles"))


def continues(status: Column, compiled: Column, target: Column, seed: str = "cpp") -> Column:
    """Whether a route goes on after a step: it passed, or an intermediate program compiled and only its functionality failed."""
    return (status == "success") | ((target != seed) & F.coalesce(compiled, F.lit(False)) & status.isin(GOES_ON))


def convergence(iterations: DataFrame, most: int) -> DataFrame:
    """(trial, iteration, convergence, status): what each iteration of a chain comes to.

    ``iterations``: (trial, iteration, hash, failure), from iteration 0, the seed; failure is the status of one that broke off, which has no hash.
    A hash that repeats its predecessor is a fixed point, one that repeats the last but one, as its predecessor does, an oscillation, any other
    goes on, until iteration ``most`` ends without convergence. What follows a fixed point, an oscillation or a failure is left out.
    """
    w = Window.partitionBy("trial").orderBy("iteration")
    back = {k: F.lag("hash", k).over(w) for k in (1, 2, 3)}
    rows = iterations.select("trial", "iteration", "hash", "failure", *[c.alias(f"b{k}") for k, c in back.items()])
    h = F.col("hash")
    kind = F.when(h == F.col("b1"), "fixed_point").when((h == F.col("b2")) & (F.col("b1") == F.col("b3")), "oscillation").otherwise("continue")
    rows = rows.withColumn("convergence", F.when(F.col("failure").isNull(), kind))
    ended = F.col("failure").isNotNull() | F.col("convergence").isin("fixed_point", "oscillation")
    before = F.max(ended & (F.col("iteration") > 0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("over", F.coalesce(before, F.lit(False))).filter(~F.col("over") & (F.col("iteration") > 0))
    status = F.when(F.col("failure").isNotNull(), F.col("failure")).when(F.col("convergence") == "oscillation", "oscillation").when((F.col("convergence") == "continue") & (F.col("iteration") == most), "max_iter_no_convergence").otherwise("success")
    return rows.select("trial", "iteration", "convergence", status.alias("status"))


def stop_positions(chains: DataFrame, seed: str = "cpp") -> DataFrame:
    """(route, position, n): where chains broke off; ``chains``: (route, status, language, step) of each chain's last step."""
    place = F.when(F.col("step") == 1, "1").when(F.col("step") == 2, "2").otherwise("3+")
    position = F.concat_ws("@", F.when(F.col("language") != seed, "intermediate").otherwise("restored"), place)
    return chains.filter(~F.col("status").isin(PLANNED_ENDS)).groupBy("route", position.alias("position")).agg(F.count("*").alias("n"))


def extraction_cause(response: Column) -> Column:
    """Why no source was found in a response: several fenced blocks, nothing, or something else."""
    text = F.coalesce(response, F.lit(""))
    fences = (F.length(text) - F.length(F.replace(text, F.lit("```"), F.lit("")))) / 3
    return F.when(fences > 2, "multiple_fenced_blocks").when(F.trim(text, F.lit(" \t\n\r\x0b\x0c")) == "", "empty").otherwise("other")


def direction_rates(steps: DataFrame, seed: str = "cpp") -> DataFrame:
    """(route, direction, passed, steps, rate) of the steps out of the seed's language and back."""
    direction = F.when(F.col("language") != seed, F.concat_ws("->", F.lit(seed), "language")).otherwise(F.concat_ws("->", "target", F.lit(seed)))
    out = steps.groupBy("route", direction.alias("direction")).agg(F.count_if(F.col("status") == "success").alias("passed"), F.count("*").alias("steps"))
    return out.withColumn("rate", F.round(F.col("passed") / F.col("steps"), 6))


def similarity_profile(steps: DataFrame, high: float = 0.85) -> DataFrame:
    """Per route: measured values (n, mean, median, shares of 0 and of at least ``high``), and by chain the median of first and of greatest values.

    ``steps``: (trial, route, step, similarity, ...); also the chains whose value at success (``reached_similarity``, if there is such a column) is exactly 1.
    """
    seen = F.col("similarity").isNotNull()
    spread = steps.filter(seen).groupBy("route").agg(
        F.count("*").alias("n"), F.round(F.avg("similarity"), 6).alias("mean"), F.round(F.percentile("similarity", 0.5), 6).alias("median"),
        F.round(F.count_if(F.col("similarity") == 0) / F.count("*"), 6).alias("share_zero"), F.round(F.count_if(F.col("similarity") >= high) / F.count("*"), 6).alias("share_high"),
    )
    per_chain = first_and_most(steps).groupBy("route").agg(F.count("first").alias("chains"), F.round(F.percentile("first", 0.5), 6).alias("first_median"), F.round(F.percentile("most", 0.5), 6).alias("most_median"))
    return spread.join(per_chain, "route")


def first_and_most(steps: DataFrame) -> DataFrame:
    """(trial, route, first, most): each chain's first measured similarity and its greatest; null if none was measured."""
    seen = F.col("similarity").isNotNull()
    return steps.groupBy("trial", "route").agg(F.min_by("similarity", F.when(seen, F.col("step"))).alias("first"), F.max("similarity").alias("most"))


def exact_repeats(outcomes: DataFrame) -> DataFrame:
    """(route, successes, exact): successes, and those whose similarity at the reached step is 1."""
    hit = F.col("category") == "success"
    return outcomes.groupBy("route").agg(F.count_if(hit).alias("successes"), F.count_if(hit & (F.col("similarity") == 1.0)).alias("exact"))


def last_blocks(responses: DataFrame) -> DataFrame:
    """(…, blocks, source) of responses (column ``response``) with several fenced blocks: how many, and the last without its outer line ends."""
    found = F.regexp_extract_all("response", F.lit(FENCE), F.lit(1))
    rows = responses.withColumn("found", found).filter(F.size("found") > 1)
    return rows.withColumn("blocks", F.size("found")).withColumn("source", F.trim(F.element_at("found", -1), F.lit("\n"))).drop("found")


def block_statuses(evaluated: DataFrame) -> DataFrame:
    """(language, status, n) of last blocks after their evaluation."""
    return evaluated.groupBy("language", "status").agg(F.count("*").alias("n"))


def pilot_projection(pilot: DataFrame, problems: int, cap: float) -> DataFrame:
    """One row: pilot problems, cost, what ``problems`` would cost at that rate, and whether that is within ``cap``; null where a cost isn't known."""
    out = pilot.agg(F.count_distinct("problem").alias("pilot_problems"), F.when(F.count("cost") == F.count("*"), F.sum("cost")).alias("pilot_cost"))
    projected = ratio(F.col("pilot_cost") * problems, F.col("pilot_problems"))
    return out.withColumn("projected", projected).withColumn("within", F.col("projected") <= cap)


def analyzer_check(measured: DataFrame) -> DataFrame:
    """(variant, language, n, measured, na, mean, median, min, max, spread): a similarity tool's values on variants of sources.

    ``measured``: (variant, language, value), null where it couldn't be measured. spread is a variant's greatest mean of a language less its least; null if a language has none.
    """
    out = measured.groupBy("variant", "language").agg(
        F.count("*").alias("n"), F.count("value").alias("measured"), F.count_if(F.col("value").isNull()).alias("na"), F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    whole = Window.partitionBy("variant")
    spread = F.when(F.min(F.col("mean").isNotNull()).over(whole), F.max("mean").over(whole) - F.min("mean").over(whole))
    return out.withColumn("spread", spread)


def analyzer_faults(measured: DataFrame) -> DataFrame:
    """(fault, n): sources that aren't wholly like themselves, real variants that weren't measured, and trivial ones that were."""
    fault = F.when((F.col("variant") == "identical") & ~F.coalesce(F.col("value") == 1.0, F.lit(False)), "identical_is_not_one").when((F.col("variant") != "short") & F.col("value").isNull(), "real_code_not_measured").when((F.col("variant") == "short") & F.col("value").isNotNull(), "short_was_measured")
    return measured.select(fault.alias("fault")).filter("fault is not null").groupBy("fault").agg(F.count("*").alias("n"))


def top_word(sources: DataFrame, key: str, column: str = "source", keywords: tuple[str, ...] = ()) -> DataFrame:
    """(key, word, n): the identifier of two letters or more that a source has most often; of equals, that which comes first.

    The sources are shuffled once, as they are, and a task counts one key's words after the other's; words are not shuffled.
    """
    spark = sources.sparkSession
    kind = sources.schema[key].dataType.simpleString()
    identifiers, drop = re.compile("[A-Za-z_][A-Za-z0-9_]*").findall, frozenset(keywords)

    def best(of, counted: dict, places: dict):
        if counted:
            word = max(counted, key=lambda w: (counted[w], -places[w], w))
            yield {key: of, "word": word, "n": counted[word]}

    def count(batches):
        last, counted, places = None, {}, {}
        for batch in batches:
            out, schema = [], pa.schema([(key, batch.schema.field(0).type), ("word", pa.string()), ("n", pa.int64())])
            for of, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if of != last:
                    out += best(last, counted, places)
                    last, counted, places = of, {}, {}
                for at, word in enumerate(identifiers(source)):
                    if len(word) < 2 or word in drop:
                        continue
                    n = counted.get(word)
                    if n is None or at < places[word]:
                        places[word] = at
                    counted[word] = (n or 0) + 1
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if counted:
            yield pa.RecordBatch.from_pylist([*best(last, counted, places)], schema=schema)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = sources.select(key, column).filter(F.col(column).isNotNull()).repartition(parts, key).sortWithinPartitions(key)
    return rows.mapInArrow(count, f"{key} {kind}, word string, n bigint")


def distinct_values(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, values): the distinct values of a column, in order; for columns of few values."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(column)).alias("values"))
