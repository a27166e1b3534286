"""Registered queries over the synthetic tables, each with the SQL that must agree.

A query is a thin composition of operators on the mapping views; see
``rondel.plans.views`` for what the views stand for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rondel.functions import stats, text
from rondel.operators import audits, chains, folds, kernels, outcomes, ranking, resampling, structure
from rondel.plans.views import BLOCKS, OUTCOMES_SQL, STEPS_SQL, table
from rondel.plans.views import outcomes as outcome_view
from rondel.plans.views import steps as step_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

THRESHOLDS = [0.70, 0.80, 0.90]
REPLICATES = 200


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_METRICS = """round(hits / nullif(valid, 0), 6) AS "P", round(hops / nullif(hits, 0), 6) AS "H", round((hops / nullif(hits, 0)) / nullif(hits / nullif(valid, 0), 0), 6) AS "D" """
_COUNTS = "count(*) FILTER (category IN ('success', 'functional_failure', 'hop_limit')) AS valid, count(*) FILTER (category = 'success') AS hits, sum(reached_step) FILTER (category = 'success') AS hops"


@query(f"WITH {OUTCOMES_SQL}, c AS (SELECT route, {_COUNTS} FROM outcomes GROUP BY route) SELECT route, valid, hits, {_METRICS} FROM c")
def hop_metrics_by_route(spark, sf):
    return outcomes.reach_metrics(outcome_view(spark, sf), "route")


#: Slots whose record is taken to be lost.
_LOST = "attempt % 7 = 3"


@query(
    f"""WITH {OUTCOMES_SQL}, s AS (SELECT route, NOT ({_LOST}) AS recorded, CASE WHEN {_LOST} THEN 'incomplete' ELSE category END AS category, CASE WHEN NOT ({_LOST}) THEN reached_step END AS reached_step FROM outcomes),
    c AS (SELECT route, count(*) AS planned, count(*) FILTER (recorded) AS n_recorded, {", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in stats.HOPS_CATEGORIES)}, {_COUNTS} FROM s GROUP BY route)
    SELECT route, planned, n_recorded, {", ".join(stats.HOPS_CATEGORIES)}, valid, {_METRICS} FROM c"""
)
def hop_route_summary(spark, sf):
    seen = outcome_view(spark, sf)
    return outcomes.route_summary(seen.select("problem", "route", "attempt"), seen.filter(f"not ({_LOST})").select("problem", "route", "attempt", "category", "reached_step"))


@query(
    f"""WITH {OUTCOMES_SQL}, c AS (SELECT problem, route, count(*) FILTER (NOT ({_LOST}) AND category IN ('success', 'functional_failure', 'hop_limit')) AS valid, count(*) FILTER (NOT ({_LOST}) AND category = 'success') AS hits,
    sum(reached_step) FILTER (NOT ({_LOST}) AND category = 'success') AS hops FROM outcomes GROUP BY problem, route) SELECT problem, route, valid, hits, {_METRICS} FROM c"""
)
def per_problem_metrics(spark, sf):
    seen = outcome_view(spark, sf)
    return outcomes.per_problem(seen, seen.filter(f"not ({_LOST})").select("problem", "route", "attempt", "category", "reached_step"))


@query(f"WITH {OUTCOMES_SQL}, c AS (SELECT route, problem, {_COUNTS} FROM outcomes GROUP BY route, problem) SELECT route, count(hits / nullif(valid, 0)) AS problems, round(avg(hits / nullif(valid, 0)), 6) AS problem_mean, round(sum(hits) / nullif(sum(valid), 0), 6) AS pooled FROM c GROUP BY route")
def problem_mean(spark, sf):
    return outcomes.problem_mean(outcome_view(spark, sf))


@query(f"WITH {OUTCOMES_SQL} SELECT route, CASE WHEN attempt % 3 = 0 THEN 'slow' ELSE category END AS reason, count(*) AS n FROM outcomes WHERE category NOT IN ('success', 'incomplete') GROUP BY ALL")
def failure_reasons(spark, sf):
    return outcomes.failure_reasons(outcome_view(spark, sf), F.when(F.col("attempt") % 3 == 0, "slow"))


_W = f"((hits / valid::DOUBLE) + {stats.Z}*{stats.Z}/(2*valid)) / (1 + {stats.Z}*{stats.Z}/valid)"
_WH = f"{stats.Z} * sqrt((hits / valid::DOUBLE) * (1 - hits / valid::DOUBLE) / valid + {stats.Z}*{stats.Z}/(4*valid*valid)) / (1 + {stats.Z}*{stats.Z}/valid)"


@query(f"WITH {OUTCOMES_SQL}, c AS (SELECT route, problem, {_COUNTS} FROM outcomes GROUP BY route, problem) SELECT route, problem, valid, hits, round(greatest(0.0, {_W} - {_WH}), 6) AS low, round(least(1.0, {_W} + {_WH}), 6) AS high, round({_W} - {_WH}, 6) AS free_low, round({_W} + {_WH}, 6) AS free_high FROM c")
def wilson_interval(spark, sf):
    return outcomes.with_wilson(outcome_view(spark, sf), "route", "problem")


@query(f"WITH {OUTCOMES_SQL}, c AS (SELECT route, {_COUNTS}, count(*) AS n FROM outcomes WHERE attempt % 5 <> 0 OR category <> 'hop_limit' GROUP BY route) SELECT route, round(hits / n, 6) AS low, round((hits + n - valid) / n, 6) AS high FROM c")
def missing_outcome_bounds(spark, sf):
    return outcomes.bounds(outcome_view(spark, sf).filter("attempt % 5 <> 0 or category <> 'hop_limit'"))


@query(f"WITH {OUTCOMES_SQL}, c AS (SELECT route, count(*) AS total, category FROM outcomes GROUP BY route, category), t AS (SELECT route, sum(total) AS total FROM c GROUP BY route), k AS (SELECT unnest(['success', 'functional_failure', 'hop_limit', 'invalid', 'incomplete']) AS category) SELECT t.route, k.category, coalesce(c.total, 0) AS n, round(coalesce(c.total, 0) / t.total, 6) AS share FROM t CROSS JOIN k LEFT JOIN c ON c.route = t.route AND c.category = k.category")
def failure_table(spark, sf):
    return outcomes.failure_table(outcome_view(spark, sf), list(stats.HOPS_CATEGORIES))


@query(f"WITH {OUTCOMES_SQL} SELECT route, count(*) FILTER (category = 'success') AS n, round(quantile_cont(price, 0.5) FILTER (category = 'success'), 6) AS median, round(quantile_cont(price, 0.25) FILTER (category = 'success'), 6) AS q1, round(quantile_cont(price, 0.75) FILTER (category = 'success'), 6) AS q3, 1.0::DOUBLE AS measured_share FROM outcomes GROUP BY route")
def conditional_quartiles(spark, sf):
    return outcomes.conditional_quartiles(outcome_view(spark, sf), "price", "route")


@query(f"WITH {OUTCOMES_SQL}, c AS (SELECT route, attempt % 5 AS run, {_COUNTS} FROM outcomes GROUP BY ALL) SELECT route, round(avg(hits / nullif(valid, 0)), 6) AS mean, round(min(hits / nullif(valid, 0)), 6) AS low, round(max(hits / nullif(valid, 0)), 6) AS high FROM c GROUP BY route")
def run_spread(spark, sf):
    return outcomes.run_spread(outcome_view(spark, sf), F.col("attempt") % 5)


@query(
    f"""WITH {OUTCOMES_SQL}, c AS (SELECT route, problem % 3 = 0 AS g, {_COUNTS} FROM outcomes GROUP BY ALL), m AS (SELECT route, g, {_METRICS} FROM c),
    w AS (SELECT route, max("P") FILTER (g) AS "P_in", max("P") FILTER (NOT g) AS "P_out", max("D") FILTER (g) AS "D_in", max("D") FILTER (NOT g) AS "D_out" FROM m GROUP BY route)
    SELECT *, round("P_in" - "P_out", 6) AS "P_difference", round("D_in" - "D_out", 6) AS "D_difference" FROM w"""
)
def recursive_group_contrast(spark, sf):
    groups = spark.range(BLOCKS).select(F.col("id").alias("problem"), (F.col("id") % 3 == 0).alias("in_group"))
    return outcomes.group_contrast(outcome_view(spark, sf), groups)


@query(f"WITH {OUTCOMES_SQL} SELECT route, count(*) FILTER (category IN ('success', 'hop_limit')) AS measured, count(*) FILTER (category NOT IN ('success', 'hop_limit')) AS unavailable, round(avg(price) FILTER (category IN ('success', 'hop_limit')), 6) AS mean, round(stddev_pop(price) FILTER (category IN ('success', 'hop_limit')), 4) AS stddev, round(count(*) FILTER (category = 'hop_limit') / nullif(count(*) FILTER (category IN ('success', 'hop_limit')), 0), 6) AS divergence_rate FROM outcomes GROUP BY route")
def legacy_route_aggregate(spark, sf):
    return outcomes.legacy_aggregate(outcome_view(spark, sf), F.col("price"))


_RESEARCH = """SELECT route, '{w}' AS weighting, round(rate, 6) AS success_rate, round(mean, 6) AS mean_hops, round(mean / nullif(rate, 0), 6) AS hop_adjusted_distance, round(pen, 6) AS penalised_distance FROM (
  SELECT route, {rate} AS rate, sum(hops) / nullif(sum(hits), 0) AS mean, {pen} AS pen FROM c GROUP BY route)"""
_PEN = "(coalesce(hops, 0) + 11 * (valid - hits))"


@query(f"WITH {OUTCOMES_SQL}, c AS (SELECT route, problem, {_COUNTS} FROM outcomes GROUP BY ALL) " + _RESEARCH.format(w="pooled", rate="sum(hits) / nullif(sum(valid), 0)", pen=f"sum({_PEN}) / nullif(sum(valid), 0)") + " UNION ALL " + _RESEARCH.format(w="problem", rate="avg(hits / nullif(valid, 0))", pen=f"avg({_PEN} / nullif(valid, 0))"))
def research_estimates(spark, sf):
    seen = outcome_view(spark, sf)
    return outcomes.research_estimates(seen, "pooled").unionByName(outcomes.research_estimates(seen, "problem"))


# Chains


@query(
    f"""WITH {STEPS_SQL}, d AS (SELECT *, coalesce(lag(language) OVER (PARTITION BY trial ORDER BY step), 'cpp') || '->' || language AS direction FROM steps)
    SELECT phase, step, direction, count(*) AS attempts, count(*) AS assessable, 0::BIGINT AS unavailable, count(*) FILTER (functional) AS passed, round(count(*) FILTER (functional) / count(*), 6) AS pass_rate FROM d GROUP BY phase, step, direction"""
)
def stage_pass_rates(spark, sf):
    return chains.stage_pass_rates(step_view(spark, sf))


@query(f"WITH {STEPS_SQL} SELECT route, count(*) AS logical, sum(transports) AS transport, sum(greatest(0, transports - 1)) AS retries, count(cost) AS known, round(sum(cost), 4) AS known_cost, CASE WHEN count(cost) = count(*) THEN round(sum(cost), 4) END AS total_cost FROM steps GROUP BY route")
def call_accounting(spark, sf):
    return chains.call_accounting(step_view(spark, sf))


@query(
    f"""WITH {STEPS_SQL}, x AS (SELECT route, 'first_restoration' AS scope, similarity AS x FROM steps WHERE functional AND step = 2 UNION ALL SELECT route, 'all_restorations', similarity FROM steps WHERE functional AND restored
    UNION ALL SELECT route, 'origin', origin_similarity FROM steps WHERE functional AND restored)
    SELECT route, scope, count(x) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.75), 6) AS q3 FROM x GROUP BY route, scope"""
)
def similarity_distribution(spark, sf):
    return chains.similarity_scopes(step_view(spark, sf))


_OK = "ok AS (SELECT *, bool_and(functional) OVER (PARTITION BY trial ORDER BY step) AS so_far FROM steps)"
_REACH = " UNION ALL ".join(f"SELECT trial, min(problem) AS problem, min(route) AS route, '{t:.2f}' AS threshold, min(step) FILTER (restored AND so_far AND similarity >= {t}) AS reached_step FROM ok GROUP BY trial" for t in THRESHOLDS)


@query(f"WITH {STEPS_SQL}, {_OK}, reach AS ({_REACH}) SELECT route, threshold, count(*) AS n, count(reached_step) AS reached, round(avg(reached_step), 6) AS mean_step FROM reach GROUP BY ALL")
def first_reach_thresholds(spark, sf):
    found = chains.first_reach(step_view(spark, sf), THRESHOLDS)
    return found.groupBy("route", "threshold").agg(F.count("*").alias("n"), F.count("reached_step").alias("reached"), F.round(F.avg("reached_step"), 6).alias("mean_step"))


@query(
    f"""WITH {STEPS_SQL}, f AS (SELECT *, CASE WHEN language = 'cpp' AND state = seed_state THEN 0 ELSE min(step) OVER (PARTITION BY trial, language, state) END AS first FROM steps), g AS (SELECT route, step, step <> first AS duplicate, 1 + sum(CASE WHEN step = first THEN 1 ELSE 0 END) OVER (PARTITION BY trial ORDER BY step) AS n FROM f)
    SELECT route, step, count(*) FILTER (duplicate) AS duplicates, round(avg(n), 6) AS mean_states, max(n) AS most FROM g GROUP BY ALL"""
)
def unique_state_growth(spark, sf):
    return chains.state_growth(step_view(spark, sf)).groupBy("route", "step").agg(F.count_if("duplicate").alias("duplicates"), F.round(F.avg("state_count"), 6).alias("mean_states"), F.max("state_count").alias("most"))


_STATES = "restored_ AS (SELECT trial, problem, route, state, row_number() OVER (PARTITION BY trial ORDER BY step) AS t FROM steps WHERE restored)"
_LAGS = "lagged AS (SELECT *, " + ", ".join(f"lag(state, {k}) OVER (PARTITION BY trial ORDER BY t) AS b{k}" for k in range(1, 8)) + " FROM restored_)"


def _repeats_sql(p: int) -> str:
    return " AND ".join(f"{'state' if k == 0 else f'b{k}'} = b{k + p}" for k in range(p))


_FIXED = f"""marked AS (SELECT *, coalesce(state = b1, false) AS fixed, CASE WHEN coalesce(state = b1, false) THEN NULL WHEN {_repeats_sql(2)} THEN 2 WHEN {_repeats_sql(3)} THEN 3 WHEN {_repeats_sql(4)} THEN 4 END AS p FROM lagged),
found AS (SELECT trial, min(problem) AS problem, min(route) AS route, min(t) FILTER (fixed) AS tau, arg_min(p, t) FILTER (p IS NOT NULL) AS p, min(t) FILTER (p IS NOT NULL) AS p_at FROM marked GROUP BY trial),
fixed_ AS (SELECT trial, problem, route, tau, CASE WHEN p_at < coalesce(tau, 1000000) THEN p END AS period, CASE WHEN p_at < coalesce(tau, 1000000) THEN p_at END AS period_at FROM found)"""


@query(f"WITH {STEPS_SQL}, {_STATES}, {_LAGS}, {_FIXED} SELECT route, tau, period, count(*) AS n, min(period_at) AS earliest FROM fixed_ GROUP BY ALL")
def fixed_point_tau(spark, sf):
    found = chains.fixed_points(chains.restored_states(step_view(spark, sf)))
    return found.groupBy("route", "tau", "period").agg(F.count("*").alias("n"), F.min("period_at").alias("earliest"))


@query(f"WITH {STEPS_SQL}, {_STATES}, {_LAGS} SELECT route, t, count(*) FILTER (coalesce(state = b2 AND b1 = b3 AND state <> b1, false)) AS oscillating, count(*) AS n FROM lagged GROUP BY ALL")
def legacy_oscillation(spark, sf):
    return chains.legacy_oscillation(chains.restored_states(step_view(spark, sf))).groupBy("route", "t").agg(F.count_if("oscillates").alias("oscillating"), F.count("*").alias("n"))


_HELD = """after_ AS (SELECT r.trial, r.route, r.t, f.tau, r.state = first_value(r.state) OVER (PARTITION BY r.trial ORDER BY r.t) AS same FROM restored_ r JOIN fixed_ f ON r.trial = f.trial AND r.t >= f.tau),
kept AS (SELECT *, bool_and(same) OVER (PARTITION BY trial ORDER BY t) AS kept FROM after_),
held AS (SELECT trial, min(route) AS route, min(tau) AS tau, count(*) FILTER (kept AND t > tau) AS held, count(*) FILTER (t > tau) AS run FROM kept GROUP BY trial)"""


@query(f"WITH {STEPS_SQL}, {_STATES}, {_LAGS}, {_FIXED}, {_HELD} SELECT route, held, run, count(*) AS n FROM held GROUP BY ALL")
def confirmations_held(spark, sf):
    found = chains.confirmations_held(chains.restored_states(step_view(spark, sf)))
    return found.groupBy("route", "held", "run").agg(F.count("*").alias("n"))


@query(
    f"""WITH {STEPS_SQL}, {_STATES}, {_LAGS}, {_FIXED}, {_HELD}, every_ AS (SELECT f.trial, f.route, f.tau, coalesce(h.held, 0) AS held FROM fixed_ f LEFT JOIN held h USING (trial))
    SELECT route, c, count(*) AS n, count(*) FILTER (tau IS NOT NULL AND held >= c) AS successes, round(count(*) FILTER (tau IS NOT NULL AND held >= c) / count(*), 6) AS p, round(1 - count(*) FILTER (tau IS NOT NULL AND held >= c) / count(*), 6) AS d
    FROM every_ CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS c) GROUP BY route, c"""
)
def sf_by_confirmation(spark, sf):
    states = chains.restored_states(step_view(spark, sf))
    held = chains.confirmations_held(states).select("trial", "held")
    rows = chains.fixed_points(states).select("trial", "route", "tau").join(held, "trial", "left").fillna(0, ["held"])
    return outcomes.by_confirmation(rows, 3)


@query(
    f"""WITH {STEPS_SQL}, {_STATES}, cells AS (SELECT route, trial // 3 AS instance, t, count(DISTINCT trial % 3) AS n, count(DISTINCT state) AS kinds FROM restored_ GROUP BY ALL)
    SELECT route, count(*) FILTER (n = 3) AS comparable, count(*) FILTER (n = 3 AND kinds = 1) AS matched, count(*) FILTER (n < 3) AS unreached FROM cells GROUP BY route"""
)
def hash_repeatability(spark, sf):
    states = chains.restored_states(step_view(spark, sf))
    return chains.repeatability(states, F.floor(F.col("trial") / 3), F.col("trial") % 3, 3)


@query(f"WITH {STEPS_SQL}, n AS (SELECT trial, count(*) AS n, min(step) AS low, max(step) AS high FROM steps WHERE NOT (trial % 11 = 0 AND step = 2) GROUP BY trial) SELECT trial, n, low, high, n AS \"distinct\" FROM n WHERE low <> 1 OR high <> n")
def audit_step_numbering(spark, sf):
    return chains.numbering_faults(step_view(spark, sf).filter("not (trial % 11 = 0 and step = 2)"))


@query(f"WITH {STEPS_SQL}, f AS (SELECT *, max(CASE WHEN functional THEN 0 ELSE 1 END) OVER (PARTITION BY trial ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM steps) SELECT route, step, count(*) AS n FROM f WHERE ended = 1 GROUP BY ALL")
def audit_after_terminal(spark, sf):
    return chains.after_terminal(step_view(spark, sf), ~F.col("functional")).groupBy("route", "step").agg(F.count("*").alias("n"))


@query(f"WITH {STEPS_SQL}, l AS (SELECT coalesce(lag(status) OVER (PARTITION BY trial ORDER BY step), 'running') AS from_status, status FROM steps) SELECT from_status, status, count(*) AS n FROM l GROUP BY ALL")
def status_transitions(spark, sf):
    return chains.status_transitions(step_view(spark, sf)).groupBy("from_status", "status").agg(F.count("*").alias("n"))


@query(f"WITH {STEPS_SQL}, g AS (SELECT *, bool_and(cost IS NOT NULL) OVER (PARTITION BY trial ORDER BY step) AS keep FROM steps) SELECT route, count(*) AS kept, max(step) AS longest FROM g WHERE keep GROUP BY route")
def resume_prefix(spark, sf):
    return chains.contiguous_prefix(step_view(spark, sf), F.col("cost").isNotNull()).groupBy("route").agg(F.count("*").alias("kept"), F.max("step").alias("longest"))


@query(
    f"""WITH {STEPS_SQL}, l AS (SELECT *, last_value(CASE WHEN restored THEN similarity END IGNORE NULLS) OVER (PARTITION BY trial ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM steps)
    SELECT route, step, count(previous) AS n, round(avg(similarity - previous), 6) AS mean_change FROM l WHERE restored GROUP BY ALL"""
)
def adjacent_restored_change(spark, sf):
    found = chains.previous_restored(step_view(spark, sf), "similarity").filter("restored")
    return found.groupBy("route", "step").agg(F.count("previous").alias("n"), F.round(F.avg(F.col("similarity") - F.col("previous")), 6).alias("mean_change"))


# Folds. Their SQL is the window form.

_HOPS = f"""w AS (SELECT trial, min(problem) AS problem, min(route) AS route, count(*) AS n, min(step) FILTER (NOT functional) AS f FROM steps GROUP BY trial),
hop_reach AS ({_REACH.replace("restored AND so_far", "restored AND so_far AND step <= 10")}),
due AS (SELECT h.trial, h.reached_step + 2 AS due FROM hop_reach h WHERE threshold = '0.80'),
told AS (SELECT w.*, d.due, s.similarity AS due_similarity, CASE WHEN d.due IS NULL THEN NULL WHEN f <= d.due THEN 'failed' WHEN n < d.due THEN NULL WHEN s.similarity >= 0.8 THEN 'passed' ELSE 'failed' END AS confirmation
  FROM w LEFT JOIN due d USING (trial) LEFT JOIN steps s ON s.trial = w.trial AND s.step = d.due)"""


@query(
    f"""WITH {STEPS_SQL}, {_OK}, {_HOPS} SELECT h.route, h.threshold, CASE WHEN h.reached_step IS NOT NULL THEN 'success' WHEN f <= 10 THEN 'functional_failure' WHEN n >= 10 THEN 'hop_limit' ELSE 'incomplete' END AS category, h.reached_step, t.confirmation, count(*) AS n
    FROM hop_reach h JOIN told t USING (trial) GROUP BY ALL"""
)
def hops_state_fold(spark, sf):
    out = folds.hops(folds.collected(step_view(spark, sf), 12), THRESHOLDS, 0.80)
    return out.select("route", "confirmation", F.explode("outcomes").alias("o")).groupBy("route", "o.threshold", "o.category", "o.reached_step", "confirmation").agg(F.count("*").alias("n"))


@query(
    f"""WITH {STEPS_SQL}, {_OK}, {_HOPS}, r AS (SELECT h.route, CASE WHEN h.reached_step IS NOT NULL THEN 'success' ELSE 'other' END AS category, t.confirmation FROM hop_reach h JOIN told t USING (trial) WHERE threshold = '0.80'),
    c AS (SELECT route, count(*) FILTER (category = 'success') AS successes, count(*) FILTER (category = 'success' AND confirmation = 'passed') AS passed, count(*) FILTER (category = 'success' AND confirmation = 'failed') AS failed, count(*) FILTER (category = 'success' AND confirmation IS NULL) AS unavailable FROM r GROUP BY route)
    SELECT *, round(passed / nullif(passed + failed, 0), 6) AS retention, round(unavailable / nullif(successes, 0), 6) AS unavailable_share FROM c"""
)
def confirmation_retention(spark, sf):
    out = folds.hops(folds.collected(step_view(spark, sf), 12), THRESHOLDS, 0.80)
    rows = out.select("route", "confirmation", F.explode("outcomes").alias("o")).filter("o.threshold = '0.80'")
    return outcomes.retention(rows.select("route", "confirmation", "o.category"), "route")


_FPS = """seen AS (SELECT *, CASE WHEN language = 'cpp' AND state = seed_state THEN 0 ELSE min(step) OVER (PARTITION BY trial, language, state) END AS first FROM steps),
sized AS (SELECT *, 1 + sum(CASE WHEN step = first THEN 1 ELSE 0 END) OVER (PARTITION BY trial ORDER BY step) AS size, count(*) FILTER (restored AND functional) OVER (PARTITION BY trial ORDER BY step) AS trips FROM seen),
stops AS (SELECT trial, min(problem) AS problem, min(route) AS route, max(step) AS n, min(step) FILTER (NOT functional) AS f, min(step) FILTER (size > 4) AS g, min(step) FILTER (restored AND similarity >= 0.9) AS m FROM sized GROUP BY trial),
ends AS (SELECT *, least(coalesce(f, 8), coalesce(g, 8), coalesce(m, 8), 8) AS stop FROM stops),
ended AS (SELECT *, CASE WHEN f = stop THEN 'wrong_answer' WHEN g = stop THEN 'max_distance_reached' WHEN m = stop THEN 'collection_complete' WHEN n >= 8 THEN 'translation_budget_reached' END AS terminal FROM ends),
measured AS (SELECT e.trial, count(s.step) FILTER (s.restored AND s.step <= e.stop AND (e.f IS NULL OR s.step < e.f) AND (e.g IS NULL OR s.step < e.g)) AS k FROM ended e JOIN sized s USING (trial) GROUP BY e.trial)"""
_FPS_OUT = " UNION ALL ".join(
    f"""SELECT e.trial, min(e.problem) AS problem, min(e.route) AS route, '{t:.2f}' AS threshold, min(e.terminal) AS terminal, min(e.stop) AS stop,
  min(s.step) FILTER (s.restored AND s.similarity >= {t} AND s.step <= e.stop AND (e.f IS NULL OR s.step < e.f) AND (e.g IS NULL OR s.step < e.g)) AS reached_step FROM ended e JOIN sized s USING (trial) GROUP BY e.trial"""
    for t in THRESHOLDS
)
_FPS_ROWS = f"""out_ AS ({_FPS_OUT}), rows_ AS (SELECT o.trial, o.problem, o.route, o.threshold, o.reached_step, s.size AS d_n, s.trips AS reached_roundtrip,
  CASE WHEN o.reached_step IS NOT NULL THEN 'success' WHEN terminal IS NULL THEN 'incomplete' WHEN k = 0 AND terminal IN ('max_distance_reached', 'translation_budget_reached') THEN 'invalid' WHEN terminal = 'wrong_answer' THEN 'functional_failure' WHEN terminal = 'max_distance_reached' THEN 'fps_limit' WHEN terminal = 'translation_budget_reached' THEN 'budget' ELSE 'collection_complete' END AS category
  FROM out_ o JOIN measured m USING (trial) LEFT JOIN sized s ON s.trial = o.trial AND s.step = o.reached_step)"""


def _fps(spark, sf):
    out = folds.fps(folds.collected(step_view(spark, sf), 8), THRESHOLDS, max_states=4, max_steps=8)
    return out.select("trial", "problem", "route", F.explode("outcomes").alias("o")).select("trial", "problem", "route", "o.*")


@query(f"WITH {STEPS_SQL}, {_FPS}, {_FPS_ROWS} SELECT route, threshold, category, reached_step, d_n, reached_roundtrip, count(*) AS n FROM rows_ GROUP BY ALL")
def fps_state_fold(spark, sf):
    return _fps(spark, sf).groupBy("route", "threshold", "category", "reached_step", "d_n", "reached_roundtrip").agg(F.count("*").alias("n"))


@query(
    f"""WITH {STEPS_SQL}, {_FPS}, {_FPS_ROWS}, c AS (SELECT route, problem, count(*) FILTER (category <> 'invalid') AS valid, count(*) FILTER (category = 'success') AS hits, sum(d_n) FILTER (category = 'success') AS d_sum FROM rows_ WHERE threshold = '0.80' GROUP BY ALL)
    SELECT route, round(avg(hits / nullif(valid, 0)), 6) AS p_sf, round(sum(hits) / nullif(sum(valid), 0), 6) AS pooled_p, sum(valid) AS valid, round(sum(d_sum) / nullif(sum(hits), 0), 6) AS d_n, count(d_sum) AS d_n_problems, round(avg((coalesce(d_sum, 0) + 11 * (valid - hits)) / nullif(valid, 0)), 6) AS d_plus FROM c GROUP BY route"""
)
def dplus(spark, sf):
    return outcomes.fps_summary(_fps(spark, sf).filter("threshold = '0.80'"))


@query(
    f"""WITH {STEPS_SQL}, {_OK}, w AS (SELECT trial, min(route) AS route, count(*) AS n, min(step) FILTER (NOT functional) AS f, count(*) FILTER (restored AND so_far) AS k, min(step) FILTER (restored AND so_far AND similarity >= 0.8) AS r FROM ok WHERE step <= 8 GROUP BY trial)
    SELECT route, CASE WHEN r IS NOT NULL THEN 'success' WHEN f IS NOT NULL THEN 'functional_failure' WHEN n >= 8 THEN CASE WHEN k > 0 THEN 'budget' ELSE 'invalid' END ELSE 'incomplete' END AS category, r AS reached_step, count(*) AS n FROM w GROUP BY ALL"""
)
def threshold_policy(spark, sf):
    return folds.threshold_policy(folds.collected(step_view(spark, sf), 8), 0.8, 8).groupBy("route", "category", "reached_step").agg(F.count("*").alias("n"))


@query(
    f"""WITH {STEPS_SQL}, s AS (SELECT * FROM steps WHERE step <= 12), r AS (SELECT trial, row_number() OVER (PARTITION BY trial ORDER BY step) AS t, step, state FROM s WHERE restored UNION ALL SELECT DISTINCT trial, 0, 0, '' FROM s),
    l AS (SELECT *, {", ".join(f"lag(state, {k}) OVER w AS b{k}" for k in range(1, 8))} FROM r WINDOW w AS (PARTITION BY trial ORDER BY t)),
    m AS (SELECT trial, step, state = b1 AS same, coalesce((state = b2 AND b1 = b3) OR (state = b3 AND b1 = b4 AND b2 = b5) OR (state = b4 AND b1 = b5 AND b2 = b6 AND b3 = b7), false) AS period FROM l WHERE t > 0),
    c AS (SELECT trial, min(step) FILTER (same) AS c FROM m GROUP BY trial),
    k AS (SELECT m.trial, min(step) FILTER (period AND NOT same AND step < coalesce(c, 99)) AS o, min(step) FILTER (NOT same AND step > c) AS b, min(step) FILTER (same AND step > c) AS v FROM m JOIN c ON c.trial = m.trial GROUP BY m.trial),
    f AS (SELECT trial, min(route) AS route, min(step) FILTER (status <> 'success') AS f, arg_min(status, step) FILTER (status <> 'success') AS failed, max(step) AS n FROM s GROUP BY trial),
    e AS (SELECT f.*, c, o, b, v, least(coalesce(f, 99), coalesce(o, 99), coalesce(b, 99), coalesce(v, 99), CASE WHEN n >= 12 THEN 12 ELSE 99 END) AS stop FROM f LEFT JOIN c ON c.trial = f.trial LEFT JOIN k ON k.trial = f.trial),
    g AS (SELECT route, c, CASE WHEN stop = 99 THEN 'incomplete' WHEN stop = f THEN 'functional_failure' WHEN stop = b OR stop = o THEN 'unstable' WHEN stop = v THEN 'success' ELSE 'budget' END AS category,
      CASE WHEN stop = 99 THEN NULL WHEN stop = f THEN failed WHEN stop = b THEN 'confirmation_failed' WHEN stop = o THEN 'oscillation' WHEN stop = v THEN 'converged' ELSE 'translation_budget_reached' END AS status FROM e)
    SELECT route, status, category, CASE WHEN category = 'success' THEN c END AS reached_step, count(*) AS n FROM g GROUP BY ALL"""
)
def fixed_point_policy(spark, sf):
    return folds.fixed_point_policy(folds.collected(step_view(spark, sf), 12), 1, 12).groupBy("route", "status", "category", "reached_step").agg(F.count("*").alias("n"))


@query(f"WITH {STEPS_SQL}, {_OK}, reach AS ({_REACH}), k AS (SELECT route, threshold, CASE WHEN reached_step IS NOT NULL THEN 'success' WHEN trial % 9 = 0 THEN 'invalid' ELSE 'hop_limit' END AS category FROM reach) SELECT threshold, route, grouping(threshold) * 2 + grouping(route) AS level, count(*) AS slots, count(*) FILTER (category <> 'invalid') AS valid, bool_and(category <> 'invalid') AS complete, count(*) FILTER (category = 'success') AS successes FROM k GROUP BY ROLLUP (threshold, route)")
def threshold_grouping_sets(spark, sf):
    reach = chains.first_reach(step_view(spark, sf), THRESHOLDS)
    category = F.when(F.col("reached_step").isNotNull(), "success").when(F.col("trial") % 9 == 0, "invalid").otherwise("hop_limit")
    return outcomes.grouping_sets(reach.withColumn("category", category)).withColumn("level", F.col("level").cast("long"))


@query(f"WITH {STEPS_SQL}, {_OK}, reach AS ({_REACH}), p AS (SELECT route, threshold, round(count(reached_step) / count(*), 6) AS p FROM reach GROUP BY ALL) SELECT route, " + ", ".join(f"max(p) FILTER (threshold = '{t:.2f}') AS \"{t:.2f}\"" for t in THRESHOLDS) + " FROM p GROUP BY route")
def wide_rates(spark, sf):
    reach = chains.first_reach(step_view(spark, sf), THRESHOLDS)
    rates = reach.groupBy("route", "threshold").agg(F.round(F.count("reached_step") / F.count("*"), 6).alias("p"))
    return outcomes.wide(rates, "p", [f"{t:.2f}" for t in THRESHOLDS])


# Resampling


_DRAWS = f"""draws AS (SELECT r AS replicate, ('0x' || substr(md5(r || '-' || i), 1, 8))::BIGINT % {BLOCKS} AS problem FROM range({REPLICATES}) a(r), range({BLOCKS}) b(i)), weights AS (SELECT replicate, problem, count(*) AS weight FROM draws GROUP BY ALL),
totals AS (SELECT route, problem, count(*) FILTER (category IN ('success', 'functional_failure', 'hop_limit')) AS valid, count(*) FILTER (category = 'success') AS hits, coalesce(sum(reached_step) FILTER (category = 'success'), 0) AS hops FROM outcomes GROUP BY ALL),
sums AS (SELECT route, replicate, sum(weight * valid) AS valid, sum(weight * hits) AS hits, sum(weight * hops) AS hops FROM totals JOIN weights USING (problem) GROUP BY ALL),
reps AS (SELECT route, replicate, hits / nullif(valid, 0) AS p, hops / nullif(hits, 0) AS h, (hops / nullif(hits, 0)) / nullif(hits / nullif(valid, 0), 0) AS d FROM sums)"""


def _interval_sql(value: str, alpha: float) -> str:
    return f"CASE WHEN count({value}) = count(*) THEN round(quantile_cont({value}, {alpha / 2!r}), 6) END AS low, CASE WHEN count({value}) = count(*) THEN round(quantile_cont({value}, {1 - alpha / 2!r}), 6) END AS high, round(1 - count({value}) / count(*), 6) AS missing_fraction"


@query(f"WITH {OUTCOMES_SQL}, {_DRAWS} " + " UNION ALL ".join(f"SELECT route, '{v.upper()}' AS metric, {_interval_sql(v, 0.05)} FROM reps GROUP BY route" for v in "phd"))
def block_bootstrap_ci(spark, sf):
    reps = resampling.replicate_metrics(outcome_view(spark, sf), resampling.md5_weights(spark, REPLICATES, BLOCKS))
    return audits.union_all([resampling.interval(reps, m, ["route"]).withColumn("metric", F.lit(m)) for m in ("P", "H", "D")]).select("route", "metric", "low", "high", "missing_fraction")


@query(f"WITH {OUTCOMES_SQL}, {_DRAWS}, pairs AS (SELECT a.route AS left_route, b.route AS right_route, a.d - b.d AS difference FROM reps a JOIN reps b USING (replicate) WHERE a.route < b.route) SELECT left_route, right_route, {_interval_sql('difference', 0.05 / 10)} FROM pairs GROUP BY ALL")
def paired_bootstrap(spark, sf):
    return resampling.paired_differences(outcome_view(spark, sf), resampling.md5_weights(spark, REPLICATES, BLOCKS), "D", 10)


@query(f"WITH {OUTCOMES_SQL}, {_DRAWS}, r AS (SELECT route, replicate, sum(weight * (hits / valid)) / sum(weight) AS rate FROM totals JOIN weights USING (problem) WHERE valid > 0 GROUP BY ALL) SELECT route, {_interval_sql('rate', 0.05)} FROM r GROUP BY route")
def cluster_bootstrap_weighted(spark, sf):
    rates = resampling.problem_rates(outcome_view(spark, sf), resampling.md5_weights(spark, REPLICATES, BLOCKS))
    return resampling.interval(rates, "rate", ["route"], policy="most")


@query(f"WITH {OUTCOMES_SQL}, {_DRAWS}, b AS (SELECT x.route AS left_route, y.route AS right_route, problem, x.hits / x.valid - y.hits / y.valid AS difference FROM totals x JOIN totals y USING (problem) WHERE x.route < y.route AND x.valid > 0 AND y.valid > 0), r AS (SELECT left_route, right_route, replicate, sum(weight * difference) / sum(weight) AS difference FROM b JOIN weights USING (problem) GROUP BY ALL) SELECT left_route, right_route, {_interval_sql('difference', 0.05 / 10)} FROM r GROUP BY ALL")
def bonferroni_common_problems(spark, sf):
    return resampling.common_problem_differences(outcome_view(spark, sf), resampling.md5_weights(spark, REPLICATES, BLOCKS), 10)


@query(f"WITH {OUTCOMES_SQL}, {_DRAWS}, v AS (SELECT route, replicate, reached_step AS x FROM outcomes JOIN weights USING (problem), range(weight) WHERE category = 'success'), m AS (SELECT route, replicate, quantile_cont(x, 0.5) AS median FROM v GROUP BY ALL) SELECT route, {_interval_sql('median', 0.05)} FROM m GROUP BY route")
def conditional_median_bootstrap(spark, sf):
    reps = resampling.conditional_medians(outcome_view(spark, sf), resampling.md5_weights(spark, REPLICATES, BLOCKS), "reached_step")
    return resampling.interval(reps, "median", ["route"])


# Rankings

_RANK = f"""c AS (SELECT route, {_COUNTS} FROM outcomes GROUP BY route), m AS (SELECT route, {_METRICS} FROM c), ranks AS (SELECT route, "D", row_number() OVER (ORDER BY "D", route) AS rank FROM m WHERE "D" IS NOT NULL)"""


@query(f'WITH {OUTCOMES_SQL}, {_RANK} SELECT route, "D", rank FROM ranks')
def route_ranking(spark, sf):
    return ranking.ranked(outcomes.reach_metrics(outcome_view(spark, sf), "route"), "D").select("route", "D", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {STEPS_SQL}, {_OK}, reach AS ({_REACH}), p AS (SELECT route, threshold, round(avg(reached_step), 6) AS h FROM reach GROUP BY ALL), k AS (SELECT threshold, string_agg(route, ',' ORDER BY h, route) AS \"order\" FROM p WHERE h IS NOT NULL GROUP BY threshold) SELECT count(*) AS n, count(DISTINCT \"order\") AS orders, count(DISTINCT \"order\") = 1 AS stable FROM k")
def ranking_stability(spark, sf):
    reach = chains.first_reach(step_view(spark, sf), THRESHOLDS)
    means = reach.groupBy("route", "threshold").agg(F.round(F.avg("reached_step"), 6).alias("h"))
    return ranking.stability(ranking.ranked(means, "h", "threshold"), "threshold")


@query(
    f"""WITH {OUTCOMES_SQL}, {_RANK}, {_DRAWS}, pairs AS (SELECT a.route AS "first", b.route AS "second", a.rank AS position FROM ranks a JOIN ranks b ON b.rank = a.rank + 1),
    diffs AS (SELECT a.route AS x, b.route AS y, {_interval_sql('(a.d - b.d)', 0.05 / 10)} FROM reps a JOIN reps b USING (replicate) WHERE a.route <> b.route GROUP BY ALL)
    SELECT "first", "second", position, low, high, coalesce(high < 0, false) AS supported FROM pairs LEFT JOIN diffs ON x = "first" AND y = "second" """
)
def pair_support(spark, sf):
    seen = outcome_view(spark, sf)
    ranks = ranking.ranked(outcomes.reach_metrics(seen, "route"), "D")
    found = ranking.neighbour_support(ranks, resampling.paired_differences(seen, resampling.md5_weights(spark, REPLICATES, BLOCKS), "D", 10))
    return found.select("first", "second", F.col("position").cast("long").alias("position"), "low", "high", "supported")


# Text


def _documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# The literals in the plain form, for an engine that needs no possessive loops.
_QUOTED = r"""("(?s:\\.|[^"\\])*(?:"|\z)|'(?s:\\.|[^'\\])*(?:'|\z))|//[^\n]*|(/\*)(?s:.*?)(?:\*/|\z)"""
_LITERALS = r"""\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|"""
_C_TOKENS = _LITERALS.replace('\\"', '"') + text.C_TOKENS[text.C_TOKENS.index("[A-Za-z_]") :]
_TOKENS = f"regexp_extract_all(regexp_replace(text, {_q(_QUOTED)}, '\\1 ', 'g'), {_q(_C_TOKENS)})"


@query(f"SELECT doc_id, len({_TOKENS}) AS n_tokens, sha256(array_to_string({_TOKENS}, chr(0))) AS token_sha256 FROM documents")
def token_normalise_hash(spark, sf):
    tokens = text.c_tokens(F.col("text"))
    return _documents(spark, sf).withColumn("tokens", tokens).select("doc_id", F.size("tokens").alias("n_tokens"), text.token_hash(F.col("tokens")).alias("token_sha256"))


@query("SELECT sha256(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS source_sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_sources(spark, sf):
    rows = _documents(spark, sf).select(F.col("doc_id").alias("id"), text.state_hash(F.col("text")).alias("source_sha256"))
    return audits.duplicate_groups(rows, "source_sha256")


def _turns(spark, sf):
    """Neighbouring turns of a conversation with their words."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = rows.withColumn("before", F.lag("text").over(w)).filter("before is not null")
    return pairs.select(F.concat_ws("-", "conv_id", "turn").alias("pair_id"), text.words(F.col("before")).alias("a"), text.words(F.col("text")).alias("b"), "before", "text")


_TURNS = "t AS (SELECT conv_id || '-' || turn AS pair_id, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, text FROM conversations), p AS (SELECT pair_id, before, text, list_filter(string_split_regex(before, '\\s+'), lambda x: x <> '') AS a, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS b FROM t WHERE before IS NOT NULL)"
_SHARED = "ca AS (SELECT pair_id, w, count(*) AS n FROM (SELECT pair_id, unnest(a) AS w FROM p) GROUP BY ALL), cb AS (SELECT pair_id, w, count(*) AS n FROM (SELECT pair_id, unnest(b) AS w FROM p) GROUP BY ALL), s AS (SELECT pair_id, sum(least(ca.n, cb.n)) AS shared FROM ca JOIN cb USING (pair_id, w) GROUP BY pair_id)"


@query(f"WITH {_TURNS}, {_SHARED} SELECT pair_id, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE round(2 * coalesce(shared, 0) / (len(a) + len(b)), 6) END::DOUBLE AS dice FROM p LEFT JOIN s USING (pair_id)")
def adjacent_dice(spark, sf):
    return text.pair_dice(_turns(spark, sf)).select("pair_id", F.round("dice", 6).alias("dice"))


@query(f"WITH {_TURNS}, {_SHARED} SELECT CASE WHEN trim(before) = '' OR trim(text) = '' THEN 'unavailable' ELSE 'measured' END AS status, count(*) AS n, round(avg(CASE WHEN trim(before) <> '' AND trim(text) <> '' THEN 2 * coalesce(shared, 0) / (len(a) + len(b)) END), 6) AS mean FROM p LEFT JOIN s USING (pair_id) GROUP BY 1")
def residual_dice(spark, sf):
    rows = text.pair_dice(_turns(spark, sf))
    measured = rows.withColumn("m", text.residual(F.col("before"), F.col("text"), F.col("dice"), F.col("a"), F.col("b")))
    return measured.groupBy(F.col("m.status").alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("m.value"), 6).alias("mean"))


@query()
def sequence_ratio(spark, sf):
    return _turns(spark, sf).select("pair_id", text.sequence_ratio("a", "b").alias("ratio"))


def _neighbours(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, a, b): the value of each row and of the row whose key is one higher.

    Pairs are work for the processors rather than many bytes, so their partitions are not merged by size.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    first, second = rows.select(key, F.col(value).alias("a")), rows.select((F.col(key) - 1).alias(key), F.col(value).alias("b"))
    return first.repartition(parts, key).join(second.repartition(parts, key), key)


@query()
def token_tiling(spark, sf):
    """Greedy tiling of each document with the next."""
    pairs = _neighbours(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", *[text.c_tokens(F.col(c)).alias(c) for c in "ab"])
    found = structure.tiled(pairs).select("doc_id", F.size("a").alias("n_a"), F.size("b").alias("n_b"), "covered", F.round("similarity", 6).alias("similarity"))
    return found


@query()
def page_tree_similarity(spark, sf):
    """Edit similarity of each page's tree with the next one's; ends that pages leave out are implied."""
    pairs = _neighbours(table(spark, sf, "pages"), "page_id", "html").select("page_id", *[structure.page_events(F.col(c)).alias(c) for c in "ab"])
    found = pairs.withColumn("m", structure.tree_similarity(strict=False)("a", "b"))
    return found.select("page_id", "m.status", F.round("m.value", 6).alias("value"), "m.ted", "m.reason", F.col("m.nodes")[0].alias("nodes"), F.col("m.nodes")[1].alias("next_nodes"))


_RESPONSES = [("one", "Here:\n```cpp\nint main() { return 0; }\n```\ndone"), ("two", "```\na\n```\nor\n```\nb\n```"), ("none", "int x = 1;\n"), ("blank", "```cpp\n\n```")]


@query("SELECT * FROM (VALUES ('one', 'ok', 'int main() { return 0; }'), ('two', 'multiple_blocks', NULL), ('none', 'ok', 'int x = 1;'), ('blank', 'empty', NULL)) v(id, status, code)")
def fenced_extraction(spark, sf):
    rows = spark.createDataFrame(_RESPONSES, "id string, response string")
    return rows.withColumn("x", text.extracted_code(F.col("response"))).select("id", "x.status", "x.code")


@query(
    """WITH c AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN text || chr(10) WHEN 1 THEN replace(text, ' ', '  ') WHEN 2 THEN text || 'x' ELSE text END AS other, doc_id % 13 = 0 AS slow, doc_id % 17 = 0 AS crash FROM documents),
    k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '(?m)[ \\t\\f\\x0B]+$', '', 'g'), '^\\s+|\\s+\\z', '', 'g') AS x, regexp_replace(regexp_replace(regexp_replace(other, '\\r\\n?', chr(10), 'g'), '(?m)[ \\t\\f\\x0B]+$', '', 'g'), '^\\s+|\\s+\\z', '', 'g') AS y FROM c)
    SELECT CASE WHEN slow THEN 'timeout' WHEN crash THEN 'runtime_error' WHEN x = y THEN 'success' ELSE 'wrong_answer' END AS status, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') = list_filter(string_split_regex(other, '\\s+'), lambda w: w <> '') AS same_words, count(*) AS n FROM k GROUP BY ALL"""
)
def canonical_output_compare(spark, sf):
    kind = F.col("doc_id") % 4
    other = F.when(kind == 0, F.concat("text", F.lit("\n"))).when(kind == 1, F.replace("text", F.lit(" "), F.lit("  "))).when(kind == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    rows = _documents(spark, sf).withColumn("other", other)
    status = stats.case_status(F.col("doc_id") % 13 == 0, F.when(F.col("doc_id") % 17 == 0, 1).otherwise(0), text.canonical_output(F.col("text")), text.canonical_output(F.col("other")))
    return rows.groupBy(status.alias("status"), text.same_words(F.col("text"), F.col("other")).alias("same_words")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {STEPS_SQL}, c AS (SELECT trial, step, CASE WHEN functional THEN 'success' WHEN trial % 3 = 0 AND step % 2 = 0 THEN 'timeout' WHEN trial % 3 = 1 THEN 'runtime_error' ELSE 'wrong_answer' END AS status FROM steps),
    b AS (SELECT trial, CASE WHEN bool_or(status = 'timeout') THEN 'timeout' WHEN bool_or(status = 'runtime_error') THEN 'runtime_error' WHEN bool_or(status = 'wrong_answer') THEN 'wrong_answer' ELSE 'success' END AS by_priority, coalesce(arg_min(status, step) FILTER (status <> 'success'), 'success') AS by_first FROM c GROUP BY trial)
    SELECT by_priority, by_first, count(*) AS n FROM b GROUP BY ALL"""
)
def batch_status(spark, sf):
    status = F.when(F.col("functional"), "success").when((F.col("trial") % 3 == 0) & (F.col("step") % 2 == 0), "timeout").when(F.col("trial") % 3 == 1, "runtime_error").otherwise("wrong_answer")
    cases = step_view(spark, sf).select("trial", "step", status.alias("status"))
    told = cases.groupBy("trial").agg(stats.batch_status_by_priority(F.col("status")).alias("by_priority"), stats.batch_status_by_first(F.col("status"), F.col("step")).alias("by_first"))
    return told.groupBy("by_priority", "by_first").agg(F.count("*").alias("n"))


@query(
    """WITH d AS (SELECT doc_id, array_to_string(list_filter(string_split_regex(unnest(string_split(text, chr(10))), '\\s+'), lambda x: x <> ''), ' ') AS line FROM documents), b AS (SELECT DISTINCT array_to_string(list_filter(string_split_regex(unnest(string_split(text, chr(10))), '\\s+'), lambda x: x <> ''), ' ') AS line FROM benchmark)
    SELECT doc_id, count(*) AS lines FROM d WHERE line <> '' AND line IN (SELECT line FROM b) GROUP BY doc_id"""
)
def leak_check(spark, sf):
    def lines(rows, *keep):
        split = rows.select(*keep, F.explode(F.split("text", "\n")).alias("line"))
        return split.select(*keep, text.normalised_input(F.col("line"), "tokens").alias("line")).filter("line <> ''")

    found = audits.leaks(lines(_documents(spark, sf), "doc_id"), lines(table(spark, sf, "benchmark")), "line")
    return found.groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("SELECT lang, CASE WHEN l.quality IS NULL THEN 'unavailable' ELSE 'measured' END AS status, count(*) AS n, round(avg(l.quality), 6) AS mean FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL")
def measurement_status(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "unavailable").otherwise("measured")
    return rows.groupBy("lang", status.alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean"))


@query("SELECT lang, count(*) AS cases, count(DISTINCT text) AS distinct_inputs, max(strlen(text)) AS max_bytes, 0::BIGINT AS incomplete FROM documents GROUP BY lang")
def corpus_profile(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("lang").alias("problem"), F.col("text").alias("input"), F.lit(None).cast("string").alias("fault"))
    return audits.corpus_profile(rows).withColumnRenamed("problem", "lang")


# Audits


@query(f"WITH {OUTCOMES_SQL} SELECT problem, route, attempt FROM outcomes WHERE {_LOST}")
def audit_missing(spark, sf):
    seen = outcome_view(spark, sf)
    return audits.missing(seen, seen.filter(f"not ({_LOST})"))


@query(f"WITH {OUTCOMES_SQL} SELECT problem, route, attempt FROM outcomes WHERE problem >= 14")
def audit_unplanned(spark, sf):
    seen = outcome_view(spark, sf)
    return audits.unplanned(seen.filter("problem < 14"), seen)


@query("SELECT o_custkey AS customer, o_orderpriority AS route, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def audit_duplicate(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("route"))
    return audits.duplicated(rows, ["customer", "route"])


_BROKEN = "broken AS (SELECT problem, route, attempt, CASE WHEN attempt % 23 = 0 THEN 'success' ELSE category END AS category, CASE WHEN attempt % 29 = 0 THEN coalesce(reached_step, 2) + 3 ELSE reached_step END AS reached_step FROM outcomes)"


@query(f"WITH {OUTCOMES_SQL}, {_BROKEN} " + " UNION ALL ".join(f"SELECT '{r}' AS rule, problem, route, attempt FROM broken WHERE {c}" for r, c in audits.OBSERVATION_RULES.items()))
def audit_violations(spark, sf):
    seen = outcome_view(spark, sf).withColumn("category", F.when(F.col("attempt") % 23 == 0, "success").otherwise(F.col("category")))
    return audits.violations(seen.withColumn("reached_step", F.when(F.col("attempt") % 29 == 0, F.coalesce("reached_step", F.lit(2)) + 3).otherwise(F.col("reached_step"))))


@query(f"WITH {STEPS_SQL}, {_OK}, reach AS ({_REACH}) SELECT trial, threshold, 'reached_step' AS field, CAST(coalesce(reached_step, 0) + 1 AS VARCHAR) AS recorded, CAST(reached_step AS VARCHAR) AS derived FROM reach WHERE trial % 31 = 0")
def audit_rederived(spark, sf):
    derived = chains.first_reach(step_view(spark, sf), THRESHOLDS).select("trial", "threshold", "reached_step")
    recorded = derived.withColumn("reached_step", F.when(F.col("trial") % 31 == 0, F.coalesce("reached_step", F.lit(0)) + 1).otherwise(F.col("reached_step")))
    return audits.reach_evidence_faults(derived, recorded).select("trial", "threshold", "field", F.col("recorded"), F.col("derived"))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'unexpected' ELSE 'changed' END AS fault FROM (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 10 <> 1) a FULL JOIN (SELECT doc_id, md5(CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 2) b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h")
def inventory_differences(spark, sf):
    docs = _documents(spark, sf)
    expected = docs.filter("doc_id % 10 <> 1").select("doc_id", F.md5("text").alias("h"))
    actual = docs.filter("doc_id % 10 <> 2").select("doc_id", F.md5(F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"))
    return audits.inventory_differences(expected, actual, "doc_id", "h")


# Ledgers


@query("SELECT event_type AS status, count(*) AS calls, count(*) FILTER (value >= 1) AS known, round(sum(value) FILTER (value >= 1), 2) AS cost, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS tokens FROM events GROUP BY 1")
def ledger_totals(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("status"), F.when(F.col("value") >= 1, F.col("value")).alias("cost"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    return rows.groupBy("status").agg(F.count("*").alias("calls"), F.count("cost").alias("known"), F.round(F.sum("cost"), 2).alias("cost"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"))


@query("SELECT user_id, round(sum(value) FILTER (event_type = 'purchase'), 2) AS spent, round(sum(value) FILTER (event_type = 'signup'), 2) AS reserved, round(coalesce(sum(value) FILTER (event_type IN ('purchase', 'signup', 'error')), 0), 2) AS committed, coalesce(sum(value) FILTER (event_type IN ('purchase', 'signup', 'error')), 0) > 2000 + 1e-12 AS over_cap FROM events GROUP BY user_id")
def cap_check(spark, sf):
    of = lambda *kinds: F.sum(F.when(F.col("event_type").isin(*kinds), F.col("value")))
    total = F.coalesce(of("purchase", "signup", "error"), F.lit(0.0))
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(of("purchase"), 2).alias("spent"), F.round(of("signup"), 2).alias("reserved"), F.round(total, 2).alias("committed"), (total > 2000 + 1e-12).alias("over_cap"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, max(value) AS largest, round(epoch_ms(max(ts)) / 1000.0 - epoch_ms(min(ts)) / 1000.0, 0) AS elapsed FROM events GROUP BY 1")
def latency_summary(spark, sf):
    seconds = lambda f: (F.floor(F.unix_micros(f("ts").cast("timestamp")) / 1000)) / 1000.0
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.max("value").alias("largest"), F.round(seconds(F.max) - seconds(F.min), 0).alias("elapsed"))


@query("SELECT event_id, CASE WHEN k >= 0 THEN round(((k - least(20, k)) * 0.5 + least(20, k) * 0.1 + 7 * 2.0) / 1e6, 9) END AS cost FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def usage_cost(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select("event_id", F.round(stats.usage_cost(k, F.lit(20), F.lit(7), (0.5, 0.1, 2.0)), 9).alias("cost"))


# Kernels, on the chains' quantities


def _series(spark, sf):
    rows = table(spark, sf, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - 1
    return rows.select(F.col("l_orderkey").alias("case_id"), i.alias("i"), F.col("l_quantity").cast("long").alias("x"))


_SERIES = "series AS (SELECT l_orderkey AS case_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) - 1 AS i, l_quantity::BIGINT AS x FROM lineitem)"
_PREFIX = "p AS (SELECT *, sum(x) OVER (PARTITION BY case_id ORDER BY i) AS p FROM series)"


def kernel(sql: str):
    return query(f"WITH {_SERIES} {sql}")


@kernel(", w AS (SELECT case_id, least(max(x) OVER (PARTITION BY case_id ORDER BY i), max(x) OVER (PARTITION BY case_id ORDER BY i DESC)) - x AS w FROM series) SELECT case_id, sum(w) AS water FROM w GROUP BY 1")
def kernel_trapped_rain(spark, sf):
    return kernels.trapped_rain(_series(spark, sf))


@kernel("SELECT case_id, i, x, dense_rank() OVER (PARTITION BY case_id ORDER BY x) - 1 AS place FROM series")
def kernel_compressed_coordinates(spark, sf):
    return kernels.compressed_coordinates(_series(spark, sf))


@query("SELECT n FROM range(2, 2001) r(n) WHERE NOT EXISTS (SELECT 1 FROM range(2, 45) d(k) WHERE k < n AND n % k = 0) AND n >= 100")
def kernel_primes(spark, sf):
    return kernels.primes(spark, 100, 2000)


@kernel(f", {_PREFIX}, q AS (SELECT case_id, i, p FROM p UNION ALL SELECT DISTINCT case_id, -1, 0 FROM series) SELECT s.case_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT case_id FROM series) s LEFT JOIN (SELECT a.case_id, count(*) AS n FROM q a JOIN q b ON a.case_id = b.case_id AND b.p - a.p = 40 AND a.i < b.i GROUP BY 1) c USING (case_id)")
def kernel_sum_targets(spark, sf):
    return kernels.sum_targets(_series(spark, sf), 40)


@kernel(", w AS (SELECT case_id, x * row_number() OVER (PARTITION BY case_id ORDER BY x DESC, i) AS w FROM series) SELECT case_id, max(w) AS load FROM w GROUP BY 1")
def kernel_rope_load(spark, sf):
    return kernels.rope_load(_series(spark, sf))


def _customer_links(spark, sf, factor, shift):
    """An edge from each customer to another, over the whole table."""
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("a"))
    n = customers.agg((F.max("a") + 1).alias("n"))
    return customers.crossJoin(F.broadcast(n)).select("a", ((F.col("a") * factor + shift) % F.col("n")).alias("b"))


_LINKS = "e AS (SELECT c_custkey AS a, (c_custkey * {factor} + {shift}) % (SELECT max(c_custkey) + 1 FROM customer) AS b FROM customer)"


@query(f"WITH {_LINKS.format(factor=7, shift=3)}, s AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) WHERE a <> b), f AS (SELECT a, b FROM s UNION SELECT x.a, y.b FROM s x JOIN s y ON x.b = y.a WHERE x.a <> y.b) SELECT a, count(*) AS n FROM f GROUP BY a")
def kernel_two_hop_friends_whole(spark, sf):
    return kernels.two_hop_friends(_customer_links(spark, sf, 7, 3))


@kernel(", p AS (SELECT a.case_id, a.i AS i, b.i AS j FROM series a JOIN series b ON a.case_id = b.case_id AND a.x + b.x = 50 AND a.i < b.i), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY i, j) AS k FROM p) SELECT case_id, i, j FROM r WHERE k = 1")
def kernel_two_sum(spark, sf):
    return kernels.two_sum(_series(spark, sf), F.lit(50))


@kernel(", g AS (SELECT case_id, x - min(x) OVER (PARTITION BY case_id ORDER BY i) AS g FROM series) SELECT case_id, max(g) AS profit FROM g GROUP BY 1")
def kernel_best_trade(spark, sf):
    return kernels.best_trade(_series(spark, sf))


@kernel("SELECT case_id, count(x) > count(DISTINCT x) AS duplicate FROM series GROUP BY 1")
def kernel_has_duplicate(spark, sf):
    return kernels.has_duplicate(_series(spark, sf))


@kernel(", d AS (SELECT case_id, i, x - 25 AS x FROM series), p AS (SELECT *, sum(x) OVER (PARTITION BY case_id ORDER BY i) AS p FROM d), m AS (SELECT case_id, p - least(0, coalesce(min(p) OVER (PARTITION BY case_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS s FROM p) SELECT case_id, max(s) AS largest FROM m GROUP BY 1")
def kernel_largest_subarray(spark, sf):
    return kernels.largest_subarray(_series(spark, sf).withColumn("x", F.col("x") - 25))


@kernel("SELECT case_id, count(*) FILTER (x < 25) AS position FROM series GROUP BY 1")
def kernel_insert_position(spark, sf):
    return kernels.insert_position(_series(spark, sf), F.lit(25))


@kernel(", o AS (SELECT case_id, x, count(*) AS n, min(i) AS i FROM series GROUP BY ALL) SELECT case_id, min(i) FILTER (n = 1) AS i FROM o GROUP BY 1")
def kernel_first_unique(spark, sf):
    return kernels.first_unique(_series(spark, sf))


@kernel(", l AS (SELECT case_id, i, coalesce(lag(i) OVER (PARTITION BY case_id, x ORDER BY i), -1) AS b FROM series), m AS (SELECT case_id, i - max(b) OVER (PARTITION BY case_id ORDER BY i) AS n FROM l) SELECT case_id, max(n) AS longest FROM m GROUP BY 1")
def kernel_longest_distinct(spark, sf):
    return kernels.longest_distinct(_series(spark, sf))


@kernel(", n AS (SELECT a.case_id, a.i, min(b.i) AS j FROM series a LEFT JOIN series b ON a.case_id = b.case_id AND b.i > a.i AND b.x > a.x GROUP BY ALL) SELECT n.case_id, n.i, j - n.i AS distance, s.x::DOUBLE AS value FROM n LEFT JOIN series s ON s.case_id = n.case_id AND s.i = j")
def kernel_next_greater(spark, sf):
    return kernels.next_greater(_series(spark, sf))


@query("SELECT c_custkey, bit_count(c_custkey) AS bits, gcd(c_custkey + 1, c_nationkey + 12) AS gcd, lcm(c_custkey + 1, c_nationkey + 12) AS lcm, reverse(CAST(c_custkey AS VARCHAR)) = CAST(c_custkey AS VARCHAR) AS palindrome FROM customer")
def kernel_numbers(spark, sf):
    both = kernels.gcd_lcm(F.col("c_custkey") + 1, F.col("c_nationkey") + 12)
    return table(spark, sf, "customer").withColumn("b", both).select("c_custkey", kernels.bit_counts(F.col("c_custkey")).alias("bits"), "b.gcd", "b.lcm", kernels.palindrome(F.col("c_custkey").cast("string")).alias("palindrome"))


@query("SELECT id AS n FROM range(100000) r(id) WHERE CAST(id AS VARCHAR) LIKE '%666%' ORDER BY id LIMIT 1 OFFSET 49")
def kernel_nth_with_666(spark, sf):
    return kernels.nth_with(spark, "666", 50, 100_000)


@query("SELECT 92::BIGINT AS n")
def kernel_queens(spark, sf):
    return kernels.queens(spark, 8)


# Every node has one link onwards, so following links ends on a cycle; jumps of 2, 4, 8, ... links carry the least node passed.
_JUMPS = 26
_CYCLES = "j0 AS (SELECT n.x, coalesce(e.b, n.x) AS t, least(n.x, coalesce(e.b, n.x)) AS m FROM (SELECT a AS x FROM e UNION SELECT b FROM e) n LEFT JOIN e ON e.a = n.x), " + ", ".join(
    f"j{k} AS MATERIALIZED (SELECT p.x, q.t, least(p.m, q.m) AS m FROM j{k - 1} p JOIN j{k - 1} q ON q.x = p.t)" for k in range(1, _JUMPS + 1)
)


@query(f"WITH {_LINKS.format(factor=5, shift=2)}, {_CYCLES}, c AS (SELECT p.x, q.m AS cycle FROM j{_JUMPS} p JOIN j{_JUMPS} q ON q.x = p.t) SELECT x AS node, min(x) OVER (PARTITION BY cycle) AS label FROM c")
def kernel_components_whole(spark, sf):
    edges = _customer_links(spark, sf, 5, 2)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    return kernels.connected_components(edges, nodes)


# Rules and small operators, on columns of the synthetic tables

_STATUSES = ("success", "format_error", "compile_error", "wrong_answer", "timeout", "max_distance_reached", "translation_budget_reached", "collection_complete", "infrastructure_error", "api_error", "parse_error", "oscillation", "max_iter_no_convergence", "confirmation_failed", "runtime_error")


@query(
    f"""WITH s AS (SELECT list_extract([{", ".join(f"'{s}'" for s in _STATUSES)}], (o_orderkey % {len(_STATUSES)})::INT + 1) AS status, o_orderkey % 4 = 0 AS missing FROM orders)
    SELECT status, CASE WHEN status IN ('format_error', 'compile_error', 'wrong_answer', 'timeout', 'runtime_error') THEN 'functional_failure' WHEN status = 'max_distance_reached' THEN 'fps_limit' WHEN status = 'translation_budget_reached' THEN 'budget' WHEN status = 'collection_complete' THEN 'collection_complete' ELSE 'invalid' END AS fps,
    CASE WHEN status = 'api_error' OR missing THEN 'infrastructure' WHEN status IN ('success', 'oscillation', 'confirmation_failed') THEN status WHEN status = 'parse_error' THEN 'format_error' WHEN status = 'max_iter_no_convergence' THEN 'max_iterations' ELSE 'functionality_error' END AS paper,
    status IN ('api_error', 'parse_error', 'compile_error', 'runtime_error', 'timeout') AS infrastructure, count(*) AS n FROM s GROUP BY ALL"""
)
def category_maps(spark, sf):
    at = F.col("o_orderkey") % len(_STATUSES)
    rows = table(spark, sf, "orders").select(F.element_at(F.array(*map(F.lit, _STATUSES)), (at + 1).cast("int")).alias("status"), (F.col("o_orderkey") % 4 == 0).alias("missing"))
    maps = (stats.fps_category(F.col("status")).alias("fps"), stats.paper_category(F.col("status"), F.col("missing")).alias("paper"), stats.report_infrastructure(F.col("status")).alias("infrastructure"))
    return rows.groupBy("status", *maps).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, regexp_full_match(p_name, '[A-Za-z0-9][A-Za-z0-9_.-]{0,99}') AS valid, contains(lower(p_name), lower(p_brand)) OR contains(lower(p_brand), lower(p_name)) AS loose, p_name = p_brand OR p_brand = split_part(p_name, ' ', 1) AS exact FROM part")
def identifiers_and_models(spark, sf):
    name, brand = F.col("p_name"), F.col("p_brand")
    return table(spark, sf, "part").select("p_partkey", stats.valid_identifier(name).alias("valid"), stats.model_matches(name, brand, False).alias("loose"), stats.model_matches(name, brand, True, F.array(F.split(name, " ")[0])).alias("exact"))


@query("SELECT event_id, round(CASE WHEN user_id % 3 = 0 THEN value ELSE (k * 0.5 + 7 * 2.0) / 1e6 END, 9) AS most, CASE WHEN k % 5 = 0 THEN k::DOUBLE ELSE least(2.0 ** (event_id % 6), 8.0) END AS delay, (floor(value::DECIMAL(20,9) * 100) / 100)::DOUBLE AS cents FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def cost_rules(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    bound = F.when(F.col("user_id") % 3 == 0, F.col("value"))
    return table(spark, sf, "events").select("event_id", F.round(stats.maximum_cost(bound, k, F.lit(7), (0.5, 0.1, 2.0)), 9).alias("most"), stats.retry_delay(F.col("event_id") % 6, F.when(k % 5 == 0, k)).alias("delay"), stats.floor_cents(F.col("value")).cast("double").alias("cents"))


@query("WITH t AS (SELECT conv_id || '-' || turn AS pair_id, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a, text AS b FROM conversations) SELECT pair_id, CASE WHEN replace(replace(a, chr(13) || chr(10), chr(10)), chr(13), chr(10)) = replace(replace(b, chr(13) || chr(10), chr(10)), chr(13), chr(10)) THEN 1.0 ELSE 0.0 END::DOUBLE AS same, strlen(b) - strlen(a) AS delta FROM t WHERE a IS NOT NULL AND b IS NOT NULL")
def source_changes(spark, sf):
    a, b = F.col("before"), F.col("text")
    return _turns(spark, sf).filter("text is not null").select("pair_id", text.source_identity(a, b).alias("same"), text.byte_delta(a, b).alias("delta"))


_MUTATED = {"whitespace": "replace(props, ' ', '  ')", "comment": "'// note' || chr(10) || props", "identifier": r"regexp_replace(props, '\b([a-z_])\b', '\1_renamed', 'g')", "operator": "replace(props, '+', '-')", "line_drop": r"regexp_replace(props, '\A[^\n]*\n', '')"}


@query(" UNION ALL ".join(f"SELECT event_type, '{name}' AS name, count(*) FILTER ({sql} <> props) AS changed, sum(length({sql})) AS characters FROM events GROUP BY event_type" for name, sql in _MUTATED.items()))
def payload_mutations(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "props", F.explode(text.mutations(F.col("props"))).alias("m"))
    return rows.groupBy("event_type", F.col("m.name").alias("name")).agg(F.count_if(F.col("m.source") != F.col("props")).alias("changed"), F.sum(F.length("m.source")).alias("characters"))


@query(f"WITH {STEPS_SQL}, r AS (SELECT route, step, sum(CASE WHEN restored AND functional THEN 1 ELSE 0 END) OVER (PARTITION BY trial ORDER BY step) AS n FROM steps) SELECT route, step, count(*) AS chains, sum(n) AS round_trips, max(n) AS most FROM r GROUP BY ALL")
def round_trips(spark, sf):
    found = chains.completed_round_trips(step_view(spark, sf))
    return found.groupBy("route", "step").agg(F.count("*").alias("chains"), F.sum("round_trips").alias("round_trips"), F.max("round_trips").alias("most"))


@query("SELECT o_custkey AS customer, min(o_orderkey) AS attempt FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def first_evaluable_attempt(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("attempt"), "o_orderstatus")
    return chains.first_evaluable(rows, ["customer"], F.col("o_orderstatus") != "P").select("customer", "attempt")


@query("SELECT o_custkey AS customer, coalesce(min(o_orderkey) FILTER (o_orderstatus = 'F'), max(o_orderkey)) AS attempt FROM orders GROUP BY 1")
def selected_attempt(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("attempt"), (F.col("o_orderstatus") == "F").alias("finished"))
    return chains.selected_trials(rows, ["customer"]).select("customer", "attempt")


@query(
    """WITH e AS (SELECT event_id // 4 AS call_id, event_id AS seq, list_extract(['reserved', 'inflight', 'completed', 'failed', 'unknown', 'reserved', 'inflight'], (event_id % 7)::INT + 1) AS kind, value AS amount FROM events),
    t AS (SELECT call_id, min(seq) FILTER (kind IN ('completed', 'failed', 'unknown')) AS ended FROM e GROUP BY call_id),
    k AS (SELECT e.* FROM e JOIN t ON e.call_id = t.call_id AND (t.ended IS NULL OR e.seq <= t.ended)),
    a AS (SELECT call_id, arg_max(kind, seq) AS status, arg_max(amount, seq) AS last, coalesce(arg_max(amount, seq) FILTER (kind = 'reserved'), 0) AS held FROM k GROUP BY call_id)
    SELECT call_id, status, CASE WHEN status = 'completed' THEN last END AS cost, CASE WHEN status IN ('reserved', 'inflight') THEN held ELSE 0 END::DOUBLE AS reserved, CASE WHEN status = 'unknown' THEN held ELSE 0 END::DOUBLE AS uncertain FROM a"""
)
def ledger_fold(spark, sf):
    kinds = F.array(*map(F.lit, ("reserved", "inflight", "completed", "failed", "unknown", "reserved", "inflight")))
    rows = table(spark, sf, "events").select(F.floor(F.col("event_id") / 4).alias("call_id"), F.col("event_id").alias("seq"), F.element_at(kinds, (F.col("event_id") % 7 + 1).cast("int")).alias("kind"), F.col("value").alias("amount"))
    return folds.ledger_state(rows)


@query(f"WITH {STEPS_SQL}, s AS (SELECT trial, phase, CASE WHEN trial % 37 = 0 AND step = 1 THEN -1.0 ELSE transports * 60.0 END AS seconds FROM steps) SELECT trial, CASE WHEN bool_or(seconds < 0) THEN 'clock_regression' WHEN coalesce(sum(seconds) FILTER (phase = 'discovery'), 0) > 600 THEN 'discovery_deadline' WHEN coalesce(sum(seconds) FILTER (phase = 'confirmation'), 0) > 150 THEN 'confirmation_deadline' ELSE 'ok' END AS status FROM s GROUP BY trial")
def deadline_status(spark, sf):
    seconds = F.when((F.col("trial") % 37 == 0) & (F.col("step") == 1), -1.0).otherwise(F.col("transports") * 60.0)
    return folds.deadlines(step_view(spark, sf).withColumn("seconds", seconds), 600, 150)


@query("WITH q AS (SELECT CAST(n_nationkey AS VARCHAR) AS query, n_name AS answer FROM nation UNION ALL SELECT n_name, CAST(n_nationkey AS VARCHAR) FROM nation) SELECT * FROM q")
def kernel_dictionary(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("number"), F.col("n_name").alias("name"))
    asked = nations.select(F.col("number").cast("string").alias("query")).union(nations.select("name"))
    return kernels.dictionary_lookup(nations, asked)


@query("WITH s AS (SELECT c_custkey, replace(replace(bin(c_custkey), '1', '('), '0', ')') AS s FROM customer WHERE c_custkey > 0), c AS (SELECT c_custkey, unnest(range(1, length(s) + 1)) AS i, s FROM s), d AS (SELECT c_custkey, i, sum(CASE WHEN s[i] = '(' THEN 1 ELSE -1 END) OVER (PARTITION BY c_custkey ORDER BY i) AS d, length(s) AS n FROM c) SELECT c_custkey, min(d) >= 0 AND min(d) FILTER (i = n) = 0 AS balanced FROM d GROUP BY c_custkey")
def kernel_balanced(spark, sf):
    rows = table(spark, sf, "customer").filter("c_custkey > 0")
    return rows.select("c_custkey", kernels.balanced(F.translate(F.bin("c_custkey"), "10", "()")).alias("balanced"))


@query("SELECT c_custkey, list_sort(string_split(CAST(c_custkey AS VARCHAR), '')) = list_sort(string_split(CAST(c_custkey * 10 // 7 AS VARCHAR), '')) AS anagram FROM customer")
def kernel_anagram(spark, sf):
    other = F.floor(F.col("c_custkey") * 10 / 7).cast("string")
    return table(spark, sf, "customer").select("c_custkey", kernels.anagram(F.col("c_custkey").cast("string"), other).alias("anagram"))


@kernel(", v AS (SELECT case_id, list(x % 4 ORDER BY i) AS v FROM series GROUP BY 1) SELECT case_id, array_to_string(list_concat(list_filter(v, lambda y: y <> 0), list_filter(v, lambda y: y = 0)), ',') AS moved FROM v")
def kernel_moved_zeroes(spark, sf):
    values = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"] % 4)
    rows = _series(spark, sf).groupBy("case_id").agg(values.alias("v"))
    return rows.select("case_id", F.concat_ws(",", kernels.moved_zeroes(F.col("v")).cast("array<string>")).alias("moved"))


@query("SELECT c_custkey, (factorial((r + c - 2)::INT) / (factorial((r - 1)::INT) * factorial((c - 1)::INT)))::BIGINT AS paths FROM (SELECT c_custkey, c_nationkey % 9 + 1 AS r, c_custkey % 9 + 1 AS c FROM customer)")
def kernel_unique_paths(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", kernels.unique_paths(F.col("c_nationkey") % 9 + 1, F.col("c_custkey") % 9 + 1).alias("paths"))


@query("SELECT n_nationkey, count(*) AS ways FROM nation, range(0, 26) b(two), range(0, 18) c(more) WHERE 2 * two + (3 + n_nationkey) * more <= 50 GROUP BY n_nationkey")
def kernel_change_ways(spark, sf):
    coins = F.array(F.lit(1).cast("long"), F.lit(2).cast("long"), F.col("n_nationkey").cast("long") + 3)
    return table(spark, sf, "nation").select("n_nationkey", kernels.change_ways(coins, 50).cast("long").alias("ways"))


@query(
    """WITH RECURSIVE h AS (SELECT 10 AS disc, 0 AS source, 2 AS target, 1 AS rest, 512 AS move UNION ALL
    SELECT disc - 1, CASE WHEN side = 0 THEN source ELSE rest END, CASE WHEN side = 0 THEN rest ELSE target END, CASE WHEN side = 0 THEN target ELSE source END, move + (2 * side - 1) * (1 << (disc - 2)) FROM h, (VALUES (0), (1)) s(side) WHERE disc > 1)
    SELECT move, disc, source, target FROM h"""
)
def kernel_hanoi(spark, sf):
    return kernels.hanoi(10, spark)


@query("SELECT c_custkey, regexp_full_match(CAST(c_custkey AS VARCHAR), '(1|23|4|56|78|90|35|7)*') AS breaks FROM customer")
def kernel_word_break(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", kernels.word_break(F.col("c_custkey").cast("string"), ["1", "23", "4", "56", "78", "90", "35", "7"]).alias("breaks"))


@query(
    """WITH l AS (SELECT lang, trim(unnest(string_split(text, chr(10))), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM documents)
    SELECT lang, count(*) AS lines, count(*) FILTER (regexp_matches(line, '^(#include|import |from |def |class |public |private |protected |int |long |double |float |for |while |if |else|return)') OR regexp_matches(line, '[;{}()=]|->|::')) AS code FROM l GROUP BY lang"""
)
def code_lines(spark, sf):
    lines = table(spark, sf, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("lang").agg(F.count("*").alias("lines"), F.count_if(text.is_code_line(F.col("line"))).alias("code"))


@query(f"WITH {OUTCOMES_SQL}, c AS (SELECT route, problem, count(*) FILTER (problem <> 0 AND category <> 'hop_limit') AS valid, count(*) FILTER (problem <> 0 AND category = 'success') AS hits FROM outcomes GROUP BY route, problem) SELECT route, problem, valid, hits, CASE WHEN valid > 0 THEN round(greatest(0.0, {_W} - {_WH}), 6) END AS low, CASE WHEN valid > 0 THEN round(least(1.0, {_W} + {_WH}), 6) END AS high, CASE WHEN valid > 0 THEN round({_W} - {_WH}, 6) END AS free_low, CASE WHEN valid > 0 THEN round({_W} + {_WH}, 6) END AS free_high FROM c")
def wilson_without_trials(spark, sf):
    """Some groups have no valid outcome; their bounds are null."""
    seen = outcome_view(spark, sf).withColumn("category", F.when((F.col("problem") == 0) | (F.col("category") == "hop_limit"), "invalid").otherwise(F.col("category")))
    return outcomes.with_wilson(seen, "route", "problem")


from rondel import record_queries  # noqa: E402, F401  registers its queries here
