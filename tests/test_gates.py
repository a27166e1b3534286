"""Gates on small tables."""

import pytest

from rondel.operators import gates


def test_corpus_faults(spark):
    rows = [("good", "evaluation", "1 2", "x"), ("good", "evaluation", "3", "x"), ("good", "prompt_examples", "4", "x")]
    rows += [("bad", "evaluation", "1  2\n", "x"), ("bad", "evaluation", "1 2", "x"), ("bad", "evaluation", "5", None), ("bad", "prompt_examples", "5 ", "y"), ("none", "prompt_examples", "1", "x")]
    cases = spark.createDataFrame(rows, "problem string, role string, input string, expected string")
    got = sorted(tuple(r) for r in gates.corpus_faults(cases, 2).collect())
    assert got == [("bad", "evaluation_count", 3), ("bad", "missing_side", 1), ("bad", "public_input", 1), ("bad", "repeated_input", 1), ("none", "evaluation_count", 0)]
    assert gates.corpus_faults(cases.limit(0), 2).count() == 0


def test_reference_faults(spark):
    cases = spark.createDataFrame([("p", 1), ("p", 2)], "problem string, case int")
    made = spark.createDataFrame([("p", "c"), ("p", "java")], "problem string, language string")
    results = [("p", "c", 1, "success"), ("p", "c", 2, "timeout"), ("p", "java", 1, "success"), ("p", "java", 1, "success"), ("q", "c", 1, "success"), ("p", "java", 2, None)]
    got = sorted(tuple(r) for r in gates.reference_faults(spark.createDataFrame(results, "problem string, language string, case int, status string"), made, cases).collect())
    assert got == [("p", "c", 2, "not_passed"), ("p", "java", 1, "repeated"), ("p", "java", 2, "not_passed"), ("q", "c", 1, "unplanned")]
    few = spark.createDataFrame(results[:2], "problem string, language string, case int, status string")
    assert {r.fault for r in gates.reference_faults(few, made, cases).collect()} == {"not_passed", "not_run"}


def test_gate(spark):
    facts = spark.createDataFrame([(5, 10.0, None)], "observed int, cost double, models string")
    assert tuple(gates.gate(facts, {"complete": "observed = 5", "budget": "cost <= 30"}).first()) == (True, [])
    assert tuple(gates.gate(facts, {"complete": "observed = 6", "budget": "cost <= 30", "model": "models = 'm'"}).first()) == (False, ["complete", "model"])


def test_reported_differences(spark):
    rows = spark.createDataFrame([("a", "success", 2), ("a", "success", 4), ("a", "hop_limit", None), ("a", "invalid", None), ("b", "invalid", None)], "route string, category string, reached_step int")
    kind = "route string, hits int, valid int, planned int, P double, H double, D double"
    right = [("a", 2, 3, 4, 2 / 3, 3.0, 4.5), ("b", 0, 0, 1, None, None, None)]
    assert gates.reported_differences(spark.createDataFrame(right, kind), rows).count() == 0
    wrong = [("a", 2, 4, 4, 2 / 3, 3.0, 4.5000001), ("b", 0, 0, 1, 0.0, None, None), ("c", 1, 1, 1, 1.0, 2.0, 2.0)]
    got = {(r.route, r.field) for r in gates.reported_differences(spark.createDataFrame(wrong, kind), rows).collect()}
    assert got == {("a", "valid"), ("a", "D"), ("b", "P"), *(("c", f) for f in ("hits", "valid", "planned", "P", "H", "D"))}


def test_ledgers_exclusions_and_subsets(spark):
    rows = [("m", 1, None, None, 5, None), ("m", 2, 0.5, "reported", None, 3), ("m", 3, 0.25, "estimated", 1, 1), ("m", 1, 0.25, "provider_estimated", 1, 1), ("n", None, 0.1, "estimated", None, None)]
    df = spark.createDataFrame(rows, "model string, attempts int, cost_usd double, cost_source string, prompt_tokens int, completion_tokens int")
    got = {r.model: tuple(r)[1:] for r in gates.ledger_split(df, "model").collect()}
    assert got == {"m": (4, 7, 1, 0.5, 0.5, 7, 5), "n": (1, 0, 0, 0.1, None, 0, 0)}
    outcomes = spark.createDataFrame([("r", "success", None, "timeout"), ("r", "success", None, None), ("r", "success", 1.0, None), ("r", "budget", None, "x")], "route string, category string, x double, why string")
    assert {r.reason: r.n for r in gates.exclusions(outcomes, "x", "why", "route").collect()} == {"timeout": 1, "not_processed": 1}
    parts = gates.subsets(outcomes, {"all": "true", "measured": "x is not null", "none": "false"}).groupBy("subset").count().collect()
    assert {r.subset: r["count"] for r in parts} == {"all": 4, "measured": 1}


def test_described(spark):
    values = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 2.0), ("c", None)], "route string, x double")
    draws = [("a", float(i)) for i in range(96)] + [("a", None)] * 4 + [("b", 2.0)] * 100 + [("c", 1.0)] * 94
    got = {r.route: r for r in gates.described(values, spark.createDataFrame(draws, "route string, median double"), "x", ["route"], 100).collect()}
    assert (got["a"].n, got["a"].median, got["a"].min, got["a"].max, got["a"].ci_status, got["a"].valid_resamples) == (2, 2.0, 1.0, 3.0, "measured", 96)
    assert got["a"].low == pytest.approx(95 * 0.025) and (got["b"].ci_status, got["b"].low) == ("degenerate", 2.0) and (got["c"].ci_status, got["c"].low, got["c"].median) == ("unavailable", None, None)


def test_side_by_side(spark):
    rows = spark.createDataFrame([("a", "x", 1, 2), ("a", "y", 3, 4), ("b", "x", 5, 6)], "k string, side string, n int, m int")
    assert tuple(gates.side_by_side(rows.filter("k = 'a'"), "k", "side", ["x", "y"], ["n", "m"]).first()) == ("a", 1, 2, 3, 4)
    assert {r.k: r.n_y for r in gates.side_by_side(rows, "k", "side", ["x", "y"], ["n"], required=False).collect()} == {"a": 3, "b": None}
    with pytest.raises(Exception, match="no row of a side for b"):
        gates.side_by_side(rows, "k", "side", ["x", "y"], ["n"]).collect()


def test_totals_of_routes(spark):
    from rondel.operators import outcomes

    rows = [("p", "r", "success", 3, 1, 4, None), ("p", "r", "budget", None, None, 6, 0.5), ("p", "r", "invalid", None, 2, None, None), ("q", "r", "invalid", None, 0, 1, None), ("q", "s", "budget", None, 0, 2, None)]
    df = spark.createDataFrame(rows, "problem string, route string, category string, d_n int, duplicate_steps int, translation_steps int, cost_usd double")
    got = {r.route: r for r in outcomes.fps_totals(df, 10).collect()}
    r = got["r"]
    assert (r.planned, r.recorded, r.incomplete, r.valid, r.success, r.invalid, r.p_sf, r.p_sf_problems, r.p_sf_pooled, r.d_n_problems, r.duplicate_steps, r.translation_steps, r.cost_usd) == (10, 4, 6, 2, 1, 2, 0.5, 1, 0.5, 1, 3, 11, 0.5)
    assert (round(r.wilson_low, 4), round(r.wilson_high, 4)) == (0.0945, 0.9055) and got["s"].cost_usd is None
    kinds = spark.createDataFrame([("success", 0, "max_distance_reached", "success"), ("budget", 0, "translation_budget_reached", "invalid"), ("budget", 1, "translation_budget_reached", "budget"), ("budget", 0, "timeout", "budget"), ("incomplete", 0, None, "incomplete")], "c string, m int, t string, want string")
    from pyspark.sql import functions as F

    assert kinds.filter(outcomes.downgraded(F.col("c"), F.col("m"), F.col("t")) != F.col("want")).count() == 0


def test_measurement_faults(spark):
    raw = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("c", 3.0), ("e", None)], "pair string, value double")
    measured = spark.createDataFrame([("a", 1.0), ("b", 2.5), ("c", 3.0), ("d", 1.0), ("e", None)], "pair string, value double")
    assert sorted((r.pair, r.fault) for r in gates.measurement_faults(raw, measured, ["pair"]).collect()) == [("b", "other_value"), ("c", "repeated"), ("d", "no_raw_output")]


def test_lookups(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "i int, k string")
    table = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z"), (None, "n")], "k string, v string")
    assert sorted((r.i, r.v, r.found) for r in gates.looked_up(rows, table, ["k"]).collect()) == [(1, "x", "one"), (2, None, "several"), (3, None, "none"), (4, None, "none")]
    with pytest.raises(Exception, match="none for c"):
        gates.looked_up(rows.filter("i = 3"), table, ["k"], "fail").collect()
