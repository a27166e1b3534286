"""Diagnostics and labels on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from rondel.functions import labels
from rondel.operators import diagnostics

CHECKED = "trial string, step int, status string, compile_status string, functionality_status string, functionality_passed boolean, execution_status string"


def test_semantic_preservation(spark):
    good, bad, none = ("completed", "passed", "passed", True, None), ("completed_with_functionality_failure", "passed", "failed", False, "wrong_answer"), ("open", "not_evaluated", "", None, None)
    chains = {
        "pass": [good, good], "degraded": [bad, good], "fail": [good, bad], "both": [bad, bad], "none": [none, none], "unfinished": [good, none], "compile": [("evaluation_failed", "failed", "not_run", False, "")],
        "last": [("odd", "passed", "", False, None)], "one": [good],
    }
    rows = [(t, i + 1, *s) for t, steps in chains.items() for i, s in enumerate(steps)]
    got = {r.trial: tuple(r)[1:] for r in diagnostics.semantic_preservation(spark.createDataFrame(rows, CHECKED)).collect()}
    assert got == {
        "pass": ("pass", True, False, None), "degraded": ("degraded", True, True, "route_degraded"), "fail": ("fail", False, False, "wrong_answer"), "both": ("fail", False, True, "wrong_answer"), "none": ("not_evaluated", False, False, "no_evaluation_results"),
        "unfinished": ("fail", False, False, "route_incomplete"), "compile": ("fail", False, False, "compile_failed"), "last": ("fail", False, False, "odd"), "one": ("pass", True, False, None),
    }


def test_counts_of_checks_translations_and_cycles(spark):
    rows = [("a", "passed", "passed"), ("a", "failed", ""), ("a", "passed", None), ("a", "odd", "failed")]
    got = {(r.check, r.status): r.n for r in diagnostics.check_counts(spark.createDataFrame(rows, "k string, compile_status string, functionality_status string"), "k").collect()}
    assert got == {("compile", "passed"): 2, ("compile", "failed"): 1, ("compile", "skipped"): 0, ("compile", "not_evaluated"): 0, ("compile", "odd"): 1, ("functionality", "passed"): 1, ("functionality", "failed"): 1, ("functionality", "not_run"): 0, ("functionality", "not_evaluated"): 0}
    steps = spark.createDataFrame([(1, "completed"), (1, "completed_with_functionality_failure"), (1, "evaluation_failed"), (1, None)], "trial int, status string")
    assert tuple(diagnostics.translation_counts(steps, "trial").first()) == (1, 4, 2, 2)
    sources = spark.createDataFrame([(1, "x"), (1, " \n\t"), (1, None), (2, "")], "trial int, source string")
    assert {r.trial: r.cycles for r in diagnostics.completed_cycles(sources).collect()} == {1: 1, 2: 0}


def test_convergence_and_continuation(spark):
    chains = {
        "fixed": ["s", "a", "a", "b"], "two": ["s", "a", "s", "a", "x"], "cap": ["s", "a", "b", "c", "d"], "early": ["s", "a"], "broken": ["s", "a", None, "a"], "same": ["s", "s"],
    }
    rows = [(t, i, h, "timeout" if h is None else None) for t, hashes in chains.items() for i, h in enumerate(hashes)]
    got = {}
    for r in diagnostics.convergence(spark.createDataFrame(rows, "trial string, iteration int, hash string, failure string"), 4).orderBy("iteration").collect():
        got.setdefault(r.trial, []).append((r.convergence, r.status))
    on = ("continue", "success")
    assert got == {
        "fixed": [on, ("fixed_point", "success")], "two": [on, on, ("oscillation", "oscillation")], "cap": [on, on, on, ("continue", "max_iter_no_convergence")], "early": [on], "broken": [on, (None, "timeout")], "same": [("fixed_point", "success")],
    }
    cases = [("success", True, "cpp", True), ("wrong_answer", True, "c", True), ("wrong_answer", True, "cpp", False), ("timeout", False, "c", False), ("compile_error", True, "c", False), ("runtime_error", None, "c", False)]
    df = spark.createDataFrame(cases, "status string, compiled boolean, target string, want boolean")
    assert df.filter(diagnostics.continues(F.col("status"), F.col("compiled"), F.col("target")) != F.col("want")).count() == 0


def test_where_and_why_chains_stop(spark):
    rows = [("r", "format_error", "c", 1), ("r", "wrong_answer", "cpp", 2), ("r", "timeout", "c", 7), ("r", "collection_complete", "cpp", 8), ("r", "timeout", "c", 5)]
    got = {r.position: r.n for r in diagnostics.stop_positions(spark.createDataFrame(rows, "route string, status string, language string, step int")).collect()}
    assert got == {"intermediate@1": 1, "restored@2": 1, "intermediate@3+": 2}
    texts = spark.createDataFrame([("```\na\n```\n```c\nb\n\n```",), (" \n",), (None,), ("```\na\n```",), ("x",)], "response string")
    assert [r[0] for r in texts.select(diagnostics.extraction_cause(F.col("response"))).collect()] == ["multiple_fenced_blocks", "empty", "empty", "other", "other"]
    assert [tuple(r)[1:] for r in diagnostics.last_blocks(texts).collect()] == [(2, "b")]
    assert tuple(diagnostics.block_statuses(spark.createDataFrame([("c", "success")] * 2, "language string, status string")).first()) == ("c", "success", 2)


def test_similarities_of_chains(spark):
    steps = spark.createDataFrame([(1, "r", 2, None), (1, "r", 4, 0.5), (1, "r", 6, 0.9), (2, "r", 2, 0.0), (3, "r", 2, None)], "trial int, route string, step int, similarity double")
    assert sorted(tuple(r) for r in diagnostics.first_and_most(steps).collect() if r.first is not None) == [(1, "r", 0.5, 0.9), (2, "r", 0.0, 0.0)]
    r = diagnostics.similarity_profile(steps).first()
    assert (r.n, r.median, r.share_zero, r.share_high, r.chains, r.first_median, r.most_median) == (3, 0.5, 0.333333, 0.333333, 2, 0.25, 0.45)
    outcomes = spark.createDataFrame([("r", "success", 1.0), ("r", "success", 0.9), ("r", "budget", 1.0)], "route string, category string, similarity double")
    assert tuple(diagnostics.exact_repeats(outcomes).first()) == ("r", 2, 1)


def test_projection_and_analyzer(spark):
    pilot = spark.createDataFrame([("p", 1.0), ("p", 2.0), ("q", 3.0)], "problem string, cost double")
    assert tuple(diagnostics.pilot_projection(pilot, 15, 50.0).first()) == (2, 6.0, 45.0, True)
    assert diagnostics.pilot_projection(pilot.union(spark.createDataFrame([("z", None)], "problem string, cost double")), 15, 50.0).first().projected is None
    assert diagnostics.pilot_projection(pilot.limit(0), 15, 50.0).first().within is None
    rows = [("identical", "c", 1.0), ("identical", "java", 0.5), ("short", "c", None), ("short", "java", 0.1), ("comment", "c", None), ("comment", "java", 0.4)]
    measured = spark.createDataFrame(rows, "variant string, language string, value double")
    got = {(r.variant, r.language): (r.n, r.measured, r.na, r.spread) for r in diagnostics.analyzer_check(measured).collect()}
    assert got[("identical", "c")] == (1, 1, 0, 0.5) and got[("comment", "c")] == (1, 0, 1, None)
    assert {r.fault: r.n for r in diagnostics.analyzer_faults(measured).collect()} == {"identical_is_not_one": 1, "real_code_not_measured": 1, "short_was_measured": 1}


def test_top_words_and_values(spark):
    sources = spark.createDataFrame([(1, "int bb aa aa bb x x x x"), (2, "x 1"), (3, None)], "k int, source string")
    assert [tuple(r) for r in diagnostics.top_word(sources, "k", keywords=("int",)).collect()] == [(1, "bb", 2)]
    models = spark.createDataFrame([("c", "m2"), ("c", "m1"), ("c", "m2"), ("c", None)], "k string, model string")
    assert diagnostics.distinct_values(models, ["k"], "model").first()["values"] == ["m1", "m2"]


def test_labels(spark):
    names = spark.createDataFrame([("cpp-via-java",), ("cpp->c->cpp",), ("cpp-to-c",), ("a->b->c",), ("x",), (None,)], "n string")
    got = [r.p and tuple(r.p) for r in names.select(labels.route_pair(F.col("n")).alias("p")).collect()]
    assert got == [("cpp", "java"), ("cpp", "c"), ("cpp", "c"), None, None, None]
    one = spark.createDataFrame([("cpp", "c", None)], "a string, b string, n string")
    for form in labels.ROUTE_FORMS:
        assert tuple(one.select(labels.route_pair(labels.route_name(F.col("a"), F.col("b"), form)).alias("p")).first().p) == ("cpp", "c")
    assert one.select(labels.call_id(F.col("a"), F.lit(3), F.col("b"))).first()[0] == "cpp/3/c" and one.select(labels.call_id(F.col("a"), F.col("n"))).first()[0] is None
    assert one.select(labels.overlaid(F.col("n"), F.col("b"))).first()[0] == "c"
    assert one.select(labels.annotation(F.col("b"), "c").alias("x")).first().x.recursive == "unconfirmed" and one.select(labels.annotation(F.col("a"), "c").alias("x")).first().x is None


def test_prompts_hold_two_distinct_examples(spark):
    examples = [("1 \"2\"\n", "ä\t"), ("1 \"2\"\n", "ä\t"), ("3", "4"), ("5", "6")]
    df = spark.createDataFrame([("Do it.", examples, "int main;", "cpp", "c"), ("Do it.", [], "x", "cpp", "c")], "statement string, examples array<struct<input:string,output:string>>, source string, seed string, target string")
    got = [r[0] for r in df.select(labels.example_prompt(*[F.col(c) for c in df.columns])).collect()]
    listed = json.dumps([{"input": a, "output": b} for a, b in (examples[0], examples[2])], ensure_ascii=False)
    assert got[0] == f"Source language: cpp\nTarget language: c\nSpecification:\nDo it.\nPublic examples:\n{listed}\nSource code:\nint main;"
    assert "\n[]\n" in got[1].replace("examples:\n[]", "\n[]")
    filled = df.select(labels.filled_template("{seed} to {target}: {{{statement}}}", seed=F.col("seed"), target=F.col("target"), statement=F.col("statement"))).first()[0]
    assert filled == "cpp to c: {Do it.}"
    with pytest.raises(KeyError):
        labels.filled_template("{other}", seed=F.col("seed"))
