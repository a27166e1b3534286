"""Replay, selection, integrity, constraints, responses, schedules and checked files on small tables."""

import hashlib
import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from rondel.functions import responses
from rondel.operators import constraints, folds, integrity, replay, schedules, selection
from rondel.sources import checked, tables

STEP = "trial int, problem int, route string, step int, restored boolean, status string, similarity double, language string, state string, seed_state string"
THRESHOLDS = [0.7, 0.8, 0.9]


def chains_table(spark, seed=4, n=40):
    rng = random.Random(seed)
    rows = []
    for trial in range(n):
        for step in range(1, rng.randint(1, 14) + 1):
            status = rng.choices(["success", "wrong_answer", "infrastructure_error"], [20, 1, 1])[0]
            rows.append((trial, trial % 3, "r", step, step % 2 == 0, status, rng.choice([0.5, 0.75, 0.85, 0.95, None]), "cpp" if step % 2 == 0 else "java", rng.choice("abc"), "a"))
    return spark.createDataFrame(rows, STEP)


def ordered(df):
    return sorted((json.dumps(r.asDict(True), sort_keys=True, default=str) for r in df.collect()))


@pytest.mark.parametrize("cut", ["step <= 0", "step <= 1", "step <= 4", "step <= trial % 9", "trial % 2 = 0", "step <= 99"])
def test_resumed_states_decide_as_from_scratch(spark, cut):
    steps = chains_table(spark)
    for protocol in (folds.hops_protocol(THRESHOLDS, 0.8), folds.fps_protocol(THRESHOLDS, 3)):
        before = tables.written(replay.states(steps.filter(cut), protocol), "states")
        after = replay.resumed(before, steps, protocol)
        assert ordered(protocol.decided(after)) == ordered(protocol.fold(folds.collected(steps)))
        assert ordered(after) == ordered(replay.resumed(after, steps, protocol))


def test_resumed_of_empty_tables(spark):
    steps, protocol = chains_table(spark, n=3), folds.hops_protocol(THRESHOLDS, 0.8)
    none = replay.states(steps.limit(0), protocol)
    assert none.count() == 0 and replay.resumed(none, steps.limit(0), protocol).count() == 0
    assert replay.resumed(none, steps, protocol).count() == 3


def test_resume_plan(spark):
    rows = [("a", 1, "success"), ("a", 2, "bad"), ("a", 4, "success"), ("b", 2, "success"), ("c", 1, "open"), ("d", 1, "success"), ("d", 2, "open"), ("d", 3, "success")]
    steps = spark.createDataFrame(rows, "trial string, step int, status string")
    got = {r.trial: tuple(r)[1:] for r in replay.resume_plan(steps, F.col("status") != "open").collect()}
    assert got == {"a": (2, 3, "bad", 1), "b": (0, 1, "running", 1), "c": (0, 1, "running", 1), "d": (1, 2, "success", 2)}


def test_replay_finds_what_was_recorded_otherwise(spark):
    steps, protocol = chains_table(spark), folds.hops_protocol(THRESHOLDS, 0.8)
    recorded = protocol.fold(folds.collected(steps))
    whole = replay.replayed(recorded, steps, protocol, ["terminal", "confirmation", "n_steps"])
    assert replay.replay_summary(whole).first().matches_original
    changed = recorded.withColumn("terminal", F.when(F.col("trial") == 5, "other").otherwise(F.col("terminal"))).filter("trial <> 6")
    found = {r.trial: r for r in replay.replayed(changed, steps.filter("trial <> 7"), protocol, ["terminal", "n_steps"]).collect()}
    assert {t for t, r in found.items() if not r.matches} == {5, 6, 7}
    assert [(d.field, d.recorded) for d in found[5].differences] == [("terminal", "other")]
    assert (found[6].reason, found[7].reason) == ("not_recorded", "no_steps")
    assert all((r.reason == "saved_history_exhausted") == (r.matches and recorded.filter(f"trial = {t}").first().terminal is None) for t, r in found.items() if t not in (5, 6, 7))


def selection_tables(spark, **changes):
    plan = [("r1", "p1", "c"), ("r1", "p2", "c"), ("r1", "p3", "c"), ("r1", "p4", "c")]
    made = {
        "runs": [("r1", "h", "v", "main")],
        "index": [("r1", "p1", "c", "h", "a1", "a2"), ("r1", "p2", "c", "h", None, "b1"), ("r1", "p3", "c", "h", None, "c1")],
        "attempts": [("r1", "p1", "c", "a1", "success", "h", "v", False), ("r1", "p1", "c", "a2", "running", "h", "v", None), ("r1", "p2", "c", "b1", "api_error", "h", "v", False), ("r1", "p3", "c", "c1", "running", "h", "v", False)],
    } | changes
    kinds = {"runs": "run string, condition_hash string, validation_hash string, phase string", "index": "run string, problem string, target string, condition_hash string, selected string, active string", "attempts": "run string, problem string, target string, attempt string, status string, condition_hash string, validation_hash string, missing_toolchain boolean"}
    frames = {k: spark.createDataFrame(v, kinds[k]) for k, v in made.items()}
    return selection.selected(spark.createDataFrame(plan, "run string, problem string, target string"), frames["runs"], frames["index"], frames["attempts"])


def test_selection_with_exclusions(spark):
    found = selection_tables(spark)
    assert [tuple(r) for r in selection.chosen(found).collect()] == [("r1", "p1", "c", "a1", "success")]
    assert sorted((r.problem, r.reason) for r in selection.excluded(found).collect()) == [("p2", "infrastructure"), ("p3", "incomplete"), ("p4", "incomplete")]
    assert selection.faults(found).count() == 0 and selection.strict(found).count() == 4


ATTEMPT = ("r1", "p1", "c", "a1", "success", "h", "v", False)
FAULTS = [
    ({"runs": [("r1", "h", "v", "main")] * 2}, "duplicate_run"),
    ({"runs": [("r1", "h", "v", "main"), ("r2", "g", "v", "main")]}, "mixed_conditions"),
    ({"runs": [("r1", "h", "v", "main"), ("r2", "h", "v", "pilot")]}, "pooled_pilots"),
    ({"attempts": [ATTEMPT, ATTEMPT]}, "duplicate_attempt"),
    ({"index": [("r1", "p1", "c", "g", "a1", None)]}, "index_condition_mismatch"),
    ({"index": [("r1", "p1", "c", "h", None, "a9")]}, "invalid_active_attempt"),
    ({"index": [("r1", "p1", "c", "h", None, None)]}, "invalid_active_attempt"),
    ({"index": [("r1", "p1", "c", "h", "a9", None)]}, "invalid_selected_attempt"),
    ({"attempts": [ATTEMPT[:5] + ("g", "v", False)]}, "manifest_identity_mismatch"),
    ({"attempts": [ATTEMPT[:5] + ("h", None, False)]}, "manifest_identity_mismatch"),
    ({"attempts": [ATTEMPT[:4] + ("running", "h", "v", False)]}, "unevaluable_attempt"),
    ({"attempts": [ATTEMPT[:7] + (True,)]}, "unevaluable_attempt"),
]


@pytest.mark.parametrize("change,fault", FAULTS)
def test_selection_names_the_first_fault(spark, change, fault):
    found = selection_tables(spark, **change)
    row = found.filter("problem = 'p1'").first()
    assert (row.attempt, row.reason, row.fault) == (None, None, fault)
    with pytest.raises(Exception, match=fault):
        selection.strict(found).collect()


def test_contract_precedence_and_pilots(spark):
    rows = [("x", "main", i, c) for i, c in [(1, None), (2, "second"), (4, "last")]] + [("y", "main", 3, "third")]
    got = selection.first_contract(spark.createDataFrame(rows, "campaign string, phase string, place int, contract string"), ["campaign"]).collect()
    assert sorted(tuple(r) for r in got) == [("x", 2, "second"), ("y", 3, "third")]
    contracts = spark.createDataFrame([("main", ["a"], 5, ["p"], 2), ("pilot", ["a"], 5, ["p"], None)], "phase string, problem_ids array<string>, repeats int, pilot_problem_ids array<string>, pilot_repeats int")
    assert [(r.problem_ids, r.repeats) for r in selection.with_pilot(contracts).orderBy("phase").collect()] == [(["a"], 5), (["p"], 1)]


# Integrity


def sealed(n, chain="c", first=1):
    out, before = [], ""
    for i in range(first, first + n):
        before = hashlib.sha256(f"{before}\np{i}".encode()).hexdigest()
        out.append([chain, i, f"p{i}", before])
    return out


CHAIN = "chain string, seq long, payload string, digest string"


@pytest.mark.parametrize("rows", [1, 3, 7, 1000])
def test_broken_links(spark, rows):
    good = sealed(30) + sealed(1, "d") + sealed(12, None)
    frame = spark.createDataFrame(good, CHAIN)
    assert integrity.broken_links(frame, rows).count() == 0
    assert ordered(integrity.sealed_chain(frame.drop("digest"))) == ordered(frame)
    bad = [list(r) for r in good if not (r[0] == "c" and 14 <= r[1] <= 21)]
    for r in bad:
        if r[:2] == ["c", 5]:
            r[2] = "changed"
        if r[:2] == ["c", 8]:
            r[3] = None
        if r[:2] == [None, 12]:
            r[3] = "x"
    bad += [["c", 28, "p28", "zz"], ["d", None, "p", "x"]]
    got = sorted(((r.chain, r.seq, r.fault) for r in integrity.broken_links(spark.createDataFrame(bad, CHAIN).repartition(3), rows).collect()), key=str)
    assert got == sorted([("c", 5, "digest"), ("c", 8, "digest"), ("c", 9, "digest"), ("c", 22, "gap"), ("c", 28, "duplicate_number"), ("c", 29, "digest"), (None, 12, "digest"), ("d", None, "unnumbered")], key=str)
    assert integrity.broken_links(frame.limit(0), rows).count() == 0


def test_multiset_digest(spark):
    rows = [(i % 3, i, None if i % 5 == 0 else f"t{i % 7}") for i in range(60)] + [(1, 1, "t1")]
    first = spark.createDataFrame(rows, "part int, n int, t string")
    again = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "part int, n int, t string").repartition(5).select("t", "n", "part")
    assert integrity.rebuilt_differences(first, again, "part").count() == 0
    lost, doubled, changed = rows[1:], [*rows, rows[1]], [(0, 0, ""), *rows[1:]]
    for other, part in ((lost, 0), (doubled, 1), (changed, 0)):
        got = integrity.rebuilt_differences(first, spark.createDataFrame(other, "part int, n int, t string"), "part").collect()
        assert [(r.part, r.fault) for r in got] == [(part, "changed")]
    sides = integrity.rebuilt_differences(first.filter("part < 2"), first.filter("part > 0"), "part").collect()
    assert sorted((r.part, r.fault) for r in sides) == [(0, "missing"), (2, "unexpected")]
    parts = spark.createDataFrame([(None, "a"), (None, None)], "part int, t string")
    assert integrity.rebuilt_differences(parts, parts.limit(1), "part").first().fault == "changed"
    # Values don't run into their neighbours.
    a, b = (spark.createDataFrame([r], "x string, y string") for r in (("a;y=1:b", "c"), ("a", "b;y=1:c")))
    assert integrity.rebuilt_differences(a.withColumn("p", F.lit(1)), b.withColumn("p", F.lit(1)), "p").count() == 1


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_inventory_tree(spark, depth):
    before = spark.createDataFrame([(f"f{i}", f"text{i % 50}") for i in range(120)], "path string, content string")
    after = before.filter("path <> 'f7'").withColumn("content", F.expr("if(path = 'f9', 'new', content)")).union(spark.createDataFrame([("g", "x")], "path string, content string"))
    inventory, store = integrity.bundle(before)
    assert inventory.count() == 120 and store.count() == 50
    other = integrity.bundle(after)[0]
    trees = integrity.inventory_tree(inventory, depth), integrity.inventory_tree(other, depth)
    assert ordered(trees[0]) == ordered(integrity.inventory_tree(inventory.repartition(4), depth))
    got = integrity.changed_entries(inventory, other, trees, depth)
    assert sorted((r.path, r.fault) for r in got.collect()) == [("f7", "missing"), ("f9", "changed"), ("g", "unexpected")]
    assert integrity.changed_entries(inventory, inventory, (trees[0], trees[0]), depth).count() == 0
    root = {r.digest for r in trees[0].union(trees[1]).filter("level = 0").collect()}
    assert len(root) == 2 and [integrity.tree_depth(n) for n in (0, 64, 65, 1024, 1025, 10**9)] == [1, 1, 1, 1, 2, 6]


def test_masking_at_any_depth(spark):
    row = ({"a": [{"token": "s", "b": {"token": "s", "c": [{"k": {"token": "s", "x": "y"}}]}}]}, "t", {"token": {"v": "s"}, "z": {"v": "w"}})
    kind = "deep struct<a:array<struct<token:string,b:struct<token:string,c:array<struct<k:map<string,string>>>>>>>, token string, more map<string,struct<v:string>>"
    got = tables.masked(spark.createDataFrame([row, (None, None, None)], kind), {"token"}).collect()
    assert "'s'" not in str(got[0]) and got[0].deep.a[0].b.c[0].k == {"token": "***", "x": "y"} and got[0].more["token"] is None and got[0].more["z"].v == "w"
    assert got[1].deep is None and got[1].more is None and got[1].token == "***"
    texts = spark.createDataFrame([('{"a": [{"token": {"x": 1}, "b": 2}]}',), ("no json",), (None,)], "t string")
    assert [r[0] for r in texts.select(tables.masked_json({"token"})("t")).collect()] == ['{"a": [{"b": 2, "token": "***"}]}', "***", None]


# Constraints


def test_constraints(spark):
    rows = [(1, 5, "ab", [1, 2, 3], "x"), (2, None, None, None, None), (3, 11, "a!", [3, 3], "y"), (4, 0, "abcd", [], "x"), (5, 7, "ab\n", [1, None], "z")]
    df = spark.createDataFrame(rows, "id int, n int, s string, a array<int>, u string")
    rules = [
        {"column": "n", "required": True, "min": 1, "max": 10},
        {"column": "s", "pattern": "[a-z]+", "length": (1, 3)},
        {"column": "a", "ascending": True, "distinct": True, "length": (1, 5), "each": {"max": 2, "required": True}},
        {"column": "u", "unique": True},
        {"column": "u", "in_table": ("known", "v")},
        {"name": "small", "holds": "n < 6", "when": "s = 'ab'"},
        {"column": "u", "name": "kind", "one_of": ["x", "y"], "when": "id > 3"},
        {"column": "s", "name": "whole", "type": "int", "when": "id = 4"},
    ]
    known = spark.createDataFrame([("x",), ("y",), (None,)], "v string")
    got = sorted((r.rule, r.id) for r in constraints.violations(df, rules, ["id"], {"known": known}).collect())
    assert got == sorted([
        ("n_required", 2), ("n_max", 3), ("n_min", 4), ("s_pattern", 3), ("s_pattern", 5), ("s_length", 4), ("a_ascending", 3), ("a_distinct", 3), ("a_length", 4), ("a_each_max", 1), ("a_each_max", 3), ("a_each_required", 5),
        ("u_unique", 1), ("u_unique", 4), ("u_in_table", 5), ("kind", 5), ("whole", 4),
    ])
    assert constraints.violations(df.limit(0), rules, ["id"], {"known": known}).count() == 0
    for bad in ([{"column": "n", "least": 1}], [{"column": "n", "min": 1}, {"column": "n", "min": 2}]):
        with pytest.raises(ValueError):
            constraints.compiled(bad, df)


OBSERVATION = "problem int, route string, attempt int, threshold double, category string, success boolean, reached_step int, d_n int, protocol string, schema_version string, contract_hash string, contract string, strict boolean, translation_steps int, steps array<struct<step:int,evaluation_status:string,sym_adj:double>>, phase string"


def observation(**changes):
    steps = [(1, "success", None), (2, "success", 0.5), (3, "success", None), (4, "success", 0.85)]
    made = {"problem": 1, "route": "r", "attempt": 1, "threshold": 0.8, "category": "success", "success": True, "reached_step": 4, "d_n": None, "protocol": "hops", "schema_version": "observation", "contract_hash": "c", "contract": "c", "strict": True, "translation_steps": 4, "steps": steps, "phase": "main"}
    return tuple((made | changes).values())


CAMPAIGN = [
    ({}, set()),
    ({"protocol": "old"}, {"protocol"}), ({"schema_version": "old"}, {"protocol"}), ({"contract_hash": None}, {"contract_hash"}), ({"translation_steps": 5}, {"step_numbering"}), ({"d_n": 3}, {"foreign_distance"}),
    ({"category": None}, {"category", "success_flag", "reach_without_success"}), ({"category": "odd", "success": False}, {"known_category", "reach_without_success"}), ({"success": False}, {"success_flag"}),
    ({"reached_step": 3}, {"reached_range"}), ({"reached_step": None}, {"reached_range"}), ({"reached_step": 0}, {"reached_range"}), ({"reached_step": 6}, {"unfounded_reach", "earlier_reach"}), ({"threshold": 0.9}, {"similarity_at_reach"}), ({"threshold": 0.4}, {"earlier_reach"}),
    ({"category": "hop_limit", "success": False}, {"reach_without_success"}), ({"attempt": 9}, {"unplanned_slot"}), ({"strict": False, "steps": [], "threshold": 0.9}, set()),
    ({"steps": [(1, "success", None), (2, "bad", 0.5), (3, "success", None), (4, "success", 0.85)]}, {"unfounded_reach"}), ({"steps": [(1, "success", None), (2, "success", 0.5), (4, "success", None), (4, "success", 0.85)]}, {"step_numbering"}),
]


def test_campaign_rules(spark):
    slots = spark.createDataFrame([(1, "r", 1)], "problem int, route string, attempt int")
    for change, rules in CAMPAIGN:
        found = constraints.campaign_violations(spark.createDataFrame([observation(**change)], OBSERVATION), slots, "hops", "observation")
        assert {r.rule for r in found.collect()} == rules, change
    both = spark.createDataFrame([observation(), observation(phase="pilot")], OBSERVATION)
    assert sorted(r.rule for r in constraints.campaign_violations(both, slots, "hops", "observation").collect()) == ["mixed_phase", "repeated_slot"]


# Responses

CHAT = {"id": "i", "model": "m", "choices": [{"index": 0, "message": {"role": "assistant", "content": "hi"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3, "completion_tokens": -1}}
LENIENT = [
    (CHAT, ("chat_completions", "ok", "hi", "stop", 3, -1, None, None)),
    (CHAT | {"choices": []}, ("chat_completions", "ok", "", None, 3, -1, None, None)),
    (CHAT | {"choices": CHAT["choices"] * 2}, ("chat_completions", "multiple_choices", None, None, None, None, None, None)),
    (CHAT | {"choices": {}}, ("chat_completions", "choices_not_a_list", None, None, None, None, None, None)),
    (CHAT | {"choices": [{"message": {"content": 5}}]}, ("chat_completions", "content_not_text", None, None, None, None, None, None)),
    (CHAT | {"choices": [{"message": {"content": None}}]}, ("chat_completions", "ok", "", None, 3, -1, None, None)),
    (CHAT | {"error": {"message": "x"}}, ("chat_completions", "provider_error", None, None, None, None, None, None)),
    (CHAT | {"error": {}}, ("chat_completions", "ok", "hi", "stop", 3, -1, None, None)),
    (CHAT | {"usage": 5}, ("chat_completions", "usage_not_an_object", None, None, None, None, None, None)),
    (CHAT | {"usage": {"cost": 0.25}}, ("chat_completions", "ok", "hi", "stop", None, None, 0.25, "reported")),
    (CHAT | {"usage": {"cost": 1, "opencode": {"estimated": True}}}, ("chat_completions", "ok", "hi", "stop", None, None, 1.0, "provider_estimated")),
    (CHAT | {"usage": {"cost": -1}}, ("chat_completions", "invalid_cost", None, None, None, None, None, None)),
    (CHAT | {"usage": {"cost": True}}, ("chat_completions", "invalid_cost", None, None, None, None, None, None)),
    ({"output": [{"type": "message", "content": [{"type": "output_text", "text": "a"}, {"type": "refusal"}, {"type": "output_text", "text": "b"}]}, {"type": "message", "role": "user", "content": [{"type": "output_text", "text": "no"}]}], "status": "completed", "usage": {"input_tokens": 7, "output_tokens": 1}}, ("responses", "ok", "ab", "stop", 7, 1, None, None)),
    ({"output": [], "status": "incomplete", "incomplete_details": {"reason": "max_output_tokens"}}, ("responses", "ok", "", "length", None, None, None, None)),
    ({"output": [], "status": "queued"}, ("responses", "not_completed", None, None, None, None, None, None)),
    ({"output": "x"}, ("responses", "output_not_a_list", None, None, None, None, None, None)),
    ({"text": "t", "finish_reason": "end"}, ("copilot_sdk", "ok", "t", "end", None, None, None, None)),
    ({"other": 1}, (None, "unknown_protocol", None, None, None, None, None, None)),
    ([1], (None, "not_an_object", None, None, None, None, None, None)),
    ("{broken", (None, "not_an_object", None, None, None, None, None, None)),
    (None, (None, "not_an_object", None, None, None, None, None, None)),
]


def test_normalised_responses(spark):
    raw = [(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, (r, _) in enumerate(LENIENT)]
    got = spark.createDataFrame(raw, "i int, raw string").select("i", responses.normalised_response(F.col("raw")).alias("n")).select("i", "n.*").collect()
    for r in got:
        assert (r.protocol, r.status, r.text, r.finish_reason, r.prompt_tokens, r.completion_tokens, r.cost_usd, r.cost_source) == LENIENT[r.i][1], LENIENT[r.i][0]


def test_strict_responses(spark):
    choice = CHAT["choices"][0]
    cases = [
        (CHAT, "ok"), (CHAT | {"id": " "}, "no_id"), (CHAT | {"id": 4}, "no_id"), (CHAT | {"model": None}, "no_model"), (CHAT | {"choices": []}, "no_choices"), (CHAT | {"choices": [choice, 5]}, "choice_not_an_object"),
        (CHAT | {"choices": [choice | {"index": True}]}, "no_index"), (CHAT | {"choices": [choice | {"message": "x"}]}, "no_message"), (CHAT | {"choices": [choice | {"message": {"content": "x"}}]}, "no_role"),
        (CHAT | {"choices": [choice, choice | {"message": {"role": "r", "content": " "}}]}, "no_content"), ([], "not_an_object"),
    ]
    rows = [(i, json.dumps(c)) for i, (c, _) in enumerate(cases)]
    got = spark.createDataFrame(rows, "i int, raw string").select("i", responses.strict_response(F.col("raw")).alias("n")).select("i", "n.*").collect()
    assert [r.status for r in sorted(got)] == [s for _, s in cases]
    first = sorted(got)[0]
    assert (first.prompt_tokens, first.completion_tokens, first.choices[0].content, first.choices[0].finish_reason) == (3, None, "hi", "stop")


def test_generation_evidence(spark):
    rows = [('{"actual_model": "m", "requested_generation": {"temperature": 0}, "effective_generation": {"top_p": 1}}',), ("{}",), (None,)]
    got = [r.e for r in spark.createDataFrame(rows, "s string").select(responses.generation_evidence(F.col("s")).alias("e")).collect()]
    assert (got[0].actual_model, json.loads(got[0].requested), got[0].sent, json.loads(got[0].effective), got[0].reason) == ("m", {"temperature": 0}, None, {"top_p": 1}, None)
    assert got[1].reason == got[2].reason == "not_reported"


# Schedules


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_keyed_permutation_is_a_bijection(spark, n):
    orders = [[r.p for r in spark.range(n).select("id", schedules.permuted(F.col("id"), n, key).alias("p")).orderBy("id").collect()] for key in ("a", "b")]
    assert all(sorted(o) == list(range(n)) for o in orders)
    assert n < 10 or (orders[0] != orders[1] and orders[0] != list(range(n)))


def test_numbers_shards_and_rotation(spark):
    rows = spark.createDataFrame([(random.Random(i).random(), i) for i in range(200)], "x double, i int").repartition(5)
    got = schedules.numbered(rows, "x").orderBy("x").collect()
    assert [r["index"] for r in got] == list(range(200))
    placed = tables.written(schedules.shuffled(rows, "k", "x"), "placed")
    parts = [schedules.shard(placed, f"{i}/3").count() for i in (1, 2, 3)]
    assert parts == [67, 67, 66]
    for bad in ("0/3", "4/3", "x", "1/2/3"):
        with pytest.raises(ValueError):
            schedules.shard(placed, bad)
    targets = ["a", "b", "c"]
    problems = spark.createDataFrame([(p, i) for i, p in enumerate("pqrs")], "problem string, position int")
    got = schedules.rotated(problems, targets, 3).collect()
    for problem, slot in itertools.product("pqrs", range(3)):
        assert sorted(r.target for r in got if (r.problem, r.slot) == (problem, slot)) == targets
    for problem, repeat in itertools.product("pqrs", (1, 2, 3)):
        assert sorted(r.target for r in got if (r.problem, r.repeat) == (problem, repeat)) == targets
    # As lists are rotated: the second problem's second repeat begins two later.
    assert [r.target for r in sorted(got, key=lambda r: r.slot) if (r.problem, r.repeat) == ("q", 2)] == ["c", "a", "b"]
    assert {r.target for r in schedules.rotated(problems, targets, 2, False).filter("slot = 0").collect()} == {"a"}
    assert schedules.shuffled(rows.limit(0), "k", "x").count() == 0


# Files


def test_checked_files(spark, tmp_path):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    root = tmp_path / "corpus"
    for name, content in {"a/x.txt": b"one", "a/y.txt": b"two", "b.bin": b"\xff\x00", "extra.txt": b"e"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    entries = [("a/x.txt", sha(b"one")), ("a/./../a/y.txt", sha(b"two")), ("b.bin", sha(b"other")), ("gone.txt", sha(b"")), ("../outside", "x"), ("/etc/passwd", "x"), ("file:/etc/passwd", "x"), ("a/../../b", "x")]
    manifest = spark.createDataFrame(entries, "path string, sha256 string")
    got = {r.path: (r.status, bytes(r.content) if r.content is not None else None) for r in checked.checked_files(spark, str(root), manifest).collect()}
    assert got == {
        "a/x.txt": ("ok", b"one"), "a/y.txt": ("ok", b"two"), "b.bin": ("hash_mismatch", None), "gone.txt": ("missing", None), "extra.txt": ("unlisted", None),
        "../outside": ("path_escape", None), "/etc/passwd": ("path_escape", None), "file:/etc/passwd": ("path_escape", None), "a/../../b": ("path_escape", None),
    }
    for entry, status in ((entries[2], "hash_mismatch"), (entries[3], "missing"), (entries[4], "path_escape"), (entries[0], "unlisted")):
        with pytest.raises(Exception, match=status):
            rows = [entry] if status == "unlisted" else [entries[0], entries[1], ("extra.txt", sha(b"e")), ("b.bin", sha(b"\xff\x00")), entry] if status != "hash_mismatch" else [entry, entries[0], entries[1], ("extra.txt", sha(b"e"))]
            checked.checked_files(spark, str(root), spark.createDataFrame(rows, "path string, sha256 string"), "fail").collect()
    twice = spark.createDataFrame([entries[0], ("a//x.txt", sha(b"one"))], "path string, sha256 string")
    assert {r.path: r.status for r in checked.checked_files(spark, str(root), twice).collect()}["a/x.txt"] == "repeated"
    with pytest.raises(ValueError):
        checked.checked_files(spark, str(root), manifest, "other")


def test_missing_sides_end_the_job(spark):
    pairs = spark.createDataFrame([("p", "r", "1", "i", None, "no_output")], "problem string, role string, case string, input string, expected string, fault string")
    assert checked.fixture_sides(pairs).count() == 1
    with pytest.raises(Exception, match="no_output at p r 1"):
        checked.fixture_sides(pairs, "fail").collect()


def test_diagnostics(spark, tmp_path):
    step = tmp_path / "p1" / "cpp-to-c" / "attempt-1" / "iterations" / "iter-001" / "step-001"
    os.makedirs(step)
    body = json.dumps({"usage": {"prompt_tokens": 4, "completion_tokens": 2}, "choices": [{"finish_reason": "length"}, {"finish_reason": "stop"}]})
    (step / "api-attempt-1.json").write_text(json.dumps({"seconds": 2.0, "error": None, "http_status": 200, "raw_response": body}))
    (step / "api-attempt-2.json").write_text(json.dumps({"seconds": 4.0, "error": "late", "http_status": 500, "raw_response": body}))
    (step / "step.json").write_text(json.dumps({"status": "wrong_answer", "error": None, "truncated": True, "target_language": "c", "execution": {"compile_result": None, "fixture_results": [{"fixture_stem": "1", "status": "success", "duration_seconds": 0.5}, {"fixture_stem": "2", "status": "timeout", "duration_seconds": 1.5}]}}))
    calls = checked.call_diagnostics(spark, str(tmp_path)).first()
    assert (calls.calls, calls.seconds, calls.median_seconds, calls.max_seconds, calls.prompt_tokens, calls.completion_tokens, calls.errors, calls.truncated_choices) == (2, 6.0, 3.0, 4.0, 4, 2, 1, 1)
    steps = checked.step_diagnostics(spark, str(tmp_path)).first()
    assert tuple(steps) == ("c", "wrong_answer", 1, 1, 0.0, 2.0, 1)


def test_repeated_step_numbers_stay_single_rows(spark):
    step = lambda n, kind: {"step": n, "kind": kind, "phase": None}
    rows = spark.createDataFrame([{"problem_id": "p", "route": "r", "attempt": 1, "steps": [step(1, "search"), step(1, None), step(2, "confirmation")]}], tables.OBSERVATION)
    assert sorted((r.step, r.phase) for r in tables.step_rows(rows).collect()) == [(1, "discovery"), (1, "discovery"), (2, "confirmation")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_shuffle_no_more_than_they_must(spark):
    df = spark.range(10).selectExpr("id", "cast(id as int) n", "cast(id as string) s")
    rules = [{"column": "n", "min": 1, "max": 5}, {"column": "s", "pattern": "[0-4]"}, {"name": "both", "holds": "n < 9 or s = '9'"}]
    assert "Exchange" not in plan(constraints.violations(df, rules, ["id"]))
    records = spark.createDataFrame(sealed(4), CHAIN)
    # Links inside a range share one shuffle with the ranges' ends; nothing is dealt by the chain alone but those ends.
    text = plan(integrity.broken_links(records))
    assert "SinglePartition" not in text and "CartesianProduct" not in text
    assert "Exchange" not in plan(spark.range(5).select(schedules.permuted(F.col("id"), 5, "k")))
    digests = plan(integrity.multiset_digest(df.withColumn("part", F.col("n") % 2), "part"))
    assert digests.count("Exchange hashpartitioning") == 1 and "partial_sum" in digests
