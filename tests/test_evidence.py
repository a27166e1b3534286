"""Seals, archives, indexes, stages, next steps and delays."""

import hashlib

import pytest
from pyspark.sql import functions as F

from rondel.functions import stats
from rondel.operators import folds, replay
from rondel.sources import checked, evidence, tables

FILE = "path string, sha256 string"


def sha(content):
    return hashlib.sha256(content).hexdigest()


def test_seals(spark, tmp_path):
    root = tmp_path / "run"
    for name in ("a/x.json", "a/y.json", "z.json"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    (root / "w.tmp").write_text("t")
    sealed = tables.written(evidence.seal(spark, str(root)), "seal")
    assert {r.path: r.sha256 for r in sealed.collect()} == {n: sha(n.encode()) for n in ("a/x.json", "a/y.json", "z.json")}
    assert evidence.seal_faults(spark, str(root), sealed).count() == 0
    (root / "a/x.json").write_text("other")
    (root / "a/y.json").unlink()
    (root / "new.json").write_text("n")
    assert {r.path: r.fault for r in evidence.seal_faults(spark, str(root), sealed).collect()} == {"a/x.json": "changed", "a/y.json": "missing", "new.json": "unexpected"}


def test_archives(spark):
    kind = "path string, size long, sha256 string"
    manifest = spark.createDataFrame([("a", 1, "AB"), ("b", 2, "cd"), ("c", 3, "ef"), ("d", 4, None)], kind)
    parts = spark.createDataFrame([("a", 1, "ab"), ("b", 9, "cd"), ("c", 3, "00"), ("e", 1, "x")], kind)
    assert {r.path: r.fault for r in evidence.archive_faults(parts, manifest).collect()} == {"b": "size", "c": "sha256", "d": "missing", "e": "unexpected"}


def test_indexes(spark):
    kind = "problem string, directory string, manifest string, manifest_sha256 string, normalization string"
    rows = [
        ("good", "d/good", "m.json", "AA", "line"), ("plain", "d", None, None, None), ("twice", "d", None, None, None), ("twice", "d", None, None, None), ("out", "../d", None, None, None), ("far", "d", "/m.json", "aa", None),
        ("odd", "d", "m.json", "aa", "words"), ("gone", "d", "n.json", "aa", None), ("changed", "d", "m.json", "bb", None), ("untold", "d", "m.json", None, None),
    ]
    index, files = spark.createDataFrame(rows, kind), spark.createDataFrame([("m.json", "aa")], FILE)
    wanted = spark.createDataFrame([("good",), ("other",)], "problem string")
    assert {r.problem: r.fault for r in evidence.index_faults(index, files, wanted).collect()} == {
        "twice": "duplicate_problem", "out": "path_escape", "far": "path_escape", "odd": "unsupported_normalization", "gone": "missing_manifest", "changed": "manifest_hash_mismatch", "untold": "manifest_hash_mismatch", "other": "not_in_index",
    }
    assert evidence.index_faults(index.limit(0), files).count() == 0


def test_stages_are_checked(spark, tmp_path):
    built = []

    def build(session):
        built.append(1)
        return session.range(5)

    root, contract = str(tmp_path / "stages"), {"name": "five"}
    for _ in range(2):
        assert evidence.checked_stage(spark, root, contract, build).count() == 5
    assert len(built) == 1
    spark.range(6).write.mode("overwrite").parquet(f"{root}/{tables.compact_digest(contract)}")
    with pytest.raises(ValueError, match="doesn't hold the rows"):
        evidence.checked_stage(spark, root, contract, build)


def test_figure_inputs(spark):
    rows = spark.createDataFrame([("r", 0.8, 0.5, 0.4), ("r", 0.9, None, None)], "route string, threshold double, p double, low double")
    got = evidence.figure_inputs(rows, "reach", "route", "threshold", "p", "low").collect()
    assert [tuple(r) for r in got] == [("reach", "r", "0.8", 0.5, 0.4, None)]


def test_paths_are_resolved(spark):
    cases = {"a/b": "a/b", "./a//b/": "a/b", "a/../b": "b", "a/b/../../c": "c", "..": None, "a/../..": None, "/a": None, "s3://a/b": None, "": None, ".": None, "a\\b": None, "a..b/c": "a..b/c"}
    df = spark.createDataFrame(list(cases.items()), "p string, want string")
    assert df.filter(~checked.resolved(F.col("p")).eqNullSafe(F.col("want"))).count() == 0


def test_next_steps(spark):
    kind = "trial string, problem int, route string, step int, restored boolean, status string, similarity double, language string, state string, seed_state string"
    chain = lambda trial, values: [(trial, 1, "r", i + 1, i % 2 == 1, "success" if v != "bad" else "wrong_answer", v if i % 2 == 1 and v != "bad" else None, "cpp", "s", "s") for i, v in enumerate(values)]
    rows = chain("begun", [None, 0.5]) + chain("due", [None, 0.5] * 4 + [None, 0.85]) + chain("over", [None, 0.5] * 5) + chain("failed", [None, "bad"]) + chain("whole", [None, 0.95, None, 0.95])
    states = replay.states(spark.createDataFrame(rows, kind), folds.hops_protocol([0.7, 0.8, 0.9], 0.8))
    assert {r.trial: r.kind for r in replay.next_steps(states).collect()} == {"begun": "discovery", "due": "confirmation", "over": "stop", "failed": "stop", "whole": "stop"}


def test_delays_and_finished_outcomes(spark):
    cases = [("3.5", 3.5), ("-2", 0.0), ("Wed, 21 Oct 2015 07:28:10 GMT", 10.0), ("Wed, 21 Oct 2015 07:27:00 GMT", 0.0), ("soon", 4.0), ("NaN", 4.0), ("inf", 4.0), (None, 4.0), ("", 4.0)]
    df = spark.createDataFrame([(h, w) for h, w in cases], "h string, want double").withColumn("now", F.lit("2015-10-21 07:28:00").cast("timestamp"))
    got = df.select("h", "want", stats.header_delay(F.col("h"), F.lit(2), F.col("now")).alias("d")).collect()
    assert [(r.h, r.d) for r in got] == [(r.h, r.want) for r in got]
    rows = spark.createDataFrame([("x", "success", True), ("x", "invalid", False), (None, "success", False), ("x", None, False)], "t string, c string, want boolean")
    assert rows.filter(stats.finished(F.col("t"), F.col("c")) != F.col("want")).count() == 0


def test_commands(spark, tmp_path, capsys):
    from rondel import cli

    root = tmp_path / "run"
    root.mkdir()
    (root / "a.txt").write_text("a")
    out = str(tmp_path / "seal")
    assert cli.main(["seal", str(root), out]) == 0 and cli.main(["verify", str(root), out]) == 0
    (root / "a.txt").write_text("b")
    assert cli.main(["verify", str(root), out]) == 1
    manifest = tmp_path / "manifest.csv"
    manifest.write_text(f"path,sha256\na.txt,{sha(b'b')}\n")
    assert cli.main(["check-files", str(root), str(manifest)]) == 0
    manifest.write_text("path,sha256\na.txt,00\n../x,00\n")
    assert cli.main(["check-files", str(root), str(manifest)]) == 1
    spark.createDataFrame([("r", "p", "success", 2), ("r", "p", "hop_limit", None)], "route string, problem string, category string, reached_step int").write.parquet(str(tmp_path / "outcomes"))
    spark.createDataFrame([("t", 1, "success")], "trial string, step int, status string").write.parquet(str(tmp_path / "steps"))
    capsys.readouterr()
    assert cli.main(["report", str(tmp_path / "outcomes")]) == 0 and "| r | 2 | 1 | 0.500" in capsys.readouterr().out
    assert cli.main(["resume", str(tmp_path / "steps")]) == 0
    assert cli.main(["profiles"]) == 0 and "strict" in capsys.readouterr().out


def test_metrics_have_scopes_and_requirements(spark):
    from rondel import registry

    registry.register(registry.Metric("scoped_test", "1", "share", lambda a, b: F.lit(1.0), scopes=("origin",), requires=("c", "z")))
    pairs = spark.createDataFrame([(1, "int f(int a) { return a + 1 * 2; }", "int g(int b) { return b + 1 * 2; }", "x"), (2, "int f() {", "x", None), (3, None, "x", None)], "k int, a string, b string, c string")
    got = {(r.k, r.metric): (r.status, r.value, r.reason) for r in registry.measured(pairs, ["scoped_test", "nothing", "tree_similarity", "token_tiling"], "cpp", "origin").collect()}
    assert got[(1, "scoped_test")] == ("unavailable", None, "missing_requirement") and got[(1, "nothing")] == ("unavailable", None, "unknown_metric")
    assert got[(1, "tree_similarity")] == ("measured", 1.0, None) and got[(2, "tree_similarity")] == ("unavailable", None, None)
    assert got[(1, "token_tiling")][0] == "measured" and got[(3, "token_tiling")] == ("unavailable", None, "missing_source")
    assert {r.reason for r in registry.measured(pairs, ["scoped_test"], "cpp", "adjacent").collect()} == {"unsupported_scope"}
    assert {r.value for r in registry.measured(pairs.withColumn("z", F.lit(1)).filter("c is not null"), ["scoped_test"], "cpp", "origin").collect()} == {1.0}
