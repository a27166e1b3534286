"""Tiling, matching blocks and tree distances against brute force."""

import difflib
import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rondel.functions import text
from rondel.operators import structure


def naive_tiles(a, b, least):
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return out
        n, i, j = best
        free_a[i : i + n] = free_b[j : j + n] = [False] * n
        out.append((i, j, n))


def arrays(seed):
    rng = random.Random(seed)
    letters = "abcd"[: rng.randint(1, 4)]
    a = rng.choices(letters, k=rng.randint(0, 24))
    b = rng.choices(letters, k=rng.randint(0, 24))
    if rng.random() < 0.5:
        b = b[:5] + a[3:14] + b[5:] + a[2:9]
    return np.array(a, object), np.array(b, object)


@pytest.mark.parametrize("seed", range(40))
def test_tiles_equal_brute_force(seed):
    a, b = arrays(seed)
    for least in (1, 2, 4):
        assert structure.tiles(a, b, least) == naive_tiles(a, b, least)


@pytest.mark.parametrize("seed", range(40))
def test_blocks_equal_the_library(seed):
    a, b = arrays(seed)
    want = difflib.SequenceMatcher(None, list(a), list(b), autojunk=False)
    assert sum(n for _, _, n in structure.blocks(a, b)) == sum(m.size for m in want.get_matching_blocks())


def test_long_repeated_arrays():
    a = np.array(["x"] * 20_000, object)
    b = np.array(["x"] * 15_000 + ["y"] + ["x"] * 9_000, object)
    assert sum(t[2] for t in structure.tiles(a, b)) == 20_000
    assert structure.blocks(a, b)[0][2] == 15_000


def forest_distance(a, b):
    """Distance of two forests, tuples of (label, children)."""
    size = lambda forest: sum(1 + size(t[1]) for t in forest)

    @functools.cache
    def d(x, y):
        if not x or not y:
            return size(x) + size(y)
        (p, xs), (q, ys) = x[-1], y[-1]
        return min(d(x[:-1] + xs, y) + 1, d(x, y[:-1] + ys) + 1, d(xs, ys) + d(x[:-1], y[:-1]) + (p != q))

    return d(a, b)


def random_events(rng, nodes):
    parents = [0] + [rng.randrange(i) for i in range(1, nodes)]
    children = [[j for j in range(1, nodes) if parents[j] == i] for i in range(nodes)]
    labels = rng.choices("xyz", k=nodes)

    def walk(i):
        kids = [walk(j) for j in children[i]]
        events = [f"<{labels[i]}", *(e for k in kids for e in k[0]), f">{labels[i]}"]
        return (events if kids or rng.random() < 0.5 else [f"={labels[i]}"]), (labels[i], tuple(k[1] for k in kids))

    return walk(0)


@pytest.mark.parametrize("seed", range(60))
def test_tree_distance_equals_brute_force(seed):
    rng = random.Random(seed)
    (ea, a), (eb, b) = (random_events(rng, rng.randint(1, 9)) for _ in "ab")
    ta, tb = structure.tree(ea), structure.tree(eb)
    assert ta[2:] == tb[2:] == (0, 0)
    assert structure.tree_distance(ta[:2], tb[:2]) == forest_distance((("root", (a,)),), (("root", (b,)),))


def test_tree_of_broken_events():
    labels, first, errors, missing = structure.tree(["<a", "<b", "=c", ">a", ">x", "<d"])
    assert labels.tolist() == ["c", "b", "a", "d", "root"] and first.tolist() == [0, 0, 0, 3, 0] and (errors, missing) == (1, 2)
    assert structure.tree([])[0].tolist() == ["root"]


def test_measures_in_frames(spark):
    rows = [(1, "a b c d e f g h i j".split(), "x a b c d e f g h i y".split()), (2, None, ["a"]), (3, [], []), (4, ["a"], [])]
    pairs = spark.createDataFrame(rows, "k int, a array<string>, b array<string>")
    got = {r.k: r for r in structure.tiled(pairs).collect()}
    assert (got[1].covered, got[1].similarity) == (9, 18 / 21)
    assert [got[k].similarity for k in (2, 3, 4)] == [None, None, 0.0]
    ratios = {r.k: r.r for r in pairs.select("k", structure.sequence_ratio("a", "b").alias("r")).collect()}
    assert ratios == {1: pytest.approx(18 / 21), 2: None, 3: 1.0, 4: 0.0}
    deltas = pairs.select("k", structure.token_deltas(F.col("a"), F.col("b"), text.dice(F.col("a"), F.col("b"))).alias("d")).filter("k = 1").first().d
    assert [(d.metric, d.status, round(d.value, 6)) for d in deltas] == [("token_multiset_dice", "measured", round(1 - 18 / 21, 6)), ("token_sequence_ratio", "measured", round(1 - 18 / 21, 6))]


def test_one_measurement_a_pair(spark):
    rows = spark.createDataFrame([("a", 0.5), ("b", 0.1), ("b", 0.2), ("c", None)], "pair string, similarity double")
    got = {r.pair: (r.status, r.value, r.reason) for r in structure.measured_pairs(rows, "pair").collect()}
    assert got == {"a": ("measured", 0.5, None), "b": ("unavailable", None, "pair_not_measured"), "c": ("unavailable", None, "pair_not_measured")}
    for bad in (1.2, -0.1, float("nan")):
        with pytest.raises(Exception, match="outside 0 to 1"):
            structure.measured_pairs(spark.createDataFrame([("a", bad)], "pair string, similarity double"), "pair").collect()


def test_trees_in_frames(spark):
    sources = spark.createDataFrame([(1, "int main() { return x + 1; }", "int main() { return y + 1; }"), (2, "f(a, b)", "f(a)"), (3, "f(", "f()"), (4, None, "f"), (5, "a " * 30, "a")], "k int, x string, y string")
    events = sources.select("k", *[F.when(F.col(c).isNotNull(), structure.source_events(text.c_tokens(F.col(c)))).alias(c) for c in "xy"])
    got = {r.k: r.m for r in events.select("k", structure.tree_similarity(20)("x", "y").alias("m")).collect()}
    assert (got[1].value, got[1].ted) == (1.0, 0)
    assert (got[2].ted, got[2].nodes, got[2].value) == (1, [5, 4], 0.8)
    assert [(got[k].status, got[k].reason) for k in (3, 4, 5)] == [("unavailable", "parse_invalid"), ("unavailable", "missing_side"), ("unavailable", "tree_too_large")]
    page = spark.createDataFrame([("<!-- <p> --><div class='a>b'><p>t<br><img src=x/></p><SCRIPT>if (a<b) '<i>'</script></div>",)], "h string")
    assert page.select(structure.page_events(F.col("h")).alias("e")).first().e == ["<div", "<p", "=br", "=img", ">p", ">div"]
