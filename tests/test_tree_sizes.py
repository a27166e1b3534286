"""Trees of any size are measured, within bounded memory."""

import random

import numpy as np
import pytest

from rondel import queries
from rondel.operators import structure


def test_large_pages_are_measured(spark, tmp_path):
    """A chain and a star share the root, one node and one leaf; all else is deleted or inserted."""
    n = 1200
    chain, star = "<div>" * n + "</div>" * n, "<div>" + "<div></div>" * (n - 1) + "</div>"
    rows = [(0, chain), (1, star), (2, star.replace("<div></div>", "<p></p>", 1)), (3, ""), (4, None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in queries.QUERIES["page_tree_similarity"](spark, str(tmp_path)).collect()}
    assert [(got[k].status, got[k].reason, got[k].ted) for k in range(3)] == [("measured", None, 2 * (n - 2)), ("measured", None, 1), ("measured", None, n)]
    assert [(got[k].nodes, got[k].next_nodes) for k in range(3)] == [(n + 1, n + 1), (n + 1, n + 1), (n + 1, 1)]
    assert [got[k].value for k in range(3)] == [0.0, round(1 - 1 / (n + 1), 6), round(1 - n / (n + 1), 6)]
    assert (got[3].status, got[3].reason) == ("unavailable", "missing_side")


def _random_tree(rng, n):
    parents = [0] + [max(0, i - 1 - rng.randrange(rng.choice((1, 4)))) for i in range(1, n)]
    children = [[j for j in range(1, n) if parents[j] == i] for i in range(n)]
    labels = rng.choices("xy", k=n)
    walk = lambda i: [f"<{labels[i]}", *(e for j in children[i] for e in walk(j)), f">{labels[i]}"]
    return structure.tree(walk(0))[:2]


@pytest.mark.parametrize("seed", range(10))
def test_distance_is_the_same_in_a_file_and_mirrored(monkeypatch, seed):
    rng = random.Random(seed)
    a, b = (_random_tree(rng, rng.randint(20, 60)) for _ in "ab")
    want = structure.tree_distance(a, b)
    assert structure.tree_distance(b, a) == structure.tree_distance(structure._mirrored(*a), structure._mirrored(*b)) == want
    back = structure._mirrored(*structure._mirrored(*a))
    assert (back[0] == a[0]).all() and (back[1] == a[1]).all()
    monkeypatch.setattr(structure, "_HELD", 1)
    monkeypatch.setattr(structure, "_CELLS", 50)
    assert structure.tree_distance(a, b) == want
    assert isinstance(structure._table(3, 4).base, np.memmap)


def test_right_nested_trees_cost_as_little_as_left_nested():
    """Each node holds a leaf and the next node, as where pages leave out ends: from the left a key root for each node."""
    comb = lambda label, n: [e for _ in range(n) for e in ("<li", "=" + label)]
    a, b = (structure.tree(comb(label, 400))[:2] for label in ("br", "hr"))
    assert structure._work(a[1]) > 160_000 and structure._work(structure._mirrored(*a)[1]) < 1_300
    assert structure.tree_distance(a, b) == 400
