"""Structural similarity of token arrays and trees.

Spark pairs the rows and sends each pair's two arrays in Arrow batches; numbers for runs of tokens
(``Runs``) make each comparison of a pair a few array operations.
"""

from __future__ import annotations

import os
import tempfile
from collections import Counter, deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType

#: Tokens that a tile has at least.
LEAST_TILE = 9


class Runs:
    """Exact numbers for all runs of tokens of two arrays: equal numbers, equal runs.

    Runs of 2^k tokens are numbered by pairs of runs half as long; any other length is two overlapping ones.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        codes = pd.factorize(np.concatenate([a, b]))[0].astype(np.int64)
        self.n, self.levels = len(a), [codes]
        self.a, self.b = codes[: len(a)], codes[len(a) :]

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            both = last[:-half] * (len(self.levels[0]) + 1) + last[half:]
            self.levels.append(np.unique(both, return_inverse=True)[1].astype(np.int64))
        return self.levels[k]

    def numbers(self, length: int, starts: np.ndarray, second: bool) -> np.ndarray:
        """The numbers of the runs of ``length`` tokens at ``starts`` of the first or second array."""
        k = length.bit_length() - 1
        names, at = self._level(k), starts + (self.n if second else 0)
        return names[at] * (len(self.levels[0]) + 1) + names[at + length - (1 << k)]


def _greatest(low: int, high: int, holds) -> int:
    """The greatest number in low..high for which ``holds``, which is monotone; low - 1 if none."""
    low -= 1
    while low < high:
        middle = (low + high + 1) // 2
        if holds(middle):
            low = middle
        else:
            high = middle - 1
    return low


def tiles(a: np.ndarray, b: np.ndarray, least: int = LEAST_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length) of common runs of ``least`` tokens or more that don't overlap.

    The longest run of tokens without a tile comes first; of equally long ones that with the least start in a, then in b.
    """
    runs, out = Runs(a, b), []
    free = [np.ones(len(a), bool), np.ones(len(b), bool)]
    if min(len(a), len(b)) < least:
        return out
    # Longer runs begin where both have a run of the least length: mostly few places, if any, and no longer run needs a number elsewhere.
    p, q = runs.numbers(least, np.arange(len(a) - least + 1), False), runs.numbers(least, np.arange(len(b) - least + 1), True)
    near = [np.flatnonzero(np.isin(p, q)), None]
    if not len(near[0]):
        return out
    near[1] = np.flatnonzero(np.isin(q, p[near[0]]))

    def starts(side: int, length: int) -> np.ndarray:
        # Positions from which ``length`` tokens are free.
        taken = np.concatenate([[0], np.cumsum(~free[side])])
        at = near[side][near[side] <= len(free[side]) - length]
        return at[taken[at + length] == taken[at]]

    def common(length: int) -> bool:
        x, y = starts(0, length), starts(1, length)
        return bool(len(x) and len(y) and np.isin(runs.numbers(length, x, False), runs.numbers(length, y, True)).any())

    # The first bound: the first of doubled lengths that isn't common.
    bound, most = least, min(len(a), len(b))
    while bound < most and common(bound):
        bound = min(2 * bound, most)
    while (length := _greatest(least, bound, common)) >= least:
        x, y = starts(0, length), starts(1, length)
        p, q = runs.numbers(length, x, False), runs.numbers(length, y, True)
        waiting: dict[int, deque] = {}
        kept = np.isin(q, p)
        for number, at in zip(q[kept].tolist(), y[kept].tolist()):
            waiting.setdefault(number, deque()).append(at)
        for number, i in zip(p.tolist(), x.tolist()):
            places = waiting.get(number)
            if places and free[0][i : i + length].all():
                # A place that is taken in part stays so.
                while places and not free[1][places[0] : places[0] + length].all():
                    places.popleft()
                if places:
                    j = places.popleft()
                    free[0][i : i + length] = free[1][j : j + length] = False
                    out.append((i, j, length))
        bound = length - 1
    return out


def blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Matching blocks in order: the longest common run, earliest in a, then in b, and so on in what is left and right of it."""
    runs, out, todo = Runs(a, b), [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue

        def numbers(length: int, a0=a0, a1=a1, b0=b0, b1=b1):
            return runs.numbers(length, np.arange(a0, a1 - length + 1), False), runs.numbers(length, np.arange(b0, b1 - length + 1), True)

        length = _greatest(1, min(a1 - a0, b1 - b0), lambda n: np.isin(*numbers(n)).any())  # noqa: B023
        if length:
            p, q = numbers(length)
            i = int(np.flatnonzero(np.isin(p, q))[0])
            j = int(np.flatnonzero(q == p[i])[0])
            out.append((a0 + i, b0 + j, length))
            todo += [(a0, a0 + i, b0, b0 + j), (a0 + i + length, a1, b0 + j + length, b1)]
    return sorted(out)


def _array(x) -> np.ndarray:
    return np.asarray(x, dtype=object)


def _pairwise(kind: DataType, measure):
    """A function of two columns; null if either is."""

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else measure(_array(x), _array(y)) for x, y in zip(a, b)], dtype=object if isinstance(kind, IntegerType) else "float64")

    return run


def covered(least: int = LEAST_TILE):
    """Column function of two token arrays: tokens of each that tiles cover; null if either array is."""
    return _pairwise(IntegerType(), lambda a, b: sum(t[2] for t in tiles(a, b, least)))


#: Column function of two token arrays: twice the tokens in matching blocks over all tokens; not symmetric.
sequence_ratio = _pairwise(DoubleType(), lambda a, b: 2 * sum(t[2] for t in blocks(a, b)) / (len(a) + len(b)) if len(a) + len(b) else 1.0)


def token_deltas(a: Column, b: Column, dice: Column) -> Column:
    """array of struct(metric, status, value): 1 less the likeness, by counted tokens and by matching blocks."""
    one = lambda name, value: F.struct(F.lit(name).alias("metric"), F.when(value.isNull(), "unavailable").otherwise("measured").alias("status"), (1 - value).alias("value"))
    return F.array(one("token_multiset_dice", dice), one("token_sequence_ratio", sequence_ratio(a, b)))


def _share(a: Column, b: Column, n: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(a.isNotNull() & b.isNotNull() & (total > 0), 2.0 * n / total)


def tiling_similarity(a: Column, b: Column, least: int = LEAST_TILE) -> Column:
    """Twice the tokens that tiles cover over all tokens of two arrays; null if either is, or both are empty."""
    return _share(a, b, covered(least)(a, b))


def tiled(pairs: DataFrame, least: int = LEAST_TILE) -> DataFrame:
    """``pairs`` (a, b: token arrays) with covered and similarity: twice the covered tokens over all tokens.

    Arrays that are null, or both empty, have no similarity. Rows stay where they are: there is no shuffle.
    """
    out = pairs.withColumn("covered", covered(least)("a", "b"))
    return out.withColumn("similarity", _share(F.col("a"), F.col("b"), F.col("covered")))


def measured_pairs(rows: DataFrame, *keys: str, value: str = "similarity") -> DataFrame:
    """(keys, status, value, reason): a measurement counts only where a key has exactly one; a value outside 0 to 1 is an error."""
    one = F.when((F.count("*") == 1) & (F.count(value) == 1), F.max(value))
    out = rows.groupBy(*keys).agg(one.alias("value"))
    bad = (F.col("value") < 0) | (F.col("value") > 1) | F.isnan("value")
    out = out.withColumn("value", F.when(bad, F.raise_error(F.concat(F.lit("a similarity outside 0 to 1: "), F.col("value").cast("string")))).otherwise(F.col("value")))
    return out.select(*keys, F.when(F.col("value").isNull(), "unavailable").otherwise("measured").alias("status"), "value", F.when(F.col("value").isNull(), "pair_not_measured").alias("reason"))


# Trees

#: Elements of pages that have no end tag.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
_HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"


def page_events(html: Column) -> Column:
    """Events of a page's tree: ``<name`` opens a node, ``>name`` closes it, ``=name`` is a leaf; text, scripts and styles are left out."""
    tags = F.regexp_extract_all(F.regexp_replace(html, _HIDDEN, ""), F.lit(r"""</?[A-Za-z][A-Za-z0-9]*(?:[^>"']|"[^"]*"|'[^']*')*+>"""), F.lit(0))
    name = lambda t: F.lower(F.regexp_extract(t, "^</?([A-Za-z0-9]+)", 1))
    return F.transform(tags, lambda t: F.concat(F.when(t.startswith("</"), ">").when(name(t).isin(VOID) | t.endswith("/>"), "=").otherwise("<"), name(t)))


# Brackets that open and close, and words that a tree keeps as they are.
_OPEN, _CLOSE = ["(", "[", "{"], [")", "]", "}"]
_KEYWORDS = "if else for while do switch case default return break continue struct class enum union namespace using template typename const static void int long short char bool float double auto true false nullptr sizeof new delete".split()


def source_events(tokens: Column) -> Column:
    """Events of C-like source from its tokens: brackets nest; identifiers are all alike; literals, words and operators keep their text, separators go."""
    label = lambda t: F.when(t.rlike("^[A-Za-z_]") & ~t.isin(_KEYWORDS), "identifier").otherwise(t)
    close = lambda t: F.when(t == ")", "(").when(t == "]", "[").otherwise("{")
    return F.transform(F.filter(tokens, lambda t: ~t.isin(",", ";")), lambda t: F.when(t.isin(_OPEN), F.concat(F.lit("<"), t)).when(t.isin(_CLOSE), F.concat(F.lit(">"), close(t))).otherwise(F.concat(F.lit("="), label(t))))


def tree(events) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(labels, leftmost leaves, errors, missing) of a tree in post-order, under one root.

    An end that nothing opened is an error; nodes that their parent's end closes are missing theirs.
    """
    labels, first, errors, missing, open_, names = [], [], 0, 0, [], Counter()

    def close() -> None:
        label, start = open_.pop()
        names[label] -= 1
        first.append(start if start < len(labels) else len(labels))
        labels.append(label)

    for event in events:
        kind, label = event[0], event[1:]
        if kind == "<":
            open_.append((label, len(labels)))
            names[label] += 1
        elif kind == "=":
            first.append(len(labels))
            labels.append(label)
        elif names[label]:
            while open_[-1][0] != label:
                close()
                missing += 1
            close()
        else:
            errors += 1
    missing += len(open_)
    while open_:
        close()
    return np.array([*labels, "root"], object), np.array([*first, 0]), errors, missing


#: Cells of the rows of distances between forests that are kept at once, more than which a single key root may need.
_CELLS = 1 << 19
#: Cells of the distances between trees that are held in memory; more lie in a file.
_HELD = 1 << 25


def _numbers(labels: np.ndarray, first: np.ndarray, known: dict) -> list[int]:
    """A number for the tree of each node: equal numbers, equal trees."""
    out, open_ = [], []
    for label, start in zip(labels.tolist(), first.tolist()):
        kids = []
        while open_ and open_[-1][0] >= start:
            kids.append(open_.pop()[1])
        out.append(known.setdefault((label, *kids), len(known)))
        open_.append((start, out[-1]))
    return out


def _differing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[tuple, tuple]:
    """Two trees without what both begin or end with as long as their roots are alike; their distance stays as it was.

    Some least edit maps like roots to each other, and like trees at the same end of two forests: one that maps nodes of the
    first such tree elsewhere leaves as many of the second without an image. What differs is put under one root each.
    """
    (la, fa), (lb, fb), known = a, b, {}
    p, q = _numbers(la, fa, known), _numbers(lb, fb, known)
    starts = [{}, {}]
    for side, first in zip(starts, (fa, fb)):
        for node, start in enumerate(first.tolist()):
            side.setdefault(start, []).append(node)
    a0, a1, b0, b1 = 0, len(la), 0, len(lb)

    def top(side: dict, low: int, high: int) -> int:
        # The root of the first tree: the last node that begins where the forest does.
        while side[low][-1] >= high:
            side[low].pop()
        return side[low][-1]

    while a1 > a0 and b1 > b0:
        i, j = a1 - 1, b1 - 1
        if p[i] == q[j]:
            a1, b1 = int(fa[i]), int(fb[j])
        elif fa[i] == a0 and fb[j] == b0 and la[i] == lb[j]:
            a1, b1 = i, j
        else:
            i, j = top(starts[0], a0, a1), top(starts[1], b0, b1)
            if p[i] != q[j]:
                break
            a0, b0 = i + 1, j + 1
    return tuple((np.append(labels[low:high], -1), np.append(first[low:high] - low, 0)) for labels, first, low, high in ((la, fa, a0, a1), (lb, fb, b0, b1)))


def _mirrored(labels: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A tree with each node's children in reverse order."""
    at = np.arange(len(first))
    order = np.lexsort((-at, first))[::-1]
    return labels[order], at - (at - first)[order]


def _roots(first: np.ndarray) -> list[int]:
    return sorted((len(first) - 1 - np.unique(first[::-1], return_index=True)[1]).tolist())


def _work(first: np.ndarray) -> int:
    """Nodes of the trees of all key roots."""
    roots = np.array(_roots(first))
    return int((roots - first[roots] + 1).sum())


def _table(rows: int, columns: int) -> np.ndarray:
    """Distances of all pairs of trees; many of them lie in a file that goes with the table, so that the task's memory is bounded."""
    if rows * columns <= _HELD:
        return np.zeros((rows, columns), np.int32)
    with tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as file:
        return np.asarray(np.memmap(file, np.int32, "w+", shape=(rows, columns)))


def _root_groups(first: np.ndarray, most: int) -> list[list[list[int]]]:
    """A tree's key roots in groups of up to ``most`` columns, each a list of levels: key roots that others hold are on lower levels, and not in later groups."""
    inner, levels = np.zeros(len(first), np.int64), {}
    for j in _roots(first):
        inner[first[j] : j + 1] = level = int(inner[first[j] : j + 1].max()) + 1
        levels.setdefault(level, []).append(j)
    groups, room = [], 0
    for level in sorted(levels):
        for j in levels[level]:
            size = int(j - first[j]) + 2
            if size > room:
                groups.append([])
                room = max(most, size)
            room -= size
            if not groups[-1] or groups[-1][-1][0] != level:
                groups[-1].append((level, []))
            groups[-1][-1][1].append(j)
    return [[js for _, js in group] for group in groups]


def tree_distance(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Edit distance of two ordered trees (labels, leftmost leaves), in post-order: insertions, deletions and renames cost 1.

    Zhang and Shasha's programme over key roots, from the left or from the right, whichever is less work. The columns of many key
    roots of the second tree stand side by side, so that a node of the first is a few array operations for all of them; only on the
    left path of a key root, whose distances are being worked out, levels of nested key roots go one after the other.
    """
    codes = pd.factorize(np.concatenate([a[0], b[0]]))[0]
    both = _differing((codes[: len(a[0])], a[1]), (codes[len(a[0]) :], b[1]))
    if min(len(labels) for labels, _ in both) == 1:
        return max(len(labels) for labels, _ in both) - 1
    # The distance is symmetric, and that of the mirrored trees: the fewest cells, and of the two the fewer as rows.
    ways = [[(_work(tree[1]), tree) for tree in trees] for trees in (both, [_mirrored(*tree) for tree in both])]
    (_, (la, fa)), (_, (lb, fb)) = sorted(min(ways, key=lambda way: way[0][0] * way[1][0]), key=lambda side: side[0])
    trees, roots = _table(len(la), len(lb)), _roots(fa)
    # Key roots that hold a node: for each a row is kept.
    ends = np.bincount(fa[roots], minlength=len(fa) + 1) - np.bincount(np.array(roots) + 1, minlength=len(fa) + 1)
    for group in _root_groups(fb, _CELLS // (int(ends.cumsum().max()) + 2)):
        _forests(la, fa, lb, fb, trees, roots, group)
    return int(trees[-1, -1])


def _forests(la: np.ndarray, fa: np.ndarray, lb: np.ndarray, fb: np.ndarray, trees: np.ndarray, roots: list[int], group: list[list[int]]) -> None:
    """Distances of all trees of the first to those on the left paths of a group's key roots, put into ``trees``."""
    columns, parts, width = [], [], 0
    for level in group:
        begin = width
        for j in level:
            at = np.arange(fb[j] - 1, j + 1)
            # By column: its node (the first is the empty forest), the nodes before it, the column before its node's tree, the segment's beginning.
            columns.append((at, np.arange(len(at)), width + np.maximum(fb[at] - fb[j], 0), np.full(len(at), width)))
            width += len(at)
        parts.append((begin, width))
    at, steps, left, segment = (np.concatenate(c) for c in zip(*columns))
    none = steps == 0
    whole, left = (left == segment) & ~none, np.where(none, segment, left)
    label = lb[at]
    # Lowered by this, a segment's entries are under all that stand before it: running minima stay within segments.
    low = steps + np.cumsum(none) * 2 * (len(la) + len(lb) + 2)
    low = low.astype(np.int32 if low.max() < 1 << 30 else np.int64)
    every = slice(0, width), at, np.flatnonzero(none), left, low
    views = [(x, at[x], np.flatnonzero(none[x]), left[x], low[x], np.flatnonzero(whole[x]), at[x][whole[x]]) for x in (slice(*p) for p in parts)]

    key = np.zeros(len(la), bool)
    key[roots] = True
    for i in roots:
        top = int(fa[i])
        above, kept = steps.astype(np.int32), {}
        for node in range(top, i + 1):
            start = int(fa[node])
            if start == node:
                # The row before a tree is kept until the tree that begins here and is the largest is done.
                kept[node] = above
            here, path = np.empty(width, np.int32), start == top
            for cols, nodes, empty, lefts, lower, *own in views if path else [every]:
                row = kept[start][lefts] + trees[node][nodes]
                if path:
                    places = own[0] + cols.start
                    row[own[0]] = above[places - 1] + (label[places] != la[node])
                row = np.minimum(row, above[cols] + 1)
                row[empty] = node - top + 1
                # An insertion costs one more than the entry to the left.
                here[cols] = np.minimum.accumulate(row - lower) + lower
                if path:
                    trees[node, own[1]] = here[places]
            if key[node]:
                del kept[start]
            above = here


_TREES = "status string, value double, ted int, reason string, nodes array<int>, errors array<int>, missing array<int>"


def tree_similarity(limit: int | None = None, strict: bool = True):
    """Column function of two arrays of events: struct(status, value, ted, reason, nodes, errors, missing).

    value is 1 less the distance over the larger tree's nodes, at least 0. Trees of any size are measured, unless a caller's measure has a
    ``limit`` of nodes, beyond which a tree is ``tree_too_large``; with ``strict`` one with errors or missing ends is ``parse_invalid``, else ends that lack are taken to be implied. A null side is ``missing_side``.
    """

    def one(x, y):
        if x is None or y is None:
            return ("unavailable", None, None, "missing_side", None, None, None)
        both = [tree(e) for e in (x, y)]
        nodes, errors, missing = ([int(f(t)) for t in both] for f in (lambda t: len(t[0]), lambda t: t[2], lambda t: t[3]))
        reason = "tree_too_large" if limit is not None and max(nodes) > limit else "parse_invalid" if strict and any(errors + missing) else None
        if reason:
            return ("unavailable", None, None, reason, nodes, errors, missing)
        ted = tree_distance(both[0][:2], both[1][:2])
        return ("measured", max(0.0, 1 - ted / max(nodes)), ted, None, nodes, errors, missing)

    @F.pandas_udf(_TREES)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        names = [p.split()[0] for p in _TREES.split(", ")]
        return pd.DataFrame([one(x, y) for x, y in zip(a, b)], columns=names).astype({"ted": "Int32"})

    return run
