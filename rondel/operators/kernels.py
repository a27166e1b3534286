"""Small algorithm kernels as set operations, windows and folds.

Sequence kernels take (case_id, i, x): the elements of each case by position. Set
kernels shuffle by case; folds run inside one row's array.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from rondel.sources.tables import written

CASE = "case_id"


def _case(order: str = "i"):
    return Window.partitionBy(CASE).orderBy(order)


def _all_before(order: str = "i"):
    return _case(order).rowsBetween(Window.unboundedPreceding, 0)


def _all_after(order: str = "i"):
    return _case(order).rowsBetween(0, Window.unboundedFollowing)


def palindrome(text: Column) -> Column:
    return F.reverse(text) == text


def trapped_rain(rows: DataFrame) -> DataFrame:
    """Water over each bar: the lower of the highest bars on both sides, less the bar."""
    level = F.least(F.max("x").over(_all_before()), F.max("x").over(_all_after())) - F.col("x")
    return rows.withColumn("water", level).groupBy(CASE).agg(F.sum("water").alias("water"))


def dictionary_lookup(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """Numbers to names and names to numbers, by two equi-joins."""
    by_number = queries.join(entries.select(F.col("number").cast("string").alias("query"), F.col("name").alias("answer")), "query")
    by_name = queries.join(entries.select(F.col("name").alias("query"), F.col("number").cast("string").alias("answer")), "query")
    return by_number.unionByName(by_name)


def compressed_coordinates(rows: DataFrame) -> DataFrame:
    """Place of each value among the case's distinct values."""
    return rows.withColumn("place", F.dense_rank().over(_case("x")) - 1)


def primes(spark: SparkSession, low: int, high: int) -> DataFrame:
    """Numbers of [low, high] without a divisor up to the root of high."""
    numbers = spark.range(max(low, 2), high + 1).withColumnRenamed("id", "n")
    root = int(high**0.5) + 1
    # Multiples are made from the small factors, so nothing is compared pairwise.
    composite = spark.range(2, root + 1).select(F.explode(F.sequence(F.col("id") * F.greatest(F.col("id"), F.floor((F.lit(low) + F.col("id") - 1) / F.col("id"))), F.greatest(F.lit(high), F.col("id") * F.col("id")), F.col("id"))).alias("n"))
    return numbers.join(composite.distinct(), "n", "left_anti")


def sum_targets(rows: DataFrame, target: int) -> DataFrame:
    """Number of subarrays whose sum is the target: for each prefix sum, how many earlier ones are less by the target.

    A task passes over its cases in order, with the counts of one case's prefix sums; it keeps no table of all sums.
    """

    def fold(batches):
        last = ()
        for batch in batches:
            cases, found = [], []
            for case, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (case,) != last:
                    if last:
                        cases.append(last[0])
                        found.append(n)
                    # The empty sum comes before all; a null adds nothing, and before the first number there is no sum.
                    last, seen, total, n, begun = (case,), {0: 1}, 0, 0, False
                if x is not None:
                    total, begun = total + x, True
                if begun and case is not None:
                    n += seen.get(total - target, 0)
                    seen[total] = seen.get(total, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(cases, pa.int64()), pa.array(found, pa.int64())], names=[CASE, "n"])
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([n], pa.int64())], names=[CASE, "n"])

    ordered = rows.select(F.col(CASE).cast("long"), F.col("x").cast("long"), "i").repartition(CASE).sortWithinPartitions(CASE, "i")
    return ordered.mapInArrow(fold, f"{CASE} bigint, n bigint")


def rope_load(rows: DataFrame) -> DataFrame:
    """Largest weight that some ropes bear: a rope's load times the ropes at least as strong."""
    strong = F.row_number().over(Window.partitionBy(CASE).orderBy(F.desc("x"), "i"))
    return rows.withColumn("w", F.col("x") * strong).groupBy(CASE).agg(F.max("w").alias("load"))


def stairs(values: Column) -> Column:
    """Largest sum over stairs, never three in a row, the last always taken."""
    start = F.struct(F.lit(0).cast("double").alias("skip2"), F.lit(0).cast("double").alias("one"), F.lit(0).cast("double").alias("two"), F.lit(0).cast("double").alias("best1"))

    def step(a: Column, x: Column) -> Column:
        one = a["skip2"] + x
        two = a["one"] + x
        return F.struct(a["best1"].alias("skip2"), one.alias("one"), F.when(a["one"] == 0, one).otherwise(two).alias("two"), F.greatest(one, two).alias("best1"))

    return F.aggregate(F.transform(values, lambda v: v.cast("double")), start, step, lambda a: a["best1"])


def two_hop_friends(edges: DataFrame) -> DataFrame:
    """Per person: who can be reached over one friend or two, without themselves."""
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").filter("a <> b").distinct()
    far = both.alias("x").join(both.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b")).filter("a <> b")
    return both.union(far).distinct().groupBy("a").agg(F.count("*").alias("n"))


def balanced(text: Column) -> Column:
    """Parentheses never close more than are open, and end at none."""
    depth = F.aggregate(
        F.split(text, ""), F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")),
        lambda a, c: F.struct((a["d"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("d"), (a["ok"] & (a["d"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0) >= 0)).alias("ok")),
    )
    return depth["ok"] & (depth["d"] == 0)


def two_sum(rows: DataFrame, target: Column) -> DataFrame:
    """First pair of positions whose values add up to the target, by an equi-join on what is lacking."""
    a, b = rows.withColumn("need", target - F.col("x")).alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col(f"a.{CASE}") == F.col(f"b.{CASE}")) & (F.col("a.need") == F.col("b.x")) & (F.col("a.i") < F.col("b.i")))
    return pairs.groupBy(F.col(f"a.{CASE}").alias(CASE)).agg(F.min(F.struct(F.col("a.i").alias("i"), F.col("b.i").alias("j"))).alias("p")).select(CASE, "p.i", "p.j")


def best_trade(rows: DataFrame) -> DataFrame:
    """Largest rise from an earlier value; 0 if there is none."""
    return rows.withColumn("gain", F.col("x") - F.min("x").over(_all_before())).groupBy(CASE).agg(F.max("gain").alias("profit"))


def has_duplicate(rows: DataFrame) -> DataFrame:
    return rows.groupBy(CASE).agg((F.count("x") > F.count_distinct("x")).alias("duplicate"))


def largest_subarray(rows: DataFrame) -> DataFrame:
    """Prefix sum less the least one before it."""
    prefix = rows.withColumn("p", F.sum("x").over(_all_before()))
    before = F.coalesce(F.min("p").over(_case().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return prefix.withColumn("s", F.col("p") - F.least(before, F.lit(0))).groupBy(CASE).agg(F.max("s").alias("largest"))


def insert_position(rows: DataFrame, target: Column) -> DataFrame:
    return rows.groupBy(CASE).agg(F.count_if(F.col("x") < target).alias("position"))


def moved_zeroes(values: Column) -> Column:
    return F.concat(F.filter(values, lambda x: x != 0), F.filter(values, lambda x: x == 0))


def anagram(a: Column, b: Column) -> Column:
    return F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))


def first_unique(characters: DataFrame) -> DataFrame:
    """Place of the first character that occurs once; null if none does."""
    once = characters.groupBy(CASE, "x").agg(F.count("*").alias("n"), F.min("i").alias("i"))
    return once.groupBy(CASE).agg(F.min(F.when(F.col("n") == 1, F.col("i"))).alias("i"))


def longest_distinct(characters: DataFrame) -> DataFrame:
    """Longest run without a repetition: up to here from after the latest place that a character so far repeats from."""
    last = F.lag("i").over(Window.partitionBy(CASE, "x").orderBy("i"))
    marked = characters.withColumn("last", F.coalesce(last, F.lit(-1)))
    return marked.withColumn("n", F.col("i") - F.max("last").over(_all_before())).groupBy(CASE).agg(F.max("n").alias("longest"))


def unique_paths(rows: Column, columns: Column) -> Column:
    """Paths through a grid: a binomial coefficient by a product that stays whole."""
    steps = F.sequence(F.lit(1), F.greatest(rows - 1, F.lit(1)))
    value = F.aggregate(steps, F.lit(1).cast("decimal(38,0)"), lambda a, k: (a * (columns - 1 + k) / k).cast("decimal(38,0)"))
    return F.when((rows <= 1) | (columns <= 1), 1).otherwise(value.cast("long"))


def next_greater(rows: DataFrame) -> DataFrame:
    """distance to the next larger element, and its value; null if there is none, or no case.

    A task passes over its cases from their ends with a stack, in time proportional to its rows, however
    many cases there are and however long one is; a range join would compare all pairs.
    """

    def fold(batches):
        case, stack = None, []
        for batch in batches:
            distance, value = [], []
            for of, i, x in zip(*(c.to_pylist() for c in batch.columns)):
                if of != case:
                    case, stack = of, []
                while stack and x is not None and stack[-1][1] <= x:
                    stack.pop()
                known = stack and x is not None and of is not None
                distance.append(stack[-1][0] - i if known else None)
                value.append(stack[-1][1] if known else None)
                if x is not None:
                    stack.append((i, x))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(distance, pa.int64()), pa.array(value, pa.float64())], names=[CASE, "i", "distance", "value"])

    ordered = rows.select(F.col(CASE).cast("long"), F.col("i").cast("long"), F.col("x").cast("double")).repartition(CASE).sortWithinPartitions(CASE, F.desc("i"))
    return ordered.mapInArrow(fold, f"{CASE} bigint, i bigint, distance bigint, value double")


def bit_counts(n: Column) -> Column:
    return F.bit_count(n)


def gcd_lcm(a: Column, b: Column) -> Column:
    """struct(gcd, lcm) by Euclid's steps, of which 64-bit numbers need fewer than 100."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(96)), start, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0))).alias("b"))))
    return F.struct(end["a"].alias("gcd"), (a / end["a"] * b).cast("long").alias("lcm"))


def nth_with(spark: SparkSession, digits: str, n: int, limit: int) -> DataFrame:
    """The n-th number under ``limit`` that holds the digits."""
    found = spark.range(limit).filter(F.col("id").cast("string").contains(digits))
    return found.orderBy("id").offset(n - 1).limit(1).withColumnRenamed("id", "n")


def hanoi(n: int, spark: SparkSession) -> DataFrame:
    """(move, disc, source, target) of the shortest solution, each move from the bits of its number."""
    moves = spark.range(1, 1 << n).withColumnRenamed("id", "move")
    disc = F.bit_count(F.col("move").bitwiseXOR(F.col("move") - 1))
    turn = F.floor(F.col("move") / F.pow(F.lit(2), disc)).cast("long")
    sign = F.when((F.lit(n) - disc) % 2 == 0, 2).otherwise(1)
    source = (turn * sign) % 3
    return moves.select("move", disc.alias("disc"), source.alias("source"), ((source + sign) % 3).alias("target"))


def queens(spark: SparkSession, n: int) -> DataFrame:
    """Number of placements of n queens, one row of the board after another."""
    boards = spark.createDataFrame([([],)], "q array<int>")
    for row in range(n):
        grown = boards.select("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("c"))
        clash = F.exists(F.transform("q", lambda x, i: (x == F.col("c")) | (F.abs(x - F.col("c")) == row - i)), lambda x: x)
        boards = grown.filter(~clash).select(F.concat("q", F.array("c")).alias("q"))
    return boards.agg(F.count("*").alias("n"))


def quadtree(cells: DataFrame, size: int) -> DataFrame:
    """(ones, zeros): uniform squares of a bitmap (r, c, v), merged bottom up by 2 x 2 groups; size a power of 2."""
    level = cells.select("r", "c", F.col("v").cast("int").alias("v"), F.when(F.col("v") == 1, 1).otherwise(0).alias("ones"), F.when(F.col("v") == 0, 1).otherwise(0).alias("zeros"))
    while size > 1:
        size //= 2
        merged = level.groupBy((F.floor(F.col("r") / 2)).alias("r"), (F.floor(F.col("c") / 2)).alias("c")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
        same = (F.col("low") == F.col("high")) & (F.col("low") >= 0)
        level = merged.select("r", "c", F.when(same, F.col("low")).otherwise(-1).alias("v"), F.when(same, F.col("low")).otherwise(F.col("ones")).alias("ones"), F.when(same, 1 - F.col("low")).otherwise(F.col("zeros")).alias("zeros"))
    return level.select("ones", "zeros")


def router_gap(positions: Column, routers: int) -> Column:
    """Largest least gap of so many routers: binary search over gaps, each tried by a greedy fold."""
    ordered = F.array_sort(positions)
    span = ordered[F.size(ordered) - 1] - ordered[0]

    def placed(gap: Column) -> Column:
        start = F.struct(F.lit(1).alias("n"), ordered[0].alias("at"))
        return F.aggregate(ordered, start, lambda a, x: F.when(x - a["at"] >= gap, F.struct((a["n"] + 1).alias("n"), x.alias("at"))).otherwise(a))["n"]

    def step(a: Column, _: Column) -> Column:
        middle = F.floor((a["low"] + a["high"] + 1) / 2)
        fits = placed(middle) >= routers
        return F.when(a["low"] >= a["high"], a).otherwise(F.struct(F.when(fits, middle).otherwise(a["low"]).alias("low"), F.when(fits, a["high"]).otherwise(middle - 1).alias("high")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(F.lit(0).cast("long").alias("low"), span.cast("long").alias("high")), step)["low"]


def change_ways(coins: Column, amount: int) -> Column:
    """Ways to pay the amount: a fold over coins of a fold over amounts."""
    start = F.concat(F.array(F.lit(1).cast("long")), F.array_repeat(F.lit(0).cast("long"), amount))

    def with_coin(ways: Column, coin: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(amount)), F.array().cast("array<bigint>"), lambda done, v: F.concat(done, F.array(ways[v] + F.when(v >= coin, F.coalesce(F.get(done, v - coin), F.lit(0).cast("long"))).otherwise(0))))

    return F.element_at(F.aggregate(coins, start, with_coin), amount + 1)


def word_break(text: Column, dictionary: list[str]) -> Column:
    """Whether the text is a sequence of dictionary words: a fold over end places."""
    def reach(done: Column, end: Column) -> Column:
        hits = [F.when(F.get(done, end - len(w)) & (F.substring(text, end - len(w) + 1, F.lit(len(w))) == w), True).otherwise(False) for w in dictionary]
        any_hit = hits[0]
        for h in hits[1:]:
            any_hit = any_hit | h
        return F.concat(done, F.array(F.coalesce(any_hit, F.lit(False))))

    return F.when(F.length(text) == 0, True).otherwise(F.element_at(F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), F.array(F.lit(True)), reach), -1))


def grid_fold(grid: Column, kind: str) -> Column:
    """``paths``: ways through a grid whose 1s are obstacles; ``cost``: the least sum, moving right and down."""
    paths = kind == "paths"
    width = F.size(grid[0])
    if paths:
        start = F.concat(F.array(F.lit(1).cast("long")), F.array_repeat(F.lit(0).cast("long"), width - 1))
        cell = lambda up, left, x: F.when(x == 1, F.lit(0).cast("long")).otherwise(up + F.coalesce(left, F.lit(0).cast("long")))
    else:
        start = F.concat(F.array(F.lit(0).cast("long")), F.array_repeat(F.lit(1 << 60).cast("long"), width - 1))
        cell = lambda up, left, x: F.least(up, F.coalesce(left, F.lit(1 << 60).cast("long"))) + x.cast("long")

    def row(above: Column, values: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), width - 1), F.array().cast("array<bigint>"), lambda done, c: F.concat(done, F.array(cell(above[c], F.when(c > 0, F.get(done, c - 1)), values[c]))))

    return F.element_at(F.aggregate(grid, start, row), -1)


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): least node of each component, by rounds of least labels and jumps; tables are cut each round."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("a", "b").distinct(), "edges")
    labels = written(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("next"), "label")
        jump = step.select(F.col("node").alias("at"), F.col("next").alias("far"))
        moved = written(step.join(jump, F.col("next") == F.col("at"), "left").select("node", "label", F.least("next", F.coalesce("far", "next")).alias("next")), "labels")
        labels = moved.select("node", F.col("next").alias("label"))
        if moved.filter("next <> label").isEmpty():
            return labels


def acyclic(edges: DataFrame) -> bool:
    """Whether all courses can be taken: peel what needs nothing that is left, until nothing peels."""
    left = written(edges.select("course", "needs").distinct(), "peel")
    while True:
        blocked = left.select(F.col("course").alias("needs")).distinct()
        rest = written(left.join(blocked, "needs", "left_semi").select("course", "needs"), "peel")
        n, before = rest.count(), left.count()
        if n == 0 or n == before:
            return n == 0
        left = rest


@F.pandas_udf(ArrayType(IntegerType()))
def josephus(n: pd.Series, k: pd.Series) -> pd.Series:
    def order(n, k):
        ring, at, out = list(range(1, n + 1)), 0, []
        while ring:
            at = (at + k - 1) % len(ring)
            out.append(ring.pop(at))
        return out

    return pd.Series([order(int(a), int(b)) for a, b in zip(n, k)])


@F.pandas_udf(IntegerType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence, one row of the table at a time."""
    def length(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            corner = 0
            for j, d in enumerate(y, 1):
                corner, row[j] = row[j], corner + 1 if c == d else max(row[j], row[j - 1])
        return row[-1]

    return pd.Series([None if x is None or y is None else length(x, y) for x, y in zip(a, b)], dtype="Int32")


@F.pandas_udf(StringType())
def exploded_string(text: pd.Series, bomb: pd.Series) -> pd.Series:
    """The text after all bombs, also those that explosions make, are gone."""
    def burst(text, bomb):
        out = []
        for c in text:
            out.append(c)
            if bomb and c == bomb[-1] and "".join(out[-len(bomb) :]) == bomb:
                del out[-len(bomb) :]
        return "".join(out)

    return pd.Series([None if t is None else burst(t, b or "") for t, b in zip(text, bomb)])
