"""Orders of planned work: keyed permutations, balanced rotations and shards, without a list on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rondel.sources.tables import written

_ROUNDS, _WALKS = 6, 128


def _drawn(key: str, round_: int, value: Column, size: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{key}:{round_}:"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") % size


def permuted(index: Column, n: int, key: str) -> Column:
    """Where a keyed permutation of 0 .. n-1 puts ``index``: a bijection, worked out for each row by itself.

    A number is a pair of digits below a and b with a*b >= n; rounds add to each digit what the key draws from the other one. Pairs that are no
    number below n are walked through; there are fewer than a of them, so for n up to 16,384 the walk always ends in time, and beyond
    that the chance that it doesn't is below n^-64; then it is an error.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))

    def once(value: Column, change) -> Column:
        # A lambda's variable is worked out once, however often ``change`` uses it.
        return F.transform(F.array(value), lambda x: change(x))[0]

    def left(i: int):
        return lambda p: F.struct(((p["l"] + _drawn(key, i, p["r"], a)) % a).alias("l"), p["r"].alias("r"))

    def right(i: int):
        return lambda p: F.struct(p["l"].alias("l"), ((p["r"] + _drawn(key, i, p["l"], b)) % b).alias("r"))

    def step(x: Column) -> Column:
        pair = F.struct(F.floor(x / b).cast("bigint").alias("l"), (x % b).alias("r"))
        for i in range(0, _ROUNDS, 2):
            pair = once(once(pair, left(i)), right(i + 1))
        return once(pair, lambda p: p["l"] * b + p["r"])

    walks = min(a * b - n, _WALKS)
    found = step(index.cast("bigint"))
    if walks:
        found = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), found, lambda x, _: F.when(x < n, x).otherwise(step(x)))
        found = F.when(found < n, found).otherwise(F.raise_error(F.lit("a walk was too long")).cast("bigint"))
    return found


def numbered(rows: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """``rows`` with their places 0, 1, ... in ``order``, found from sorted ranges and the ranges' sizes, not by one task.

    Rows that are equal in ``order`` have any order among themselves.
    """
    held = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    held = written(held, "numbered")
    part = F.shiftright("__at", 33)
    sizes = held.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))
    # One row for each range.
    before = sizes.withColumn("__before", F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).select("__part", "__before")
    joined = held.withColumn("__part", part).join(F.broadcast(before), "__part")
    return joined.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__before")


def shuffled(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` with position: a permutation that ``key`` and the rows' order tell."""
    held = written(numbered(rows, *order), "ordered")
    return held.withColumn("position", permuted(F.col("index"), held.count(), key)).drop("index")


def shard(rows: DataFrame, which: str, position: str = "position") -> DataFrame:
    """The rows of shard i of k (``i/k``, from 1): every k-th, beginning with the i-th."""
    try:
        i, k = (int(part) for part in which.split("/"))
    except ValueError:
        raise ValueError("a shard is told as i/k") from None
    if not 1 <= i <= k:
        raise ValueError("a shard i/k has 1 <= i <= k")
    return rows.filter(F.col(position) % k == i - 1)


def rotated(problems: DataFrame, targets: list[str], repeats: int, balanced: bool = True) -> DataFrame:
    """(problem, repeat, slot, target) from ``problems`` (problem, position): each problem's targets in turn, begun one later for each problem and repeat.

    With as many repeats as targets, every target has every slot of a problem once. Without ``balanced`` targets keep their order.
    """
    of = F.array(*[F.lit(t) for t in targets])
    each = problems.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(len(targets) - 1))))
    shift = F.col("position") + F.col("repeat") - 1 if balanced else F.lit(0)
    return each.select("problem", "repeat", "slot", F.element_at(of, ((shift + F.col("slot")) % len(targets) + 1).cast("int")).alias("target"))
