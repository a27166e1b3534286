"""Digests that tie records together: chains of records, tables as multisets, and inventories as trees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rondel.operators.audits import inventory_differences

#: Records of a chain that one task looks at together.
RANGE = 100_000


def link_digest(previous: Column, payload: Column) -> Column:
    """What a record's digest has to be: it covers its predecessor's digest (empty for the first) and its own payload."""
    return F.sha2(F.concat(F.coalesce(previous, F.lit("")), F.lit("\n"), F.coalesce(payload, F.lit(""))), 256)


def sealed_chain(records: DataFrame) -> DataFrame:
    """``records`` (chain, seq, payload) with digest, each covering its predecessor's; for chains that fit a row."""
    step = lambda a, r: F.concat(a, F.array(F.struct(r["seq"].alias("seq"), r["payload"].alias("payload"), link_digest(F.try_element_at(a, F.lit(-1))["digest"], r["payload"]).alias("digest"))))
    kinds = {f.name: f.dataType.simpleString() for f in records.schema}
    none = F.array().cast(f"array<struct<seq:{kinds['seq']},payload:{kinds['payload']},digest:string>>")
    folded = records.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("r"))
    return folded.select("chain", F.explode(F.aggregate("r", none, step)).alias("x")).select("chain", "x.*")


def broken_links(records: DataFrame, rows: int = RANGE) -> DataFrame:
    """(chain, seq, fault) of every record that doesn't follow its predecessor.

    ``records``: (chain, seq, payload, digest). Faults: ``duplicate_number``, ``gap`` (its predecessor is lost), ``digest`` (it doesn't cover its
    predecessor's digest and its payload; also if it has none). Ranges of ``rows`` numbers are looked at apart from each other, and each range's first record
    meets the last one before it in a second step, so a chain of any length is no single task. A null chain is a chain; records without a number are ``unnumbered``.
    """
    kept = records.select("chain", "seq", "payload", "digest")
    numbered = kept.filter("seq is not null").withColumn("range", F.floor(F.col("seq") / rows))
    order = Window.partitionBy("chain", "range").orderBy("seq", "digest")
    inside = numbered.withColumns({"before": F.lag("digest").over(order), "before_seq": F.lag("seq").over(order)})
    ends = numbered.groupBy("chain", "range").agg(F.max(F.struct("seq", "digest")).alias("last"))
    edge = ends.withColumn("last", F.lag("last").over(Window.partitionBy("chain").orderBy("range"))).withColumnsRenamed({"chain": "chain_", "range": "range_"})
    joined = inside.join(edge, F.col("chain").eqNullSafe(F.col("chain_")) & (F.col("range") == F.col("range_")), "left")
    first = F.col("before_seq").isNull()
    before, before_seq = F.when(first, F.col("last.digest")).otherwise(F.col("before")), F.when(first, F.col("last.seq")).otherwise(F.col("before_seq"))
    fault = (
        F.when(F.col("seq") == before_seq, "duplicate_number").when(F.col("seq") > before_seq + 1, "gap")
        .when(~F.coalesce(F.col("digest") == link_digest(before, F.col("payload")), F.lit(False)), "digest")
    )
    unnumbered = kept.filter("seq is null").select("chain", "seq", F.lit("unnumbered").alias("fault"))
    return joined.select("chain", "seq", fault.alias("fault")).filter("fault is not null").unionByName(unnumbered)


def row_text(columns: list[str]) -> Column:
    """A row as text that no other row has: each column's name, length and value, or that it is null."""
    one = lambda c: F.coalesce(F.concat(F.lit(f"{c}="), F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit(f"{c}-"))
    return F.concat_ws(";", *[one(c) for c in sorted(columns)])


def multiset_digest(df: DataFrame, *parts: str) -> DataFrame:
    """(parts, rows, digest) of the rows of each part, whatever their order: rows that repeat count, and a row that changes shows.

    The digest is the number of rows and four sums, each of a quarter of the rows' 128-bit digests, so it is made of partial sums.
    """
    text = F.sha2(row_text(df.columns), 256)
    quarters = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(4)]
    out = df.select(*parts, text.alias("h")).groupBy(*parts).agg(F.count("*").alias("rows"), *quarters)
    return out.select(*parts, "rows", F.concat_ws("-", *[F.col(f"s{i}").cast("string") for i in range(4)]).alias("digest"))


def rebuilt_differences(first: DataFrame, second: DataFrame, *parts: str) -> DataFrame:
    """(parts, fault, rows, rows_again) of the parts in which two builds of a table differ: missing, unexpected or changed."""
    a, b = multiset_digest(first, *parts), multiset_digest(second, *parts)
    same = None
    for p in parts:
        same = F.col(f"a.{p}").eqNullSafe(F.col(f"b.{p}")) if same is None else same & F.col(f"a.{p}").eqNullSafe(F.col(f"b.{p}"))
    joined = a.alias("a").join(b.alias("b"), same, "full_outer")
    fault = F.when(F.col("b.rows").isNull(), "missing").when(F.col("a.rows").isNull(), "unexpected").when((F.col("a.rows") != F.col("b.rows")) | (F.col("a.digest") != F.col("b.digest")), "changed")
    return joined.select(*[F.coalesce(f"a.{p}", f"b.{p}").alias(p) for p in parts], fault.alias("fault"), F.col("a.rows").alias("rows"), F.col("b.rows").alias("rows_again")).filter("fault is not null")


# Inventories


def bundle(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inventory, store) of ``parts`` (path, content): (path, digest) of each part, and (digest, content) of each content, once."""
    named = parts.select("path", "content", F.sha2("content", 256).alias("digest"))
    return named.select("path", "digest"), named.groupBy("digest").agg(F.first("content").alias("content"))


def tree_depth(leaves: int, each: int = 64) -> int:
    """Levels below the root at which a node has about ``each`` leaves; a node has 16 children."""
    return max(1, math.ceil(math.log(max(leaves, 1) / each, 16))) if leaves > each else 1


def _levels(inventory: DataFrame, depth: int) -> list[DataFrame]:
    """(node, digest) of each level, the root's first. A node is the start of its paths' digests, so that leaves spread evenly."""
    leaves = inventory.select(F.substring(F.sha2("path", 256), 1, depth).alias("node"), F.concat_ws("=", "path", "digest").alias("entry"))
    level = leaves.groupBy("node").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("entry"))), 256).alias("digest"))
    levels = [level]
    for k in range(depth - 1, -1, -1):
        entries = level.select(F.substring("node", 1, k).alias("node") if k else F.lit("").alias("node"), F.concat_ws("=", "node", "digest").alias("entry"))
        level = entries.groupBy("node").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("entry"))), 256).alias("digest"))
        levels.append(level)
    return levels[::-1]


def inventory_tree(inventory: DataFrame, depth: int) -> DataFrame:
    """(level, node, digest): digests over digests up to one root. A node's list is short, as paths are distinct and spread by their digests."""
    out = None
    for k, level in enumerate(_levels(inventory, depth)):
        rows = level.select(F.lit(k).alias("level"), "node", "digest")
        out = rows if out is None else out.unionByName(rows)
    return out


def changed_entries(before: DataFrame, after: DataFrame, trees: tuple[DataFrame, DataFrame], depth: int) -> DataFrame:
    """(path, fault) of inventories that differ, found by going down ``trees`` where digests do.

    Only the entries below nodes that differ are compared.
    """
    differing = None
    for k in range(depth + 1):
        a, b = (t.filter(F.col("level") == k).select("node", F.col("digest").alias(n)) for t, n in zip(trees, "ab"))
        pairs = a.join(b, "node", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("node")
        if differing is not None:
            pairs = pairs.withColumn("above", F.substring("node", 1, k - 1) if k > 1 else F.lit("")).join(differing.withColumnRenamed("node", "above"), "above", "left_semi").select("node")
        differing = pairs
    below = lambda inventory: inventory.withColumn("node", F.substring(F.sha2("path", 256), 1, depth)).join(differing, "node", "left_semi").select("path", "digest")
    return inventory_differences(below(before), below(after), "path", "digest")
