"""Evidence of what was read and written: seals, archives, indexes and stages that are checked when they are used."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rondel.operators.audits import inventory_differences
from rondel.operators.integrity import multiset_digest
from rondel.sources.checked import resolved, under
from rondel.sources.tables import compact_digest

# How an input may be normalised.
NORMALISATIONS = ["tokens", "line"]


def seal(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) of every file below ``root`` but temporary ones, by paths relative to it."""
    return under(spark, root).filter(~F.col("path").endswith(".tmp")).select("path", F.sha2("content", 256).alias("sha256"))


def seal_faults(spark: SparkSession, root: str, sealed: DataFrame) -> DataFrame:
    """(path, fault): files that are missing, unexpected or changed since ``sealed`` was made."""
    return inventory_differences(sealed, seal(spark, root), "path", "sha256")


def archive_faults(parts: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, fault) of an archive's parts (path, size, sha256) against its manifest: missing, unexpected, ``size`` or ``sha256``."""
    a, b = (df.select("path", F.col("size").alias(f"{s}_size"), F.lower("sha256").alias(f"{s}_sha")) for s, df in (("a", manifest), ("b", parts)))
    joined = a.withColumn("told", F.lit(True)).join(b.withColumn("there", F.lit(True)), "path", "full_outer")
    fault = F.when(F.col("there").isNull(), "missing").when(F.col("told").isNull(), "unexpected").when(~F.col("a_size").eqNullSafe(F.col("b_size")), "size").when(~F.col("a_sha").eqNullSafe(F.col("b_sha")), "sha256")
    return joined.select("path", fault.alias("fault")).filter("fault is not null")


def index_faults(index: DataFrame, files: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """(problem, fault) of a dataset index that can't be used.

    ``index``: (problem, directory, manifest, manifest_sha256, normalization), paths relative to the index; ``files``: (path, sha256) of what lies
    below it; ``requested``: (problem). The first fault of a problem counts: ``duplicate_problem``, ``path_escape``, ``unsupported_normalization``,
    ``missing_manifest``, ``manifest_hash_mismatch``, and ``not_in_index`` for a requested problem. An index without a manifest has none to check.
    """
    times = index.groupBy("problem").agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("directory", "manifest", "manifest_sha256", "normalization")])
    rows = times.withColumns({"at": resolved(F.col("directory")), "manifest_at": resolved(F.col("manifest"))})
    rows = rows.join(files.select(F.col("path").alias("manifest_at"), F.col("sha256").alias("actual")), "manifest_at", "left")
    told = F.col("manifest").isNotNull()
    fault = (
        F.when(F.col("times") > 1, "duplicate_problem").when(F.col("at").isNull() | (told & F.col("manifest_at").isNull()), "path_escape")
        .when(~F.coalesce("normalization", F.lit("tokens")).isin(NORMALISATIONS), "unsupported_normalization")
        .when(told & F.col("actual").isNull(), "missing_manifest").when(told & ~F.coalesce(F.col("actual") == F.lower("manifest_sha256"), F.lit(False)), "manifest_hash_mismatch")
    )
    out = rows.select("problem", fault.alias("fault")).filter("fault is not null")
    if requested is None:
        return out
    return out.unionByName(requested.select("problem").join(index.select("problem").distinct(), "problem", "left_anti").select("problem", F.lit("not_in_index").alias("fault")))


def checked_stage(spark: SparkSession, root: str, contract: dict, build) -> DataFrame:
    """The table of this contract, built once; a stored one whose rows are no longer those that were built is an error.

    Its digest, of rows in any order, is stored beside it after the table is complete, so a build that broke off is done again.
    """
    path = f"{root}/{compact_digest(contract)}"
    try:
        told = spark.read.parquet(f"{path}-digest").first()
        table = spark.read.parquet(path)
    except AnalysisException:
        build(spark).write.mode("overwrite").parquet(path)
        table = spark.read.parquet(path)
        multiset_digest(table).write.mode("overwrite").parquet(f"{path}-digest")
        return table
    if told != multiset_digest(table).first():
        raise ValueError(f"{path} doesn't hold the rows that were built")
    return table


def figure_inputs(rows: DataFrame, figure: str, series: str, x: str, y: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """(figure, series, x, y, low, high) of a figure's points, as text and numbers; points without a value are left out."""
    bound = lambda c: (F.col(c) if c else F.lit(None)).cast("double")
    return rows.filter(F.col(y).isNotNull()).select(F.lit(figure).alias("figure"), F.col(series).cast("string").alias("series"), F.col(x).cast("string").alias("x"), F.col(y).cast("double").alias("y"), bound(low).alias("low"), bound(high).alias("high"))
