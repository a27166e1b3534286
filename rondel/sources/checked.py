"""Files that a manifest lists, read by Spark's readers and checked as they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def resolved(path: Column) -> Column:
    """A relative path without ``.`` and ``..``; null if it leaves its root, is absolute or names another store."""
    none = F.array().cast("array<string>")
    state = F.aggregate(
        F.split(path, "/"), F.struct(none.alias("parts"), F.lit(False).alias("out")),
        lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.struct(F.slice(a["parts"], F.lit(1), F.greatest(F.size(a["parts"]) - 1, F.lit(0))).alias("parts"), (a["out"] | (F.size(a["parts"]) == 0)).alias("out"))).otherwise(F.struct(F.concat(a["parts"], F.array(p)).alias("parts"), a["out"].alias("out"))),
    )
    bad = path.startswith("/") | path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | path.contains("\\") | state["out"] | (F.size(state["parts"]) == 0)
    return F.when(~bad, F.array_join(state["parts"], "/"))


def under(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, content) of the files below ``root``, their paths relative to it; ``glob`` is for their names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (files.option("pathGlobFilter", glob) if glob else files).load(root)
    # What comes before the root (scheme and store) is written in several ways, so the path is cut at the root's own.
    own = root.rstrip("/").split("://", 1)[-1].lstrip("/")
    own = own.split("/", 1)[1] if "://" in root and "/" in own and not root.startswith("file:") else own
    return files.select(F.substring_index("path", f"{own}/", -1).alias("path"), "content")


def checked_files(spark: SparkSession, root: str, manifest: DataFrame, mode: str = "report") -> DataFrame:
    """(path, status, content) of each entry of ``manifest`` (path, sha256).

    status: ``ok``, ``missing``, ``hash_mismatch``, ``path_escape``, ``repeated`` (an earlier entry names the same file), or ``unlisted`` for a file that
    no entry names (its hash says nothing). Content comes with ``ok`` only. With mode ``fail`` any other status ends the job.
    """
    listed = manifest.select(F.col("path").alias("told"), F.lower("sha256").alias("sha256")).withColumn("path", resolved(F.col("told")))
    times = listed.filter("path is not null").groupBy("path").agg(F.count("*").alias("times"), F.min("sha256").alias("sha256"), F.min("told").alias("told"))
    files = under(spark, root).select("path", "content", F.sha2("content", 256).alias("actual"))
    joined = times.join(files, "path", "full_outer")
    status = (
        F.when(F.col("times").isNull(), "unlisted").when(F.col("actual").isNull(), "missing").when(F.col("times") > 1, "repeated")
        .when(~F.coalesce(F.col("sha256") == F.col("actual"), F.lit(False)), "hash_mismatch").otherwise("ok")
    )
    out = joined.select("path", status.alias("status"), F.when(status == "ok", F.col("content")).alias("content"))
    escaped = listed.filter("path is null").select(F.col("told").alias("path"), F.lit("path_escape").alias("status"), F.lit(None).cast("binary").alias("content"))
    out = out.unionByName(escaped)
    if mode == "fail":
        told = F.concat_ws(" ", F.col("status"), F.lit("at"), F.col("path"))
        out = out.withColumn("status", F.when(F.col("status") != "ok", F.raise_error(told)).otherwise(F.col("status")))
    elif mode != "report":
        raise ValueError(f"unknown mode {mode}")
    return out


def fixture_sides(pairs: DataFrame, mode: str = "report") -> DataFrame:
    """``pairs`` with ``fault``; with mode ``fail`` a missing side ends the job."""
    if mode != "fail":
        return pairs
    told = F.concat_ws(" ", F.col("fault"), F.lit("at"), "problem", "role", "case")
    return pairs.withColumn("fault", F.when(F.col("fault").isNotNull(), F.raise_error(told)))


_CALL = "seconds double, error string, http_status int, raw_response string"
_STEP = "status string, error string, truncated boolean, target_language string, execution struct<compile_result:struct<duration_seconds:double>,fixture_results:array<struct<fixture_stem:string,status:string,duration_seconds:double>>>"


def _records(spark: SparkSession, root: str, glob: str, schema: str) -> DataFrame:
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(root)
    return rows.withColumn("path", F.col("_metadata.file_path"))


def call_diagnostics(spark: SparkSession, root: str) -> DataFrame:
    """One row on the saved calls below ``root`` (``api-attempt-*.json``): number, seconds, tokens, errors and cut answers."""
    calls = _records(spark, root, "api-attempt-*.json", _CALL)
    body = F.when(F.col("http_status") == 200, F.try_parse_json("raw_response"))
    tokens = lambda name: F.coalesce(F.sum(F.try_variant_get(body, f"$.usage.{name}", "bigint")), F.lit(0)).alias(name)
    cut = F.size(F.filter(F.coalesce(F.try_variant_get(body, "$.choices", "array<variant>"), F.array().cast("array<variant>")), lambda c: F.try_variant_get(c, "$.finish_reason", "string") == "length"))
    return calls.agg(
        F.count("*").alias("calls"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("mean_seconds"), F.percentile("seconds", 0.5).alias("median_seconds"), F.max("seconds").alias("max_seconds"),
        tokens("prompt_tokens"), tokens("completion_tokens"), F.count_if(F.col("error").isNotNull() & (F.col("error") != "")).alias("errors"), F.coalesce(F.sum(cut), F.lit(0)).alias("truncated_choices"),
    )


def step_diagnostics(spark: SparkSession, root: str) -> DataFrame:
    """(language, status, steps, truncated, compile_seconds, fixture_seconds, failed_fixtures) of the saved steps (``step.json``) below ``root``."""
    steps = _records(spark, root, "step.json", _STEP)
    results = F.coalesce("execution.fixture_results", F.array().cast("array<struct<fixture_stem:string,status:string,duration_seconds:double>>"))
    seconds = F.aggregate(results, F.lit(0.0), lambda a, f: a + F.coalesce(f["duration_seconds"], F.lit(0.0)))
    failed = F.size(F.filter(results, lambda f: f["status"] != "success"))
    return steps.groupBy(F.col("target_language").alias("language"), "status").agg(
        F.count("*").alias("steps"), F.count_if("truncated").alias("truncated"), F.sum(F.coalesce("execution.compile_result.duration_seconds", F.lit(0.0))).alias("compile_seconds"), F.sum(seconds).alias("fixture_seconds"), F.sum(failed).alias("failed_fixtures"),
    )
