"""Sources and sinks: observations, ledgers, fixtures, manifests, CSV and the tables a job writes."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, MapType, StringType, StructField, StructType

# Schemas, one for each protocol version; a document of another shape fails.
OUTCOME = "struct<success:boolean,category:string,reached_step:int,reached_roundtrip:int,unique_state_count_at_reach:int,d_n:int,sym_adj:double,sym_origin:double,reason:string>"
STEP = "struct<step:int,kind:string,phase:string,language:string,source_sha256:string,duplicate:boolean,evaluation_status:string,functional:boolean,sym_adj:double,sym_origin:double,sym_status:string,cost_usd:double,actual_model:string,latency_seconds:double>"
OBSERVATION = (
    "problem_id string, route string, attempt int, repeat int, profile_id string, campaign_id string, phase string, protocol string, schema_version string, contract_hash string, "
    f"outcomes map<string,{OUTCOME}>, status string, category string, success boolean, terminal_status string, confirmation_status string, confirmation_reason string, translation_steps int, cost_usd double, "
    f"states array<struct<language:string,sha256:string,first_seen_step:int>>, steps array<{STEP}>"
)
LEDGER = "call_id string, attempt_id string, phase string, status string, cost_usd double, cost_source string, reserved_usd double, uncertain_reserved_usd double, usage struct<prompt_tokens:bigint,completion_tokens:bigint,cached_tokens:bigint>"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one on a local master (tests), else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="rondel-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; this cuts the lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observations(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """One row for each ``<root>/*/*/attempt-*/observation.json``, with its path; ``version`` filters the schema tag."""
    rows = spark.read.schema(OBSERVATION).option("multiLine", True).option("mode", "FAILFAST").json(f"{root}/*/*/attempt-*/observation.json")
    rows = rows.withColumn("path", F.col("_metadata.file_path"))
    return rows.filter(F.col("schema_version") == version) if version else rows


def outcome_rows(rows: DataFrame) -> DataFrame:
    """Long form: (slot, threshold, outcome fields); a missing category is incomplete."""
    slot = ["problem_id", "route", F.coalesce("attempt", "repeat").alias("attempt")]
    long = rows.select(*slot, F.explode_outer("outcomes").alias("key", "outcome"))
    return long.select("problem_id", "route", "attempt", F.format_string("%.2f", F.col("key").cast("double")).alias("threshold"), F.coalesce("outcome.category", F.lit("incomplete")).alias("category"), "outcome.success", "outcome.reached_step", "outcome.d_n", "outcome.sym_adj", "outcome.reason")


def step_rows(rows: DataFrame, seed: str = "cpp") -> DataFrame:
    """Long form of the steps; kind, else phase, else discovery; search is discovery."""
    long = rows.select("problem_id", "route", F.coalesce("attempt", "repeat").alias("attempt"), F.explode("steps").alias("s"))
    kind = F.coalesce("s.kind", "s.phase", F.lit("discovery"))
    return long.select("problem_id", "route", "attempt", "s.*", F.when(kind == "search", "discovery").otherwise(kind).alias("phase_")).drop("kind", "phase").withColumnRenamed("phase_", "phase")


def primary_outcome(rows: DataFrame, threshold: float) -> DataFrame:
    """``rows`` with category, success and reached_step of the given threshold; a record without it is an error."""
    key = f"{threshold:.2f}"
    chosen = F.col("outcomes")[key]
    chosen = F.when(chosen.isNull(), F.raise_error(F.concat(F.lit(f"no outcome at {key} for "), "problem_id"))).otherwise(chosen)
    return rows.withColumn("o_", chosen).withColumn("category", F.col("o_.category")).withColumn("success", F.col("o_.success")).withColumn("reached_step", F.col("o_.reached_step")).drop("o_")


def ledger(spark: SparkSession, glob: str) -> DataFrame:
    """All shards of a JSON-lines ledger; blank lines are skipped."""
    return spark.read.schema(LEDGER).json(glob).filter("call_id is not null or attempt_id is not null")


def csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a byte-order mark before the header goes."""
    rows = spark.read.option("header", True).csv(path)
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def run_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Every run.json below the root, with its path."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "run.json").option("multiLine", True).json(root).withColumn("path", F.col("_metadata.file_path"))


def fixtures(spark: SparkSession, root: str) -> DataFrame:
    """(problem, role, case, input, expected, fault) of ``<root>/<problem>/<role>/<case>.inp|out``."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(root).withColumn("path", F.col("_metadata.file_path"))
    at = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)\.(inp|out)$", k)
    named = files.select(at(1).alias("problem"), at(2).alias("role"), at(3).alias("case"), at(4).alias("kind"), "value")
    inputs = named.filter("kind = 'inp'").select("problem", "role", "case", F.col("value").alias("input"))
    outputs = named.filter("kind = 'out'").select("problem", "role", "case", F.col("value").alias("expected"))
    from rondel.operators.audits import case_pairs

    return case_pairs(inputs, outputs)


def dataset_index(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, problem, manifest_sha256, normalization), exploded from the nested index; duplicate ids are an error."""
    schema = "schema_version int, datasets array<struct<id:string,normalization:string,manifest_sha256:string,problems:array<string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("datasets").alias("d")).select(F.col("d.id").alias("dataset"), F.explode("d.problems").alias("problem"), "d.manifest_sha256", "d.normalization")
    n = F.count("*").over(Window.partitionBy("problem"))
    return rows.withColumn("problem", F.when(n > 1, F.raise_error(F.concat(F.lit("repeated id "), "problem"))).otherwise(F.col("problem")))


def restored_archive(spark: SparkSession, glob: str) -> DataFrame:
    """(path, size, sha256) of the parts of an archive, to compare with its manifest; their bytes stay on the executors."""
    return spark.read.format("binaryFile").load(glob).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def load_config(text: str) -> dict:
    """JSON configuration; a repeated key is an error."""

    def unique(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("a repeated key")
        return dict(pairs)

    return json.loads(text, object_pairs_hook=unique)


def digest(value) -> str:
    """sha256 of bytes, or of JSON with sorted keys and default separators."""
    return hashlib.sha256(value if isinstance(value, bytes) else json.dumps(value, sort_keys=True).encode()).hexdigest()


def compact_digest(value) -> str:
    """sha256 of JSON with sorted keys and no spaces; never equal to ``digest`` of nested values."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


# Sinks


def immutable_write(df: DataFrame, path: str) -> None:
    """Write once; the same rows again are no change, others are an error."""
    spark = df.sparkSession
    try:
        before = spark.read.schema(df.schema).parquet(path)
    except AnalysisException:
        df.write.mode("errorifexists").parquet(path)
        return
    if not (before.exceptAll(df).isEmpty() and df.exceptAll(before).isEmpty()):
        raise ValueError(f"{path} holds other rows")


def stage(spark: SparkSession, root: str, contract: dict, build) -> DataFrame:
    """The table of this contract: read if it was built before, else built and written."""
    path = f"{root}/{compact_digest(contract)}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        build(spark).write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)


def sealed(spark: SparkSession, glob: str) -> DataFrame:
    """(path, sha256) of every file but temporary ones: the seal to compare a folder with later."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob).filter(~F.col("path").endswith(".tmp")).select("path", F.sha2("content", 256).alias("sha256"))


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def markdown(df: DataFrame, decimals: int = 3) -> str:
    """A small summary as a Markdown table; null is NA."""
    show = lambda x: "NA" if x is None else f"{x:.{decimals}f}" if isinstance(x, float) else str(x)
    lines = [f"| {' | '.join(df.columns)} |", f"| {' | '.join('---' for _ in df.columns)} |"]
    return "\n".join(lines + [f"| {' | '.join(map(show, r))} |" for r in df.collect()])


@F.udtf(returnType=StructType([StructField("pointer", StringType()), StructField("value", DoubleType())]))
class _Leaves:
    def eval(self, document: str):
        def walk(node, pointer):
            if isinstance(node, dict):
                for k, v in node.items():
                    yield from walk(v, f"{pointer}/{str(k).replace('~', '~0').replace('/', '~1')}")
            elif isinstance(node, list):
                for i, v in enumerate(node):
                    yield from walk(v, f"{pointer}/{i}")
            elif isinstance(node, (int, float)) and not isinstance(node, bool):
                yield pointer, float(node)

        yield from walk(json.loads(document), "")


def evidence_leaves(documents: DataFrame, column: str) -> DataFrame:
    """(pointer, value) of each numeric leaf of a JSON column, beside its row."""
    documents.sparkSession.udtf.register("rondel_leaves", _Leaves)
    documents.createOrReplaceTempView("rondel_documents")
    return documents.sparkSession.sql(f"SELECT d.*, l.pointer, l.value FROM rondel_documents d, LATERAL rondel_leaves(d.{column}) l")


def _masked(value: Column, kind: DataType, secret: set[str], mask: str) -> Column:
    if isinstance(kind, StructType):
        fields = [(F.lit(mask) if f.name in secret else _masked(value[f.name], f.dataType, secret, mask)).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _masked(x, kind.elementType, secret, mask))
    if isinstance(kind, MapType):
        # An entry's mask has to be of the other entries' type, so plain values become text and others null.
        nested = isinstance(kind.valueType, (StructType, ArrayType, MapType))
        inner = lambda v: _masked(v, kind.valueType, secret, mask) if nested else v.cast("string")
        hidden = F.lit(None) if nested else F.lit(mask)
        return F.transform_values(value, lambda k, v: F.when(k.cast("string").isin(*secret), hidden).otherwise(inner(v)))
    return value


def masked(df: DataFrame, secret: set[str], mask: str = "***") -> DataFrame:
    """Columns, fields and map entries whose name is secret hold the mask, at any depth of structs, arrays and maps.

    A secret entry of a map of nested values is null. Null values that aren't secret stay null.
    """
    return df.select(*[(F.lit(mask) if f.name in secret else _masked(F.col(f"`{f.name}`"), f.dataType, secret, mask)).alias(f.name) for f in df.schema])


def masked_json(secret: set[str], mask: str = "***"):
    """Column function: JSON text with the values of secret keys masked, at any depth; text that is no JSON becomes the mask."""

    def walk(node):
        if isinstance(node, dict):
            return {k: mask if k in secret else walk(v) for k, v in node.items()}
        return [walk(v) for v in node] if isinstance(node, list) else node

    def one(text):
        try:
            return json.dumps(walk(json.loads(text)), ensure_ascii=False, sort_keys=True)
        except ValueError:
            return mask

    @F.pandas_udf(StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(one, na_action="ignore")

    return run
