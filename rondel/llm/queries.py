"""The queries of the training-data operators: ``opN_<name>`` and ``pipeline``.

Each query applies its operator to its whole table with production parameters.
"""

from __future__ import annotations

import importlib
import importlib.util
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Vocabulary files, found by ``tokenizer_path``.
RANKS, PIECES = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on the driver; executors get its bytes by broadcast."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rondel.llm.url_filter import judged

    return judged(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rondel.llm.mixing import mixing_rates

    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rondel.llm.pii import surrogates

    return surrogates(table(spark, sf_dir, "documents"))


def op4_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rondel.llm.webp import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rondel.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rondel.llm.shared import shared_dir
    from rondel.llm.token_counts import token_counts

    # A cache of its own for each run, so that a run does all its work.
    cache = f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(PIECES), cache)


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rondel.llm.fingerprint import edit_robustness

    return edit_robustness(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rondel.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rondel.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path(RANKS), split_pattern())


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rondel.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rondel.llm.lexical import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rondel.llm.secret_scan import scanned

    return scanned(table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rondel.llm.importance import resampled

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (op1_url_filter, op2_mixing, op3_pii_surrogates, op4_webp, op5_toxicity, op6_token_counts, op7_fingerprint, op8_html_text, op9_bpe, op10_minhash, op11_lexical, op12_secrets, op13_importance)
}


def queries() -> dict:
    """All queries of the package; the pipeline too, where its module is there."""
    found = dict(QUERIES)
    if importlib.util.find_spec("corpus_pipeline"):
        found["pipeline"] = importlib.import_module("corpus_pipeline").run
    return found


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can state on whole tables.

    The others are trained, hashed or encoded; their tests hold them against
    brute force, library results, exact round trips or held-out accuracy.
    """
    from rondel.llm import sql

    return sql.queries()
