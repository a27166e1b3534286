"""Token counts through a cache keyed by content and tokenizer version.

The key of a count is (digest of the content, digest of the tokenizer's file).
Counts that the cache lacks are computed once for each distinct content and
appended; all rows then read theirs from the cache. A second run over the same
texts encodes nothing.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondel.llm.shared import lean, small_batches, spread_join

#: Texts of more tokens are over the limit.
LIMIT = 4096
#: Texts handed to the library at once.
_BATCH_BYTES = 1 << 20

CACHE = "content binary, version string, n_tokens bigint"


def _counter(name: str, raw: bytes):
    """texts -> numbers of tokens, by the library that the file is for."""
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(raw.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=raw)
    return lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]


def encode_misses(misses: DataFrame, model_path: str, version: str) -> DataFrame:
    """(content, version, n_tokens) of each row (content, text)."""
    small_batches(misses.sparkSession)
    with open(model_path, "rb") as f:
        raw = misses.sparkSession.sparkContext.broadcast(f.read())

    @lean
    def count(batches):
        counts = _counter(model_path, raw.value)
        for batch in batches:
            texts, out, part, size = batch.column(1).to_pylist(), [], [], 0
            for text in texts:
                part.append(text)
                size += len(text)
                if size >= _BATCH_BYTES:
                    out += counts(part)
                    part, size = [], 0
            out += counts(part) if part else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(out), pa.string()), pa.array(out, pa.int64())], names=["content", "version", "n_tokens"])

    return misses.select("content", "text").mapInArrow(count, CACHE)


def read_cache(spark, path: str, version: str) -> DataFrame | None:
    """(content, n_tokens) of one version, each content once; None if there is no cache yet."""
    try:
        kept = spark.read.schema(CACHE).parquet(path)
    except AnalysisException:
        return None
    return kept.filter(F.col("version") == version).select("content", "n_tokens").dropDuplicates(["content"])


def token_counts(docs: DataFrame, model_path: str, cache_path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs``.

    Content is the text's UTF-8 bytes, a null text counting as empty: any stronger
    normalisation could change a count. Repeated rows give repeated results, an
    empty table gives none and leaves the cache as it was; other columns are ignored.

    Copies meet by digest after a partial aggregation in each task, so a content
    that fills a third of the rows arrives once from each; their rows are dealt out
    to read the count.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        version = hashlib.sha256(f.read()).hexdigest()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("content"))
    misses = rows.select("content", "text")
    if (known := read_cache(spark, cache_path, version)) is not None:
        misses = misses.join(known.select("content"), "content", "left_anti")
    encode_misses(misses.dropDuplicates(["content"]), model_path, version).write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path, version)
    keys = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content")
    return spread_join(keys, counts, ["content"], ["doc_id"], "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
