"""Ranked lexical search of items over all documents.

1. ``postings``: one row for each (document, term) that some item may ask for, bucketed by
   term. A document's postings stay in the slice of the input that it was read from, so a term that all
   documents hold is spread over all slices, and no posting is shuffled.
2. ``item_weights``: each term of an item with its integer weight from N and df.
3. ``ranked``: postings join the item terms on bucket and term, each match is scored in
   integers, scores are summed by item and document, and ``row_number`` keeps the best.

Spark limits each sorted part to the best rows before the window's shuffle, so an item's
task sees a few rows from each part, not all matching documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondel.llm.shared import lean, slices, small_batches, span_hashes, spread_join, words, written

#: Buckets of terms; rows of a slice are stored in the order of their buckets.
BUCKETS = 64
#: Slots of the filter that keeps terms no item holds out of the postings: 128 KB whatever the items are.
SLOTS = 1 << 20
#: Item terms that are broadcast; more are joined by a shuffle that spreads hot terms.
BROADCAST_TERMS = 100_000
#: Rows that an item gets.
TOP = 50

#: Bytes between terms: all ASCII but digits and letters.
_BETWEEN = np.ones(256, bool)
_BETWEEN[128:] = _BETWEEN[48:58] = _BETWEEN[65:91] = _BETWEEN[97:123] = False

_POSTINGS = "bucket int, term string, row long, doc_id {id}, tf long, n long"


def lowered(data: np.ndarray) -> np.ndarray:
    """``data`` with only A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of ``data`` as strings."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at])).cast(pa.string())


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row, hash) of each term of lower-cased ``data``."""
    starts, ends, row = words(data, offsets, _BETWEEN)
    return starts, ends, row, span_hashes(data, starts, ends)


def _slot(hashed: np.ndarray) -> np.ndarray:
    return (hashed & np.uint64(SLOTS - 1)).astype(np.int64)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, bucket, term) of the distinct terms of each item; rows of one ``item_id`` are one item."""

    @lean
    def work(batches):
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                data = lowered(data)
                starts, ends, row, hashed = _terms(data, offsets)
                ids = batch.column(0).slice(first, end - first).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(_slot(hashed), pa.int32()), spans(data, starts, ends)], names=["item_id", "slot", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(work, f"item_id {kind}, slot int, term string").distinct()


def postings(docs: DataFrame, slots: np.ndarray) -> DataFrame:
    """(bucket, term, row, doc_id, tf, n): the occurrences of each term in each document that holds it.

    slots: the term hashes' slots to keep, as ``SLOTS`` booleans. ``row`` tells rows apart where ``doc_id`` repeats;
    n is the number of the document's terms. Each part of the input adds one row without a term, whose ``tf`` is its number of
    documents with terms and whose ``n`` the number of their terms.
    """
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(slots))
    kind = docs.schema["doc_id"].dataType

    @lean
    def work(batches):
        wanted = np.unpackbits(sent.value).astype(bool)
        row = TaskContext.get().partitionId() << 36
        n_docs = n_terms = 0
        null_id = None
        for batch in batches:
            null_id = pa.nulls(1, batch.column(0).type)
            for first, end, data, offsets in slices(batch.column(1)):
                data = lowered(data)
                starts, ends, of, hashed = _terms(data, offsets)
                count = np.bincount(of, minlength=end - first)
                n_docs += int((count > 0).sum())
                n_terms += len(of)
                keep = np.flatnonzero(wanted[_slot(hashed)])
                keep = keep[np.lexsort((hashed[keep], of[keep]))]
                h, o = hashed[keep], of[keep]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])) if len(keep) else keep
                tf = np.diff(np.append(new, len(keep)))
                at, o, h = keep[new], o[new], h[new]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_slot(h) % BUCKETS, pa.int32()),
                        spans(data, starts[at], ends[at]),
                        pa.array(row + first + o, pa.int64()),
                        batch.column(0).slice(first, end - first).take(pa.array(o)),
                        pa.array(tf, pa.int64()),
                        pa.array(count[o], pa.int64()),
                    ],
                    names=["bucket", "term", "row", "doc_id", "tf", "n"],
                )
            row += batch.num_rows
        if null_id is not None:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.nulls(1, pa.string()), pa.array([row], pa.int64()), null_id, pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64())], names=["bucket", "term", "row", "doc_id", "tf", "n"])

    small_batches(docs.sparkSession)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(work, _POSTINGS.format(id=kind.simpleString()))
    return found.sortWithinPartitions("bucket", "term")


def item_weights(terms: DataFrame, index: DataFrame, n_docs: int) -> DataFrame:
    """(item_id, bucket, term, w): each item term that some document holds, with weight floor(1000 ln((2N+2)/(2df+1)))."""
    df = index.filter("bucket >= 0").groupBy("bucket", "term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    asked = terms.select("item_id", (F.col("slot") % BUCKETS).alias("bucket"), "term")
    return asked.join(df, ["bucket", "term"]).select("item_id", "bucket", "term", weight.alias("w")).filter("w > 0")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents of each item: (item_id, rank, doc_id, score).

    docs: (doc_id, text), items: (item_id, text); other columns play no part. A term is a longest run of ASCII letters, digits
    and all characters beyond ASCII, in which only A-Z are lower-cased. Terms of documents and items are whole, of any length.
    Equal scores go by ascending doc_id, nulls last.

    Null and empty texts, of documents and items, have no terms: they match nothing and such a document doesn't count in N. Rows with one
    doc_id are documents of their own, each with its rank. Rows with one item_id are one item that has all their terms. An item without
    a matching document has no row, so empty tables give no rows. A text needs memory in proportion to itself.
    """
    spark = docs.sparkSession
    terms = written(item_terms(items), "item-terms")
    slots = np.zeros(SLOTS, bool)
    slots[[r[0] for r in terms.select("slot").distinct().collect()]] = True
    index = written(postings(docs, slots), "postings")
    sums = index.filter("bucket < 0").agg(F.sum("tf"), F.sum("n")).first()
    n_docs, n_terms = sums[0] or 0, sums[1] or 0
    few = written(item_weights(terms, index, n_docs), "item-weights")
    buckets = [r[0] for r in few.select("bucket").distinct().collect()]
    hits = index.filter(F.col("bucket").isin(buckets) if len(buckets) < BUCKETS else F.col("bucket") >= 0)
    if few.count() <= BROADCAST_TERMS:
        hits = hits.join(F.broadcast(few), ["bucket", "term"])
    else:
        hits = spread_join(hits, few, ["bucket", "term"], ["row"])
    length = f"(50 + (50 * n * {n_docs}L) div {max(n_terms, 1)}L)"
    hits = hits.select("item_id", "row", "doc_id", F.expr(f"w * ((1000000000L * tf) div (1000 * tf + 20 * {length}))").alias("part"))
    scores = hits.groupBy("item_id", "row", "doc_id").agg(F.sum("part").alias("score")).filter("score > 0")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", max(top, int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))))
    best = scores.withColumn("rank", F.expr("row_number() over (partition by item_id order by score desc, doc_id asc nulls last, row)")).filter(F.col("rank") <= top)
    return best.select("item_id", "rank", "doc_id", "score")
