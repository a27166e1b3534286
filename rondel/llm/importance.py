"""Importance resampling towards a target distribution, as an exact draw.

1. ``bucket_counts``: hashed word and word-pair features of all documents and of the target are counted in ``BUCKETS``
   buckets; each bucket's gain is its scaled log ratio.
2. ``scored``: a document's weight is the mean gain of its features, its score the weight with
   Gumbel noise drawn from its id, so that the highest scores are a draw without replacement.
3. ``drawn``: each partition of eligible rows is sorted and sent off as a run, cut into blocks at the bounds of score
   ranges. The runs' blocks of a range are merged by a tournament tree, which opens a block when its head is due.
   Ranks follow from the exact counts of the ranges above, and ranges below the draw are not merged.

Scores are whole numbers of a bounded range, so their histogram, from which the bounds come, is small whatever the corpus holds.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rondel.llm.shared import lean, small_batches, written

#: Buckets of hashed features.
BUCKETS = 10_000
#: Words that a document must have, and hundredths of such documents that are drawn.
LEAST_WORDS, PERCENT = 20, 25
#: Rows of a block of a run, and of a score range at most (if a score has no more than that by itself).
BLOCK_ROWS, RANGE_ROWS = 4096, 1 << 18

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_WORDS_AT_ONCE = 1 << 16


def features(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of their features) for stretches of the words of ``text``; a pair of words counts where it ends."""
    found = (m.group() for m in _WORD.finditer(text.lower()))
    before = None
    while some := list(islice(found, _WORDS_AT_ONCE)):
        single = [crc32(w) for w in some]
        # A checksum goes on from where the word before and the space ended.
        lead = [before, *(crc32(b" ", c) for c in single)]
        start = 1 if before is None else 0
        pairs = [crc32(w, c) for w, c in zip(some[start:], lead[start:])]
        before = lead[-1]
        yield len(some), np.array(single + pairs, np.int64) % BUCKETS


def _bytes(docs: DataFrame, *own: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(*own, F.col("text").cast("string").cast("binary").alias("text"))


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Features of all texts by bucket; null and empty texts have none."""

    @lean
    def work(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, buckets in features(text.as_py() or b""):
                    total += np.bincount(buckets, minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in _bytes(docs).mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B)/((s+1)(T+B)))) of each of the B buckets."""
    s, t = bucket_counts(docs), bucket_counts(target)
    ratio = ((t + 1.0) * (int(s.sum()) + BUCKETS)) / ((s + 1.0) * (int(t.sum()) + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, seed: int = 7) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    @lean
    def work(batches):
        gain = sent.value
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n = size = total = 0
                for count, buckets in features(text.as_py() or b""):
                    n, size, total = n + count, size + len(buckets), total + int(gain[buckets].sum())
                rows.append((n, size, total // size if size else 0))
            columns = list(zip(*rows)) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = _bytes(docs, "doc_id").mapInArrow(work, f"doc_id {kind}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return out.withColumn("score", F.col("weight") + noise)


def ranges(histogram: list[tuple[int, int]], draws: int, rows: int) -> list[tuple[int, int, int]]:
    """(lowest score, highest score, rows above) of runs of scores, from the highest on, as far as the draw goes.

    histogram: (score, rows), highest first. A range ends with the score that fills it to ``rows``.
    """
    out, above, held, top = [], 0, 0, None
    for score, n in histogram:
        top = score if top is None else top
        held += n
        if held >= rows or above + held >= draws:
            out.append((score, top, above))
            above, held, top = above + held, 0, None
            if above >= draws:
                break
    return out


class Tournament:
    """The least head of several sorted runs: leaves are runs, each inner node holds the winner below it.

    A leaf is (key, run) or None. Leaves come and go; the tree doubles when it is full.
    """

    def __init__(self) -> None:
        self.size = 1
        self.nodes: list = [None, None]
        self.free = [0]

    def put(self, leaf: int, head) -> None:
        """Set the leaf's head (None: it has none) and replay its matches up to the root."""
        nodes, at = self.nodes, self.size + leaf
        nodes[at] = head
        while at > 1:
            at >>= 1
            a, b = nodes[2 * at], nodes[2 * at + 1]
            nodes[at] = b if a is None or (b is not None and b < a) else a

    def enter(self, key, run) -> int:
        """A leaf for a new run with its first key."""
        if not self.free:
            heads, size = self.nodes[self.size :], self.size
            self.size, self.nodes, self.free = 2 * size, [None] * (4 * size), list(range(size, 2 * size))
            self.nodes[self.size : self.size + size] = heads
            for at in range(self.size - 1, 0, -1):
                a, b = self.nodes[2 * at], self.nodes[2 * at + 1]
                self.nodes[at] = b if a is None or (b is not None and b < a) else a
        leaf = self.free.pop()
        self.put(leaf, (key, run, leaf))
        return leaf

    @property
    def winner(self):
        return self.nodes[1]


def merged(blocks: Iterator[tuple[tuple, tuple, list]]) -> Iterator[tuple]:
    """The rows of sorted runs in order: blocks are (key of its first row, run, rows as (key, ...)), in the order of these keys.

    A run's blocks follow one another. Only blocks whose keys overlap are held at a time.
    """
    tree, queues = Tournament(), {}

    def until(bound):
        while (best := tree.winner) is not None and (bound is None or best[0] < bound):
            _, run, leaf = best
            queue = queues[run]
            yield next(queue[0])
            head = queue[0].peek()
            if head is None:
                queue.popleft()
                head = queue[0].peek() if queue else None
            if head is not None:
                tree.put(leaf, (head, run, leaf))
            else:
                tree.put(leaf, None)
                tree.free.append(leaf)
                del queues[run]

    for key, run, rows in blocks:
        yield from until(key)
        if run in queues:
            queues[run].append(_Rows(rows))
        else:
            queues[run] = deque([_Rows(rows)])
            tree.enter(key, run)
    yield from until(None)


class _Rows:
    """Rows that can be looked at before they are taken."""

    def __init__(self, rows: list) -> None:
        self.rows, self.at = rows, 0

    def peek(self):
        return self.rows[self.at][0] if self.at < len(self.rows) else None

    def __next__(self):
        self.at += 1
        return self.rows[self.at - 1]


_OWN = ("doc_id", "n_features", "weight", "score")


def _key(score: int, doc_id) -> tuple:
    return (-score, doc_id is None, 0 if doc_id is None else doc_id)


def _merge_runs(eligible: DataFrame, bounds: list[tuple[int, int, int]], draws: int) -> DataFrame:
    """The rows of all ranges with their ranks; what a range holds beyond the draw has none."""
    kind = eligible.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(eligible.schema["doc_id"].dataType)
    lows = np.array([-b[0] for b in bounds])
    above = [b[2] for b in bounds]

    @lean
    def runs(batches):
        run, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            # Scores fall, so the ranges of a batch rise.
            of = np.searchsorted(lows, -batch.column("score").to_numpy())
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                for c in range(a, b, BLOCK_ROWS):
                    part = batch.slice(c, min(c + BLOCK_ROWS, b) - c)
                    lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(n)) for n in _OWN]
                    head = [pa.array([int(of[c])], pa.int32()), pa.array([run], pa.int64()), pa.array([seq], pa.int64()), part.column("score").slice(0, 1), part.column("doc_id").slice(0, 1)]
                    yield pa.RecordBatch.from_arrays([*head, *lists], names=["range", "run", "seq", "head_score", "head_id", *_OWN])
                    seq += 1

    def blocks(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                values = [row.column(n).flatten().to_pylist() for n in _OWN]
                rows = [(_key(s, d), d, f, w, s) for d, f, w, s in zip(*values)]
                yield row.column("range")[0].as_py(), (rows[0][0], row.column("run")[0].as_py(), rows)

    def ranked(batches):
        of, waiting, rows = None, None, blocks(batches)

        def stretch():
            # The blocks of one range; the first block of the next one waits.
            nonlocal waiting
            while waiting is not None and waiting[0] == of:
                yield waiting[1]
                waiting = next(rows, None)

        waiting = next(rows, None)
        while waiting is not None:
            of = waiting[0]
            for i, row in enumerate(merged(stretch())):
                rank = above[of] + i + 1
                yield *row[1:], rank if rank <= draws else None

    @lean
    def merge(batches):
        rows = ranked(batches)
        types = [id_type, *[pa.int64()] * 4]
        while some := list(islice(rows, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=[*_OWN, "rank"])

    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    sent = eligible.select(*_OWN).sortWithinPartitions(*order).mapInArrow(runs, f"range int, run long, seq long, head_score long, head_id {kind}, doc_id array<{kind}>, n_features array<long>, weight array<long>, score array<long>")
    dealt = sent.repartition("range").sortWithinPartitions("range", F.col("head_score").desc(), F.col("head_id").asc_nulls_last(), "run", "seq")
    return dealt.mapInArrow(merge, f"doc_id {kind}, n_features long, weight long, score long, rank long")


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` of ``scored`` as (doc_id, n_features, weight, score, rank), drawn by score; see ``resampled``."""
    spark = rows.sparkSession
    eligible = rows.filter(F.col("n_words") >= least_words)
    histogram = sorted(((r[0], r[1]) for r in eligible.groupBy("score").count().collect()), reverse=True)
    draws = percent * sum(n for _, n in histogram) // 100
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = ranges(histogram, draws, max(1, min(RANGE_ROWS, -(-draws // (4 * parts)))))
    undrawn = lambda df: df.select(*_OWN, F.lit(None).cast("long").alias("rank"))
    if not bounds or draws == 0:
        return undrawn(rows)
    lowest = bounds[-1][0]
    rest = rows.filter((F.col("n_words") < least_words) | (F.col("score") < lowest))
    return undrawn(rest).unionByName(_merge_runs(eligible.filter(F.col("score") >= lowest), bounds, draws))


def resampled(docs: DataFrame, target: DataFrame, seed: int = 7) -> DataFrame:
    """Each row of ``docs`` with its weight towards ``target``, its score and its rank in the draw, null if it isn't drawn.

    docs: (doc_id, text), target: (text); other columns play no part. The draw takes ``PERCENT`` hundredths (rounded down) of the
    documents with ``LEAST_WORDS`` words or more: those of the highest scores, equal scores by ascending doc_id, nulls last. Texts count whole.

    Null and empty texts have no features, weight 0 and no rank. Repeated rows are documents of their own; where ids and
    scores are equal any order of ranks is right, and such rows stay in one range. With an empty target or no eligible document
    all rows come back, in the latter case without ranks; an empty table gives no rows. A text needs memory in proportion to itself.
    """
    return drawn(written(scored(docs, gains(docs, target), seed), "scored"))
