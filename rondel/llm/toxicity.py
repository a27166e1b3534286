"""Toxicity scores by a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), so a pair of
terms (an insult with a group mention) can weigh more or less than both alone.
Terms are the words of the lower-cased text and their beginnings of
``BEGINNINGS`` bytes, which join inflected forms; x is 1 + ln(number of distinct
words of the text that give the term).

The machine is fitted on the driver on a bounded sample of labelled rows
(``SAMPLE``); scoring covers all rows and whole texts and needs no shuffle, and of
each row only the text goes to a worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondel.llm.shared import give_back, lean, slices, small_batches, span_hashes, words, written

#: Labelled rows that the machine is fitted on, at most, and bytes of their terms; picked by a hash of doc_id.
SAMPLE, SAMPLE_BYTES = 8000, 64 << 20
#: Parts that the labelled rows are dealt into.
PARTS = 32
#: Hashed terms; factors of a term.
BUCKETS, FACTORS = 1 << 20, 8
#: A term gets a weight and factors if it tells by itself (chi-square), or in some pair: by how
#: far the pair's label share is from what both terms' shares add up to (chi-square, for millions of pairs).
LEAST_CHI, LEAST_PAIR_CHI = 12.0, 40.0
#: Share of the labelled rows in which a term of a pair occurs, at least; rarer pairs can't be told from chance.
PAIR_SHARE = 0.01
BEGINNINGS = (5, 6, 7, 8, 9)
#: A score from which a document is rejected.
REJECT = 0.7

_SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass(frozen=True)
class Machine:
    """slot: place of each hashed term in w and v, or -1."""

    slot: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray


def term_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed term) of each distinct word of a row and of each of its beginnings."""
    starts, ends, row = words(data, offsets, _SEPARATORS)
    hashed = span_hashes(data, starts, ends)
    first = np.unique((row.astype(np.uint64) << np.uint64(40)) ^ (hashed >> np.uint64(24)), return_index=True)[1]
    starts, ends, row, hashed = starts[first], ends[first], row[first], hashed[first]
    rows, found = [row], [hashed]
    for k in BEGINNINGS:
        longer = ends - starts > k
        rows.append(row[longer])
        found.append(span_hashes(data, starts[longer], starts[longer] + k) ^ np.uint64(k))
    return np.concatenate(rows), (np.concatenate(found) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _counted(row: np.ndarray, term: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, x) of the distinct terms of each row."""
    key, n = np.unique(row * size + term, return_counts=True)
    return key // size, key % size, 1 + np.log(n)


@lean
def _terms(batches):
    """(doc_id, toxic, packed hashed terms and their x) of each labelled row."""
    for batch in batches:
        packed = []
        for row, end, data, offsets in slices(batch.column(2)):
            of, term, x = _counted(*term_buckets(data, offsets), BUCKETS)
            cut = np.searchsorted(of, np.arange(end - row + 1))
            packed += [term[a:b].astype(np.int32).tobytes() + x[a:b].astype(np.float32).tobytes() for a, b in zip(cut, cut[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc_id", "toxic", "terms"])


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fit on the labelled rows whose crc32(doc_id) mod 3 is not 1, ``SAMPLE`` of them at most.

    Rows with a null label or doc_id teach nothing. Without rows of both labels the
    machine knows no terms and gives every text the share of label 1 (0 if none).
    """
    wanted = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().filter(~held_out("doc_id")).dropDuplicates(["doc_id"])
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    text = F.lower(F.coalesce("text", F.lit(""))).alias("text")
    small_batches(docs.sparkSession)
    joined = docs.select("doc_id", text).join(F.broadcast(wanted), "doc_id")
    # Of rows that share an id one text teaches, so that there are no more rows than labels.
    joined = joined.repartition(PARTS, "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")).select("doc_id", "toxic", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    terms = written(joined.mapInArrow(_terms, f"doc_id {kind}, toxic int, terms binary"), "toxicity-terms")
    # Sizes come first, then the terms one partition after the other: the driver's heap never holds them all.
    sizes = terms.select(F.xxhash64("doc_id").alias("key"), "doc_id", F.octet_length("terms").alias("size")).collect()
    total, taken = 0, set()
    for _, doc_id, size in sorted(sizes):
        total += size
        if total > SAMPLE_BYTES:
            break
        taken.add(doc_id)
    rows = [(r.doc_id, r.toxic, bytes(r.terms)) for r in terms.toLocalIterator() if r.doc_id in taken]
    rows.sort(key=lambda r: r[0])
    toxic, packed = np.array([r[1] for r in rows], np.float64), [r[2] for r in rows]
    del rows
    machine = fit([unpacked(raw) for raw in packed], toxic)
    del packed
    give_back()
    return machine


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(raw) // 2
    return np.frombuffer(raw[:half], np.int32), np.frombuffer(raw[half:], np.float32)


def _paired(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, df: np.ndarray, hit: np.ndarray, share: float, alone: np.ndarray, block: int = 128) -> np.ndarray:
    """Terms that tell in a pair what neither tells alone; counts of pairs are products of blocks of the row x term matrix."""
    n = len(y)
    terms = np.flatnonzero((df >= max(3, PAIR_SHARE * n)) & (df <= (1 - PAIR_SHARE) * n) & ~alone)
    place = np.full(BUCKETS, -1, np.int32)
    place[terms] = np.arange(len(terms))
    # (term's place, row), sorted, in one array: the driver's memory is small.
    cells, at = np.empty(int(df[terms].sum()), np.int64), 0
    for i, (t, _) in enumerate(rows):
        own = place[t]
        own = own[own >= 0]
        cells[at : at + len(own)] = own.astype(np.int64) << 32 | i
        at += len(own)
    cells.sort()

    def matrix(first: int) -> np.ndarray:
        a, b = np.searchsorted(cells, [first << 32, (first + block) << 32])
        out = np.zeros((n, min(block, len(terms) - first)), np.float32)
        out[cells[a:b] & 0xFFFFFFFF, (cells[a:b] >> 32) - first] = 1
        return out

    rate, told = hit[terms] / np.maximum(df[terms], 1), np.zeros(len(terms), bool)
    for i in range(0, len(terms), block):
        left = matrix(i)
        toxic = left * y[:, None].astype(np.float32)
        for j in range(i, len(terms), block):
            right = left if i == j else matrix(j)
            both, hits = left.T @ right, toxic.T @ right
            added = np.clip(rate[i : i + block, None] + rate[None, j : j + block] - share, 0.5 * share, 1 - 0.5 * (1 - share))
            found = (hits - both * added) ** 2 >= LEAST_PAIR_CHI * np.maximum(both * added * (1 - added), 1.0)
            told[i : i + block] |= found.any(1)
            told[j : j + block] |= found.any(0)
    return terms[told]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 25, batch: int = 64, rate: float = 0.1, decay: float = 1e-4) -> Machine:
    """Logistic loss, adaptive gradient steps, fixed seed."""
    slot = np.full(BUCKETS, -1, np.int32)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        bias = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Machine(slot, float(bias), np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
    n = len(y)
    df, hit = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for (t, _), toxic in zip(rows, y):
        df[t] += 1
        if toxic:
            hit[t] += 1
    alone = np.zeros(BUCKETS, bool)
    often = np.flatnonzero((df >= 3) & (df < n))
    expected = df[often] * share
    alone[often] = (hit[often] - expected) ** 2 / np.maximum(expected * (1 - share) * (1 - df[often] / n), 1e-9) >= LEAST_CHI
    kept = np.union1d(np.flatnonzero(alone), _paired(rows, y, df, hit, share, alone))
    slot[kept] = np.arange(len(kept))
    rows = [(slot[t][slot[t] >= 0], x[slot[t] >= 0]) for t, x in rows]
    rng = np.random.default_rng(7)
    w, v, bias = np.zeros(len(kept)), rng.normal(0, 0.05, (len(kept), FACTORS)), np.log(share / (1 - share))
    gw, gv, gb = np.full(len(kept), 1e-6), np.full((len(kept), FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            part = order[at : at + batch]
            idx, x = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            of = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            score, total = _score(bias, w, v, idx, x, of, len(part))
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[part]) / len(part)
            uniq, back = np.unique(idx, return_inverse=True)
            dw = np.bincount(back, error[of] * x, len(uniq)) + decay * w[uniq]
            pull = (error[of] * x)[:, None] * (total[of] - v[idx] * x[:, None])
            dv = np.stack([np.bincount(back, pull[:, f], len(uniq)) for f in range(FACTORS)], 1) + decay * v[uniq]
            gw[uniq] += dw**2
            gv[uniq] += dv**2
            w[uniq] -= rate * dw / np.sqrt(gw[uniq])
            v[uniq] -= rate * 0.3 * dv / np.sqrt(gv[uniq])
            gb += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(gb)
    return Machine(slot, float(bias), w.astype(np.float32), v.astype(np.float32))


def _score(bias: float, w: np.ndarray, v: np.ndarray, idx: np.ndarray, x: np.ndarray, of: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(raw score, sum of the factors) of each row."""
    factors = v[idx] * x[:, None]
    total = np.stack([np.bincount(of, factors[:, f], rows) for f in range(v.shape[1])], 1)
    square = np.bincount(of, (factors**2).sum(1), rows)
    return bias + np.bincount(of, w[idx] * x, rows) + 0.5 * ((total**2).sum(1) - square), total


def held_out(column: str):
    """crc32 of doc_id as text, mod 3, is 1; false for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def scored(docs: DataFrame, machine: Machine, name: str = "toxicity_score") -> DataFrame:
    """``docs`` with a column ``name``: the score of the whole text; null and empty texts get the score of no terms.

    Every row and column is kept; a column of that name is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(name)
    shared = spark.sparkContext.broadcast(machine)
    size = max(len(machine.w), 1)

    @lean
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            out = np.empty(len(texts))
            for row, end, data, offsets in slices(texts):
                of, term = term_buckets(data, offsets)
                at = m.slot[term]
                of, at, x = _counted(of[at >= 0], at[at >= 0].astype(np.int64), size)
                raw, _ = _score(m.bias, m.w, m.v, at, x, of, end - row)
                out[row:end] = 1 / (1 + np.exp(-np.clip(raw, -60, 60)))
            yield pa.array(out)

    return docs.withColumn(name, F.arrow_udf(score, "double")(F.lower(F.coalesce("text", F.lit("")))))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    ``labels``, lang, source and doc_id only choose the rows to learn from; the
    score reads the text alone, so equal texts have equal scores. Repeated rows
    give repeated results; an empty table gives none.
    """
    score = scored(docs.select("doc_id", "text"), train(docs, labels), "score")
    return score.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the machine doesn't reject, with all their columns.

    Null and empty texts have the score of no terms; repeated rows stay or go together; an empty table gives none.
    """
    name = "__toxicity_score"
    return scored(docs, train(docs, labels), name).filter(F.col(name) < REJECT).drop(name)
