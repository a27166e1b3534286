"""Document fingerprints by locally consistent parsing.

Level 0 cuts the text's bytes into phrases, each further level cuts the sequence
of the phrases below. Where to cut is decided by deterministic coin tossing: a
symbol's label is the place and value of the lowest bit in which it differs from
its left neighbour; after a few rounds labels are below 6, and a cut comes
before each local maximum. A cut depends on a few neighbours only, so equal
substrings are cut alike wherever they stand, but for a margin at each end.
Runs of equal symbols count as one symbol, so neighbours always differ.

A phrase's name is a hash of its bytes. The fingerprint holds the ``KEPT`` least
names of all its levels, for texts of every size; likeness estimates the Jaccard
similarity of the sets of names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondel.llm.shared import SLICE_BYTES, prefix_sums, span_hashes

KEPT, LEVELS = 32, 24

_LOWEST = np.array([(b & -b).bit_length() - 1 if b else 0 for b in range(256)], np.uint8)


def _toss(symbols: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Labels under 6 in which neighbours of a row differ, from symbols in which they differ. head: first symbols of rows."""
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[head] = ~symbols[head]
    differ = symbols ^ before
    if symbols.dtype == np.uint8:
        bit = _LOWEST[differ]
        label = 2 * bit + ((symbols >> bit) & 1)
    else:
        low = differ & (~differ + np.uint64(1))
        bit = np.bitwise_count(low - np.uint64(1))
        label = 2 * bit + ((symbols & low) != 0)
    for _ in range(3):
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[head] = ~label[head]
        bit = _LOWEST[label ^ before]
        label = 2 * bit + ((label >> bit) & 1)
    return label


def phrases(data: np.ndarray, offsets: np.ndarray):
    """(row, name) of each phrase, level by level from 1. Rows' own boundaries always cut."""
    rows = len(offsets) - 1
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    starts = np.arange(len(data))
    row = np.repeat(np.arange(rows), np.diff(offsets))
    names, sums = data, prefix_sums(data)
    for _ in range(LEVELS):
        head = np.ones(len(starts), bool)
        head[1:] = row[1:] != row[:-1]
        fresh = head.copy()
        fresh[1:] |= names[1:] != names[:-1]
        kept = np.flatnonzero(fresh)
        head = head[kept]
        label = _toss(names[kept], head)
        cut = head.copy()
        if len(label) > 2:
            cut[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~head[2:]
        # A row's second symbol isn't cut off from its first.
        cut[1:] &= ~head[:-1] | head[1:]
        kept = kept[cut]
        starts, row = starts[kept], row[kept]
        names = span_hashes(data, starts, np.append(starts[1:], len(data)), sums)
        yield row, names
        if len(starts) == len(filled):
            return


def signatures(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted ``KEPT`` least 32-bit names of each text; none for an empty text.

    Names of all levels count.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    if not len(data):
        return [np.zeros(0, np.uint32)] * len(texts)
    found = []
    for row, names in phrases(data, offsets):
        found.append((row.astype(np.uint64) << np.uint64(32)) | (names >> np.uint64(32)))
    # Sorting is many times faster here than numpy's ``unique``, which hashes first.
    key = np.sort(np.concatenate(found))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    row, name = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    return [name[a : min(b, a + KEPT)] for a, b in zip(cut, cut[1:])]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity: of the least names of both together, the share that both have. Two empty ones: 1."""
    both = np.union1d(a, b)[:KEPT]
    if not len(both):
        return 1.0
    return float(np.isin(both, a, assume_unique=True) @ np.isin(both, b, assume_unique=True).astype(float) / len(both))


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with fingerprint string of the whole text (null: empty); all rows and columns are kept, nothing is shuffled."""
    from pyspark.sql.types import StringType, StructField, StructType

    docs = docs.drop("fingerprint")
    at = docs.columns.index("text")

    def own(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
            out = [as_text(s) for part in _parts(texts, len) for s in signatures(part)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "fingerprint"])

    return docs.mapInArrow(own, StructType([*docs.schema.fields, StructField("fingerprint", StringType())]))


def _parts(items: list, size) -> list[list]:
    """Runs of items of about ``SLICE_BYTES`` by ``size``."""
    parts, total = [[]], 0
    for item in items:
        if total > SLICE_BYTES:
            parts.append([])
            total = 0
        parts[-1].append(item)
        total += size(item)
    return [p for p in parts if p]


def _bucket(bounds: list, low: int = 0) -> F.col:
    """Number of bounds that are under doc_id, as a balanced tree of comparisons."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(F.col("doc_id") <= F.lit(bounds[mid]), _bucket(bounds[:mid], low)).otherwise(_bucket(bounds[mid + 1 :], low + mid + 1))


RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_robustness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edited text.

    The edited text's last floor(n_chars / 3) code points are replaced by the
    first as many (or all) of the next document's, in order of descending doc_id;
    after the last comes the first. Equal ids are in order of their texts; rows
    without an id come last. A single row is its own next. Null texts are empty.

    Rows are dealt by ranges of doc_id in one shuffle. Each range also gets the
    first row of the following one, of which there is one for each range.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    bounds = sorted(set(rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)))
    # A null id sorts under all others.
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(_bucket([int(b) for b in bounds]))
    tops = sorted((r.bucket, r.top) for r in rows.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("top")).collect())
    # A bucket's last row is followed by the top row of the next lower bucket; the lowest by the highest's.
    places = [F.struct(bucket.alias("bucket"), F.lit(False).alias("guest"))]
    dealt = rows.withColumn("place", F.explode(F.array(*places)))
    if tops:
        guests = [((F.col("doc_id").eqNullSafe(F.lit(top))), to) for (_, top), (to, _) in zip(tops, tops[1:] + tops[:1])]
        to = F.coalesce(*[F.when(test, F.lit(b)) for test, b in guests])
        dealt = rows.withColumn("to", to).withColumn("place", F.explode(F.filter(F.array(places[0], F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("bucket"), F.lit(True).alias("guest")))), lambda x: x.isNotNull())))
    dealt = dealt.select("doc_id", "text", "place.bucket", "place.guest").repartition(parts, "bucket")
    dealt = dealt.sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pairs(batches):
        before = None
        for batch in batches:
            for doc_id, text, at, guest in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if before and before[2] == at:
                    yield before[0], before[1], text
                before = None if guest else (doc_id, text, at)

    def compare(batches):
        part, size = [], 0
        for row in pairs(batches):
            part.append(row)
            size += len(row[1]) * 2
            if size > SLICE_BYTES:
                yield told(part)
                part, size = [], 0
        if part:
            yield told(part)

    def told(part):
        edited = [text[: len(text) - len(text) // 3] + after[: len(text) // 3] for _, text, after in part]
        raw = [t.encode() for t in edited]
        own = signatures([text.encode() for _, text, _ in part] + [part[-1][2].encode()])
        other = signatures(raw)
        columns = [
            [doc_id for doc_id, _, _ in part],
            [len(text) for _, text, _ in part],
            [hashlib.sha256(r).hexdigest() for r in raw],
            [as_text(s) for s in own[:-1]],
            [as_text(s) for s in other],
            [likeness(a, b) for a, b in zip(own, other)],
            [likeness(a, b) for a, b in zip(own, _next(part, own))],
        ]
        names = ["doc_id", *(c.split()[0] for c in RESULT.split(", "))]
        return pa.RecordBatch.from_pydict(dict(zip(names, columns)), schema=pa.schema([(n, t) for n, t in zip(names, [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])]))

    def _next(part, own):
        """Signatures of the next texts: those of the following row, but where a bucket ends."""
        out = []
        for i, (_, _, after) in enumerate(part):
            follows = i + 1 == len(part) or part[i + 1][1] == after
            out.append(own[i + 1] if follows else signatures([after.encode()])[0])
        return out

    id_type = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind]
    return dealt.mapInArrow(compare, f"doc_id {kind}, {RESULT}")
