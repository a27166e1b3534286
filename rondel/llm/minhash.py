"""Near-duplicate detection by improved consistent weighted sampling.

1. ``feature_counts``: document frequency of five-word shingles, summed exactly
   over all documents for each hashed feature. The table has ``FEATURES`` entries whatever
   the corpus holds, so its broadcast is bounded (1 MB).
2. ``sketches``: each text becomes a weighted set (tf x idf per shingle) and
   ``BANDS * ROWS`` consistent weighted samples. Equal texts share a digest and
   are one node from there on.
3. Banding: nodes meet in a bucket (band, hash of its samples).
4. Verification: exact weighted Jaccard similarity of the two texts, first of each
   bucket's members with its least node, which joins most groups; then, in buckets
   that still hold several classes, of all members by blocks (``tile_links``). A
   block pair's task returns only links that join classes, never its pairs.
5. Connected components of the verified links give the classes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondel.llm.shared import lean, mix, slices, small_batches, span_hashes, spread_join, words, written

#: Words of a shingle, and the similarity from which two texts are near copies.
WORDS, SIMILARITY = 5, 0.8
#: A pair at the threshold meets in some band with probability 1 - (1 - 0.8**3)**12 > 0.9998.
BANDS, ROWS = 12, 3
#: Hashed features of the document-frequency table.
FEATURES = 1 << 18
#: Members and bytes of a block of a bucket; two blocks are compared in one task.
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20

_CHUNK = 1024
_LOW48 = np.uint64((1 << 48) - 1)


def shingle_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, 48-bit shingle, tf) of the distinct shingles of each row, ordered by row; and the words of each row.

    A row of one to four words has one shingle, all its words; a row of none has none.
    """
    rows = len(offsets) - 1
    starts, ends, row = words(data, offsets)
    count = np.bincount(row, minlength=rows)
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return empty, np.zeros(0, np.uint64), empty, count
    hashed = span_hashes(data, starts, ends)
    first = np.cumsum(count) - count
    width = np.minimum(count, WORDS)
    lead = np.arange(len(hashed)) - first[row] <= (count - width)[row]
    at, of = np.flatnonzero(lead), row[lead]
    total = np.zeros(len(at), np.uint64)
    padded = np.concatenate([hashed, np.zeros(WORDS, np.uint64)])
    factor = 1
    for j in range(WORDS):
        part = padded[at + j] * np.uint64(factor)
        if width.min() < WORDS:
            part[width[of] <= j] = 0
        total += part
        factor = factor * 0xD1342543DE82EF95 % (1 << 64)
    # Rows of a slice are few enough for 16 bits; longer slices are cut by the caller.
    key = np.sort((of.astype(np.uint64) << np.uint64(48)) | (mix(total) >> np.uint64(16)))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tf = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(48)).astype(np.int64), key & _LOW48, tf, count


def _blocks(column: pa.Array):
    """Slices of at most 65,536 rows, so that a row number fits its 16 bits."""
    for row, end, data, offsets in slices(column):
        for a in range(0, end - row, 1 << 16):
            b = min(a + (1 << 16), end - row)
            yield row + a, row + b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def feature_counts(docs: DataFrame) -> tuple[int, np.ndarray]:
    """(documents, sum of the document frequencies of each hashed feature's shingles), over all of ``docs``.

    A task sends one packed row per 1,024 features; sums run in two levels, so no
    task gathers a row from every other.
    """

    @lean
    def count(batches):
        table, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, data, offsets in _blocks(batch.column(0)):
                _, key, _, _ = shingle_keys(data, offsets)
                table += np.bincount((key & np.uint64(FEATURES - 1)).astype(np.int64), minlength=FEATURES)
        # By the partition, so that a task that runs again sends its rows where they went before.
        salt = TaskContext.get().partitionId() % 64
        yield packed([(-1, salt, np.array([n], np.int64))] if n else [])
        yield packed([(c, salt, part) for c in range(FEATURES // _CHUNK) if (part := table[c * _CHUNK : (c + 1) * _CHUNK]).any()])

    def packed(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([narrow(r[2]) for r in rows], pa.binary())],
            names=["chunk", "salt", "counts"],
        )

    def narrow(part):
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if part.max(initial=0) <= np.iinfo(k).max)
        return bytes([np.dtype(kind).itemsize]) + part.astype(kind).tobytes()

    def widen(raw):
        return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)

    def total(rows: pa.Table) -> pa.Table:
        part = narrow(sum(widen(raw) for raw in rows["counts"].to_pylist()))
        return rows.slice(0, 1).set_column(2, "counts", pa.array([part], pa.binary()))

    kind = "chunk int, salt int, counts binary"
    parts = docs.select("text").mapInArrow(count, kind).groupBy("chunk", "salt").applyInArrow(total, kind).groupBy("chunk").applyInArrow(total, kind)
    table, n = np.zeros(FEATURES, np.int64), 0
    for r in parts.collect():  # at most FEATURES / 1024 + 1 rows
        if r.chunk < 0:
            n = int(widen(bytes(r.counts))[0])
        else:
            table[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = widen(bytes(r.counts))
    return n, table


def feature_weights(n: int, counts: np.ndarray) -> np.ndarray:
    """Inverse document frequency, scaled to lie between 1 and about 1.5.

    An unscaled one would let the size of a group of near copies drive them apart:
    what they share becomes common and light, each one's edits stay rare and heavy.
    """
    rarity = np.log1p(n / np.maximum(counts, 1.0)) / np.log1p(max(n, 1))
    return (1 + 0.5 * rarity).astype(np.float32)


def _gamma_quantiles(size: int) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 at the middles of ``size`` equal parts, by bisection."""
    p = (np.arange(size) + 0.5) / size
    low, high = np.zeros(size), np.full(size, 60.0)
    for _ in range(80):
        mid = (low + high) / 2
        under = 1 - np.exp(-mid) * (1 + mid) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return ((low + high) / 2).astype(np.float32)


_tables: list[np.ndarray] = []


def weighted_samples(row: np.ndarray, key: np.ndarray, weight: np.ndarray, rows: int, k: int = BANDS * ROWS) -> np.ndarray:
    """k consistent weighted samples of each row's weighted set, as (rows, k) 32-bit names; 0 for empty rows.

    For shingle x of weight S and sample j: r, c ~ Gamma(2, 1) and b ~ U(0, 1) are
    drawn from a hash of (x, j); t = floor(ln S / r + b); the sample is the (x, t)
    of the least ln c - r (t - b) - r.
    """
    if not _tables:
        _tables.extend([r := _gamma_quantiles(1024), 1 / r, np.log(_gamma_quantiles(4096))])
    gamma, inverse, log_gamma = _tables
    out = np.zeros((rows, k), np.uint32)
    if not len(key):
        return out
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    size = np.diff(np.append(start, len(row)))
    of = row[start]
    log_weight = np.log(weight).astype(np.float32)
    base = (mix(key + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype(np.uint32)
    for j in range(k):
        h = base ^ np.uint32((j + 1) * 0x9E3779B1 % (1 << 32))
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
        a = (h >> np.uint32(22)).astype(np.intp)
        r = gamma.take(a)
        b = (h & np.uint32(1023)).astype(np.float32)
        b *= np.float32(2.0**-10)
        t = inverse.take(a)
        t *= log_weight
        t += b
        np.floor(t, out=t)
        value = b - t
        value -= 1
        value *= r
        value += log_gamma.take(((h >> np.uint32(10)) & np.uint32(4095)).astype(np.intp))
        least = np.minimum.reduceat(value, start)
        hit = np.flatnonzero(value == np.repeat(least, size))
        at = hit[np.searchsorted(hit, start)]
        out[of, j] = (mix(key[at] ^ (t[at].astype(np.int64).astype(np.uint64) << np.uint64(48))) >> np.uint64(32)).astype(np.uint32)
    return out


def sketches(docs: DataFrame, weights) -> DataFrame:
    """(doc_id, node, samples): node is the digest of the text's words, samples the packed weighted samples (null: no words)."""

    @lean
    def sketch(batches):
        table = weights.value
        for batch in batches:
            ids, digests, text = batch.column(0), batch.column(1), batch.column(2)
            parts = []
            for row, end, data, offsets in _blocks(text):
                of, key, tf, _ = shingle_keys(data, offsets)
                weight = tf * table[(key & np.uint64(FEATURES - 1)).astype(np.int64)]
                samples = weighted_samples(of, key, weight, end - row)
                filled = np.zeros(end - row, bool)
                filled[of] = True
                parts += [s.tobytes() if f else None for s, f in zip(samples, filled)]
            yield pa.RecordBatch.from_arrays([ids, digests, pa.array(parts, pa.binary())], names=["doc_id", "node", "samples"])

    return docs.select("doc_id", "node", "text").mapInArrow(sketch, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node binary, samples binary")


def weighted_jaccard(pairs: DataFrame, weights) -> DataFrame:
    """(a, b, similarity) of each row of ``pairs`` (a, b, text_a, text_b): sum of least over sum of largest tf x idf."""

    @lean
    def verify(batches):
        table = weights.value
        for batch in batches:
            both = pa.table(batch)
            for at in range(0, both.num_rows, 512):
                part = both.slice(at, 512)
                sides = []
                for name in ("text_a", "text_b"):
                    row, key, weight = [], [], []
                    for first, _, data, offsets in _blocks(part[name]):
                        r, k, tf, _ = shingle_keys(data, offsets)
                        row.append(r + first)
                        key.append(k)
                        weight.append(tf * table[(k & np.uint64(FEATURES - 1)).astype(np.int64)])
                    sides.append([np.concatenate(x) for x in (row, key, weight)])
                (ra, ka, wa), (rb, kb, wb) = sides
                n = part.num_rows
                key = np.concatenate([(ra.astype(np.uint64) << np.uint64(48)) | ka, (rb.astype(np.uint64) << np.uint64(48)) | kb])
                weight = np.concatenate([wa, wb])
                order = np.argsort(key, kind="stable")
                key, weight = key[order], weight[order]
                same = np.flatnonzero(key[1:] == key[:-1])
                shared = np.bincount((key[same] >> np.uint64(48)).astype(np.int64), np.minimum(weight[same], weight[same + 1]), n)
                whole = np.bincount(ra, wa, n) + np.bincount(rb, wb, n) - shared
                yield pa.RecordBatch.from_arrays(
                    [part["a"].combine_chunks(), part["b"].combine_chunks(), pa.array(np.divide(shared, whole, out=np.zeros(n), where=whole > 0))], names=["a", "b", "similarity"]
                )

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a binary, b binary, similarity double")


def tile_links(members: DataFrame, weights) -> DataFrame:
    """Links (a, b) that join classes, among ``members`` (bucket, node, label, text) of one bucket.

    A bucket is dealt into blocks by a hash of the node, and each pair of blocks is
    one group of rows: a large bucket is many tasks, each of bounded memory. Shared
    weight is a product of matrices (row x shingle), where a shingle that a text has
    n times counts as n columns, so that products give the least of both counts.
    """
    size = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("bytes") / BLOCK_BYTES)).cast("int")
    dealt = members.join(size.select("bucket", blocks.alias("blocks")), "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label", "text")
    tiles = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "block", "node")

    @lean
    def compare(batches):
        table, held, key = weights.value, [], None
        for batch in batches:
            rows = pa.table(batch)
            marks = np.stack([rows[c].to_numpy() for c in ("bucket", "i", "j")], 1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(marks)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                if held and key != tuple(marks[begin]):
                    yield linked(pa.concat_tables(held), table)
                    held = []
                key = tuple(marks[begin])
                held.append(rows.slice(begin, end - begin))
        if held:
            yield linked(pa.concat_tables(held), table)

    def linked(rows, table):
        a, b = _tile(rows["text"], rows["block"].to_numpy(), rows["label"].to_pylist(), table)
        nodes = rows["node"].combine_chunks()
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(a, pa.int64())), nodes.take(pa.array(b, pa.int64()))], names=["a", "b"])

    return tiles.mapInArrow(compare, "a binary, b binary")


def _tile(text, block: np.ndarray, labels: list, table: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs of rows that join classes: rows of the tile's two blocks, or of its one."""
    n, row, key, tf = len(block), [], [], []
    for first, _, data, offsets in _blocks(text):
        r, k, t, _ = shingle_keys(data, offsets)
        row, key, tf = [*row, r + first], [*key, k], [*tf, t]
    row, key, tf = map(np.concatenate, (row, key, tf))
    weight = table[(key & np.uint64(FEATURES - 1)).astype(np.int64)]
    whole = np.bincount(row, weight * tf, n)
    level = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
    row, weight = np.repeat(row, tf), np.repeat(weight, tf)
    column, count = np.unique(mix(np.repeat(key, tf) + (level.astype(np.uint64) << np.uint64(48))), return_inverse=True, return_counts=True)[1:]
    # A column of one row shares nothing.
    kept = count[column] > 1
    row, weight = row[kept], np.sqrt(weight[kept])
    column = np.unique(column[kept], return_inverse=True)[1]
    split = int(np.searchsorted(block, block[-1])) if n else 0
    left, right = (slice(0, split), slice(split, n)) if split else (slice(0, n), slice(0, n))
    shared = np.zeros((left.stop - left.start, right.stop - right.start))
    order = np.argsort(column, kind="stable")
    row, column, weight = row[order], column[order], weight[order]
    width = 2048
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + width + 1, width))
    for a, b in zip(edges, edges[1:]):
        part = np.zeros((n, width), np.float32)
        part[row[a:b], column[a:b] % width] = weight[a:b]
        shared += part[left] @ part[right].T
    similarity = shared / np.maximum(whole[left, None] + whole[None, right] - shared, 1e-9)
    # Sums of 32-bit products differ by a few millionths from exact ones.
    x, y = np.nonzero(similarity >= SIMILARITY - 1e-6)
    parent = {v: v for v in labels}

    def find(v):
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    out: tuple[list[int], list[int]] = ([], [])
    for i, j in zip(x + left.start, y + right.start):
        u, v = find(labels[i]), find(labels[j])
        if u != v:
            parent[max(u, v)] = min(u, v)
            out[0].append(i)
            out[1].append(j)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, label): each linked node and the least node of its component.

    Rounds of taking the least label among neighbours, then the label's label.
    Each round's table is written to the shared folder; a vertex of very many
    links costs partial minima only.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), "label")
        jump = step.select(F.col("node").alias("at"), F.col("next").alias("far"))
        moved = written(
            step.join(jump, F.col("next") == F.col("at"), "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), (F.least("next", F.coalesce("far", "next")) != F.col("label")).alias("changed")), "labels"
        )
        labels = moved.select("node", "label")
        if not moved.filter("changed").limit(1).count():
            return labels


def node_of(text: str = "text"):
    """Digest of a text; equal texts are one node from the start, equal word sequences by a link of similarity 1."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, node, label): label is the least node of the class, for each row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"), node_of().alias("node"))
    n, counts = feature_counts(base)
    weights = spark.sparkContext.broadcast(feature_weights(n, counts))
    rows = written(sketches(base, weights), "sketches")
    nodes = rows.filter("samples is not null").groupBy("node").agg(F.first("samples").alias("samples"))
    width = 4 * ROWS
    bands = nodes.select("node", F.explode(F.array(*[F.struct(F.lit(j).alias("band"), F.substring("samples", j * width + 1, width).alias("value")) for j in range(BANDS)])).alias("b"))
    bands = bands.select("node", F.xxhash64("b.band", "b.value").alias("bucket"))
    least = bands.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("bucket", "a")
    crowded = written(bands.join(least, "bucket"), "buckets")
    # The texts that can be compared, each once.
    wanted = crowded.select("node").distinct()
    texts = written(base.select("node", "text").join(wanted, "node", "left_semi").dropDuplicates(["node"]), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return written(weighted_jaccard(joined, weights).filter(F.col("similarity") >= SIMILARITY).select("a", "b"), "links")

    # First round: members of a bucket with its least node.
    links = verified(crowded.filter("node > a").select("a", F.col("node").alias("b")).distinct())
    labels = components(links)
    # Second round: all pairs of the buckets that still hold more than one class.
    told = crowded.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    sets = told.groupBy("bucket").agg(F.bit_xor(F.xxhash64("node")).alias("members"), F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    # Of buckets with the same members one is enough.
    split = sets.groupBy("members", "n").agg(F.min("bucket").alias("bucket")).select("bucket")
    rest = written(told.join(split, "bucket", "left_semi").join(texts, "node"), "rest")
    more = written(tile_links(rest, weights), "links")
    if more.limit(1).count():
        labels = components(links.union(more))
    told = spread_join(rows.select("doc_id", "node"), labels, ["node"], ["doc_id"], "left")
    return told.select("doc_id", "node", F.coalesce("label", "node").alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id): class_id is the least doc_id of the document's class.

    Two documents share a class if a chain of links joins them, a link being equal
    texts or a weighted Jaccard similarity of at least ``SIMILARITY``.

    A null text is an empty one. Texts without words are linked to equal texts only;
    a null doc_id keeps its row and takes part. Repeated rows each give a row, an empty
    table none. Other columns are ignored. Words are compared in lower case.
    """
    told = written(classes(docs), "classes")
    first = told.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return spread_join(told, first, ["label"], ["doc_id"]).select("doc_id", "class_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each class, with all its columns: of the least doc_id, rows without one last."""
    told = classes(docs)
    first = told.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first"))
    keep = first.select(F.col("first.doc_id").alias("__id"), F.col("first.node").alias("__node"))
    keyed = docs.withColumn("__own", node_of())
    kept = keyed.join(keep, (F.col("__own") == F.col("__node")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return kept.dropDuplicates(["__own"]).select(*docs.columns)
