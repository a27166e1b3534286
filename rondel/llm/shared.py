"""Helpers shared by the operators for training-data pipelines.

Text work that SQL functions cannot state runs through ``mapInArrow``: the
string column's Arrow buffers are viewed as one byte array, so a whole slice of
documents is tokenised and hashed by a few array operations.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that array operations handle at once; bounds a task's memory.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset
    a temporary folder serves a local master (tests); on a cluster it is an error, as
    executors don't see each other's folders.
    """
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
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation,
    and a table used twice is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch that Spark hands to a worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches are cut by bytes: ten thousand rows of long texts would be too much for a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return what this process no longer needs to the system."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(work):
    """``work`` (batches -> batches), after which the worker gives its free memory back.

    Workers outlive their tasks; what they keep is missing to the stages that follow.
    """

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


#: Parts that ``spread_join`` deals the rows of one key into.
SALTS = 32


def spread_join(rows: DataFrame, few: DataFrame, keys: list[str], salt_by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``few``, which has one row for each key at most, without one task for a key of very many rows.

    Rows are dealt into ``SALTS`` parts by a hash of ``salt_by``; the row of ``few`` goes to the
    parts of its key that there are. how: inner or left.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)))
    slots = salted.select(*keys, "__salt").distinct().join(few, keys)
    return salted.join(slots, [*keys, "__salt"], how).drop("__salt")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about ``size`` bytes; a row is never cut."""
    data, offsets = text_buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 64)
        for i, base in enumerate((_BASE, _BASE_INV)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of a polynomial over all beginnings of the bytes, from which ``span_hashes`` tells spans."""
    power, _ = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    return sums


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each span of bytes: prefix sums of a polynomial, shifted to position 0. ``sums``: those of ``data``, where they are known."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = prefix_sums(data) if sums is None else sums
    return mix((sums[ends] - sums[starts]) * _power_tables(len(data) + 1)[1][starts])


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of each word, a longest run of bytes that aren't separators; words never span rows."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge[: len(data)])
    starts = cuts[inside[cuts]]
    ends = np.append(cuts[1:], len(data))[inside[cuts]]
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
