"""Which hash values occur more than once in a corpus: a bit table of fixed size, summed over tasks.

A set bit may be wrong (two values share a slot), a clear bit never is. Operators use it to keep what surely occurs once out
of a shuffle; their results don't depend on it. The table's size is a bound of what is broadcast, however large the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Slots of a table, as a power of two (16 MB of bits), and of the chunks in which they are summed.
BITS, CHUNK_BITS = 27, 21


def slots(values: np.ndarray, bits: int) -> np.ndarray:
    return (values & np.uint64((1 << bits) - 1)).astype(np.int64)


def packed(places: np.ndarray) -> bytes:
    """Rising places as their differences: all low bytes, then all higher ones, which are nearly always 0."""
    return zlib.compress(np.diff(places, prepend=places.dtype.type(0)).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(flat.T).view("<i4").ravel())


def task_parts(values: np.ndarray, bits: int = BITS) -> list[tuple[int, bytes]]:
    """What a task tells of its values (uint64, repeats included): for each chunk its slots, those seen more often twice."""
    found, n = np.unique(slots(values, bits), return_counts=True)
    both = np.concatenate([found, found[n > 1]])
    both.sort(kind="stable")
    cut = np.searchsorted(both, np.arange((1 << bits >> CHUNK_BITS) + 1) << CHUNK_BITS)
    local = (both & ((1 << CHUNK_BITS) - 1)).astype("<i4")
    return [(c, packed(local[a:b])) for c, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]


#: Bytes of the tasks' parts that one stream sums.
STREAM_BYTES, STREAM_FAN = 32 << 20, 64


def table(parts: DataFrame, bits: int = BITS) -> np.ndarray:
    """The bits, packed, from rows (chunk int, data binary) of all tasks. Each chunk is summed in streams of about STREAM_BYTES,
    whose sums (counts up to 2, so of bounded size) are summed again, STREAM_FAN at a time, until one is left."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        # Rows come by chunk, so one chunk's counts are held, however many chunks a task has.
        now, count = None, np.zeros(0, dtype=np.uint8)
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if chunk != now:
                    if now is not None:
                        yield now, count
                    now, count = chunk, np.zeros(1 << CHUNK_BITS, dtype=np.uint8)
                data = data.as_py()
                at = unpacked(data)
                more = at[1:][at[1:] == at[:-1]]
                count[at] = np.minimum(count[at] + 1, 2)
                count[more] = 2
        if now is not None:
            yield now, count

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, count in add(batches):
            at = np.flatnonzero(count)
            local = np.repeat(at, count[at]).astype("<i4")
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([packed(local)], pa.binary())], ["chunk", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, count in add(batches):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([zlib.compress(np.packbits(count > 1).tobytes(), 1)], pa.binary())], ["chunk", "data"])

    out, width = np.zeros(1 << bits >> 3, dtype=np.uint8), 1 << CHUNK_BITS >> 3
    told = parts.where(F.col("data").isNotNull()).select("chunk", "data")
    size = told.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    streams = -(-size // (STREAM_BYTES * (1 << bits >> CHUNK_BITS)))
    while streams > 1:
        dealt = told.withColumn("stream", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(streams)))
        told = staged(dealt.repartition("chunk", "stream").sortWithinPartitions("chunk", "stream").select("chunk", "data").mapInArrow(merge, "chunk int, data binary"), "table-sums")
        streams = streams // STREAM_FAN
    summed = told.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk int, data binary")
    rows = summed.collect()
    while rows:  # each row is freed as it is read
        chunk, data = rows.pop()
        out[chunk * width : (chunk + 1) * width] = np.frombuffer(zlib.decompress(data), dtype=np.uint8)
    return out


def maybe_repeated(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = slots(values, len(table).bit_length() + 2)
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
