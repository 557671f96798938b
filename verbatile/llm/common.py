"""Shared helpers: the shared folder, staged tables, and vectorised word scanning of Arrow batches."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column names that the operators make carry this prefix, so that callers' extra columns never clash.
P = "__v_"
#: ASCII white space that separates words: 0x20 and 0x09 to 0x0D.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Values of a class column that a sample is drawn by, at most.
MOST_CLASSES = 2_000

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
#: Everything of ASCII but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TAIL = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=np.uint64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one is set only where none is in local mode, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = own.get() if own.isDefined() else None
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="verbatile-")
        spark.sparkContext.setCheckpointDir(path)
    return path


_FRESH: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/verbatile-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    _FRESH.append(path)
    return path


def given_paths() -> set[str]:
    """The paths that fresh_path has given and that are still there."""
    return set(_FRESH)


def discard(spark: SparkSession, paths: set[str]) -> None:
    """Deletes paths that fresh_path has given. Only for a caller that has written all tables made from them."""
    for path in paths & set(_FRESH):
        _remove(spark, path)
        _FRESH.remove(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of tables that nothing refers to any more; it only does where garbage is collected,
    which a driver with room to spare hardly ever does by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    return staged_at(df, name)[0]


def staged_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same, and where it is, for callers who discard it themselves."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans. data must hold 8 more bytes than the last end."""
    size = ends - starts
    h = mix64(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    words = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    at, left, rows = starts, size, None
    while len(at):
        part = words[at] & _TAIL[np.minimum(left, 8)]
        if rows is None:
            h = mix64(h ^ part)
        else:
            h[rows] = mix64((h[rows] + np.uint64(0x9E3779B97F4A7C15)) ^ part)
        more = np.flatnonzero(left > 8)
        rows = more if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8
    return h


class Words:
    """The words of a slice of texts: bytes, spans, the first word of each text, and 64-bit hashes on demand."""

    def __init__(self, texts: pa.Array, lower: bool = False, spaces: np.ndarray = _IS_SPACE):
        """lower: A-Z lowered first. spaces: for each byte value whether it separates words."""
        texts = texts.cast(pa.large_string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=texts.offset + n + 1)[texts.offset :]
        raw = texts.buffers()[2]
        lo, hi = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
        data = np.zeros(hi - lo + 8, dtype=np.uint8)
        if hi > lo:
            data[: hi - lo] = np.frombuffer(raw, dtype=np.uint8, count=hi - lo, offset=lo)
        self.cuts = offsets - lo if n else np.zeros(1, dtype=np.int64)
        if lower:
            data = _LOWER[data]
        self.data = data
        # Spans come from the places where "in a word" changes; a text's end counts as a space.
        inside = np.zeros(hi - lo + 1, dtype=bool)
        np.logical_not(spaces[data[: hi - lo]], out=inside[: hi - lo])
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begin = self.cuts[:-1][self.cuts[:-1] < hi - lo]
        first[begin] = inside[begin]
        self.starts = np.flatnonzero(first)
        last = np.zeros_like(inside)
        last[1:] = inside[:-1] & ~inside[1:]
        inner = self.cuts[1:]
        inner = inner[inner > 0]
        last[inner] |= inside[inner - 1]
        self.ends = np.flatnonzero(last)
        self.first = np.searchsorted(self.starts, self.cuts)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)

    def docs(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def joined(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """The words of text i, or those that keep marks, joined by one space."""
        a, b = int(self.first[i]), int(self.first[i + 1])
        s, e = self.starts[a:b], self.ends[a:b]
        if keep is not None:
            s, e = s[keep], e[keep]
        if not len(s):
            return b""
        lo, hi = int(self.cuts[i]), int(self.cuts[i + 1])
        # +1 at each start and -1 behind the space that follows each end: what is left of the text in order.
        mark = np.zeros(hi - lo + 2, dtype=np.int8)
        mark[s - lo] = 1
        mark[e - lo + 1] -= 1
        part = self.data[lo : hi + 1].copy()
        part[e - lo] = 32
        return part[np.cumsum(mark, dtype=np.int8)[: hi - lo + 1] > 0][:-1].tobytes()


def slices(batch: pa.RecordBatch, text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about limit bytes of text, so that vectorised steps stay in bounded memory; nulls become empty."""
    i = batch.schema.get_field_index(text)
    texts = batch.column(i)
    if texts.null_count:
        texts = texts.fill_null("")
    batch = batch.set_column(i, text, texts)
    size = np.asarray(pa.compute.binary_length(texts)).astype(np.int64)
    ends = np.cumsum(size)
    at, n = 0, len(size)
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, many: int = 10_000) -> DataFrame:
    """rows and their groups' other columns, joined by keys (not null). size: the groups' column with their number of rows, of
    total in all. A group with more than one row in many is one of at most many: those are broadcast, so that no task gets all
    rows of a large group."""
    large = F.col(size) > total / many
    first = rows.join(F.broadcast(groups.where(large)), keys)
    rest = rows.join(F.broadcast(groups.where(large).select(*keys)), keys, "left_anti").join(groups.where(~large), keys)
    return first.unionByName(rest)


def maybe_among(rows: DataFrame, few: DataFrame, keys: list[str], most_bits: int = 1 << 27) -> DataFrame:
    """The rows whose keys may be those of a row of few: surely all of these, and some others. A table of 16 to 32 bits for each row of few,
    most_bits at most, in broadcast pieces of 4 KB that meet the rows by the piece's number; a fuller table rules out less."""
    pieces = max(1, min(most_bits >> 15, 1 << max(0, (few.count() * 16 >> 15).bit_length())))
    # pieces is a power of two. A place is never null, so no filter on it is pushed below the keys, which would be made twice.
    place = F.xxhash64(*keys).bitwiseAND(F.lit((pieces << 15) - 1).cast("bigint"))
    bits = few.select(*keys).groupBy(F.bitmap_bucket_number(place).alias(P + "piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(P + "bits"))
    at = F.bitmap_bit_position(F.col(P + "place"))
    met = rows.withColumn(P + "place", place).join(F.broadcast(bits), F.bitmap_bucket_number(F.col(P + "place")) == F.col(P + "piece"))
    byte = F.conv(F.hex(F.substring(F.col(P + "bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.where(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1).drop(P + "place", P + "piece", P + "bits")


def hashed_sample(df: DataFrame, by: str, per_class: int, seed: int = 17) -> tuple[DataFrame, dict]:
    """About per_class rows of each value of the column by (all of a smaller class), chosen by a hash of doc_id, and the
    number of rows of each class. Needs the columns doc_id and by, with at most MOST_CLASSES values of by."""
    total = {r[0]: r[1] for r in df.groupBy(by).count().limit(MOST_CLASSES + 1).collect()}
    if len(total) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} values of {by}")
    share = F.coalesce(*[F.when(F.col(by) == F.lit(k), F.lit(min(1.0, per_class / n))) for k, n in sorted(total.items())]) if total else F.lit(0.0)
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return df.where(place < share), total
