"""Token counts by a separator scan of flat, unindexed token files.

A token file is a plain run of little-endian 16-bit ids, each document closed by the end-of-document id; nothing in it or
beside it says where documents are. Spark's text writer makes such files on any file system: a document's ids are a line's
bytes, and the line separator is the end-of-document id. For a scan a file is cut into blocks of equal size with no regard to
documents. Every block is searched by itself, vectorised; a prefix scan over the blocks' sums (tokens, separators, place of
the last separator) then stitches the documents that cross block boundaries. The scan has two levels (groups of blocks, then
blocks), so that one huge file is not one task; files beyond WHOLE bytes are read by byte ranges.

Which document is the nth of a file is told by a list of ids that the same task writes in the same order. A file holds what one
task has encoded. Edge cases: an empty document (also a null text) is a separator only and has 0 tokens; tokens behind the last
separator of a file are a document that isn't closed (terminated false); empty files and tables give no rows; ids of documents
may repeat or be null; a file with an odd number of bytes is an error.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401  used as pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import codec, read_ranks
from .common import P, fresh_path, slices, staged

#: Tokens in a block, and blocks in a group of the scan.
BLOCK_TOKENS, GROUP_BLOCKS = 1 << 16, 1 << 10


#: Bytes up to which a file is read as one; larger ones are read by byte ranges, by a file system that Arrow knows.
WHOLE = 256 << 20


def write_token_files(docs: DataFrame, path: str, pattern: str, eod: int, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Encodes documents into flat token files in the shared folder, one for each partition.

    Returns the files' blocks (file, block, data) and the order of the documents in them (file, nth, doc_id).
    """
    spark, at = docs.sparkSession, fresh_path(docs.sparkSession, "token-files")
    tokens = spark.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, nth = codec(tokens.value, pattern), 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                n, made = part.num_rows, list(own.encode_short(part.column(1).to_pylist()))
                ids = [struct.pack("<?q", i is not None, i or 0) for i in part.column(0).to_pylist()]
                rows = pa.array(np.tile(np.arange(nth, nth + n), 2))
                yield pa.RecordBatch.from_arrays([pa.array(["ids"] * n + ["tokens"] * n), rows, pa.array(ids + made, pa.binary())], ["kind", "nth", "data"])
                nth += n
        own.forget()

    made = docs.select(F.col(id_col).cast("bigint").alias(P + "id"), F.col(text_col).alias("text")).mapInArrow(run, "kind string, nth bigint, data binary")
    separator = np.array([eod], dtype="<u2").tobytes().decode("latin-1")
    lines = made.sortWithinPartitions("kind", "nth").select("kind", F.col("data").cast("string").alias("value"))
    lines.write.partitionBy("kind").option("encoding", "ISO-8859-1").option("lineSep", separator).text(at)
    number = F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("int")
    of = lambda kind: F.col("file").contains(f"/kind={kind}/")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0), batch.column(1), strict=True):
                told = np.frombuffer(data.as_buffer(), dtype=np.dtype([("has", "?"), ("id", "<i8"), ("end", "<u2")]))
                for k in range(0, len(told), 1 << 16):
                    part = told[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(part), pa.int32()), pa.array(np.arange(k, k + len(part))), pa.array(part["id"], mask=~part["has"])], ["file", "nth", "doc_id"])

    lists = _files(spark, at).where(of("ids")).select(number.alias("file"), "content")
    blocks = read_token_files(spark, at, block_tokens, of("tokens"))
    return blocks.withColumn("file", number), lists.mapInArrow(ids, "file int, nth bigint, doc_id bigint")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """file, length, content of the files below path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("file"), "length", "content").where(~F.col("file").rlike("/[._][^/]*$"))


def read_token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, chosen: Column | None = None, whole: int = WHOLE) -> DataFrame:
    """The blocks (file, block, data) of flat token files below path, those that chosen (over file) names or all."""
    found = _files(spark, path)
    found = found if chosen is None else found.where(chosen)
    size = 2 * block_tokens

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, length, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, where = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", file))
                with system.open_input_file(where) as f:
                    data = f.read_at(min(size, length - block * size), block * size)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], ["file", "block", "data"])

    schema = "file string, block bigint, data binary"
    even = F.when(F.col("length") % 2 == 1, F.raise_error(F.concat(F.lit("odd number of bytes: "), "file")).cast("bigint")).otherwise(F.col("length"))
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((even - 1) / size))).alias("block")
    # Cut in the JVM, so that a whole file is never in a Python worker.
    small = found.where((F.col("length") > 0) & (F.col("length") <= whole)).select("file", "content", number)
    small = small.select("file", "block", F.substring("content", (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("data"))
    large = found.where(F.col("length") > whole).select("file", "length", number).repartition("file", "block").mapInArrow(ranged, schema)
    return small.unionByName(large)


def block_sums(blocks: DataFrame, eod: int) -> DataFrame:
    """file, block, n_tokens and the separators' places in each block; blocks are independent of each other."""
    schema = f"file {dict(blocks.dtypes)['file']}, block bigint, n_tokens bigint, places array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, places = [], []
            for data in batch.column(2):
                ids = np.frombuffer(data.as_buffer(), dtype="<u2")
                size.append(len(ids))
                places.append(np.flatnonzero(ids == eod).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(places, pa.list_(pa.int32()))], ["file", "block", "n_tokens", "places"])

    return blocks.select("file", "block", "data").mapInArrow(run, schema)


def before(df: DataFrame, values: dict[str, tuple[Column, str]]) -> DataFrame:
    """df (file, block, ...) with, for each name, the sum or max of the column over the file's earlier blocks, in two levels."""
    d = df.withColumn(P + "group", F.floor(F.col("block") / GROUP_BLOCKS)).withColumns({P + n: c for n, (c, _) in values.items()})
    how = {"sum": F.sum, "max": F.max}
    over = Window.partitionBy("file").orderBy(P + "group").rowsBetween(Window.unboundedPreceding, -1)
    groups = d.groupBy("file", P + "group").agg(*[how[h](P + n).alias(P + "g_" + n) for n, (_, h) in values.items()])
    groups = groups.select("file", P + "group", *[how[h](P + "g_" + n).over(over).alias(P + "b_" + n) for n, (_, h) in values.items()])
    within = Window.partitionBy("file", P + "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(groups, ["file", P + "group"])
    out = {}
    for n, (_, h) in values.items():
        here, carried = how[h](P + n).over(within), F.col(P + "b_" + n)
        out[n] = F.greatest(here, carried) if h == "max" else F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0))
    return d.withColumns(out).drop(P + "group", *[P + n for n in values], *[P + "b_" + n for n in values])


def scan(blocks: DataFrame, eod: int) -> DataFrame:
    """One row per document of the token files: file, nth (from 0), start, n_tokens, terminated."""
    sums = staged(block_sums(blocks, eod), "block-sums")
    d = before(sums.select("file", "block", "n_tokens", F.size("places").alias("n_seps"), F.array_max("places").alias("last")), {"offset": (F.col("n_tokens"), "sum"), "docs_before": (F.col("n_seps"), "sum")})
    d = before(d, {"carry": (F.col("offset") + F.col("last"), "max")})
    d = d.select("file", "block", "offset", "docs_before", F.coalesce(F.col("carry") + 1, F.lit(0)).alias("begin"))
    places = sums.join(d, ["file", "block"])
    found = places.select("file", "offset", "docs_before", "begin", "places", F.posexplode("places").alias("k", "place"))
    start = F.when(F.col("k") == 0, F.col("begin")).otherwise(F.col("offset") + F.element_at("places", F.greatest(F.col("k"), F.lit(1))) + 1)
    closed = found.select("file", (F.col("docs_before") + F.col("k")).alias("nth"), start.alias("start"), (F.col("offset") + F.col("place") - start).cast("bigint").alias("n_tokens"), F.lit(True).alias("terminated"))
    whole = places.groupBy("file").agg(
        F.sum(F.size("places")).alias("nth"), F.sum("n_tokens").alias("tokens"), F.coalesce(F.max(F.col("offset") + F.array_max("places")) + 1, F.lit(0)).cast("bigint").alias("start"),
    )
    open_ = whole.where("tokens > start").select("file", "nth", "start", (F.col("tokens") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return closed.unionByName(open_)


def count_tokens(docs: DataFrame, path: str, pattern: str, eod: int) -> DataFrame:
    """Writes the documents as token files and finds them again by a scan: doc_id, file (the number of the task that wrote it), nth,
    start, n_tokens."""
    blocks, order = write_token_files(docs, path, pattern, eod)
    return order.join(scan(blocks, eod).where("terminated"), ["file", "nth"]).select("doc_id", "file", "nth", "start", "n_tokens")
