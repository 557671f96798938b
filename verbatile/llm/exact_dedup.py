"""Exact deduplication with streaming state, in DataFrame operations only.

Arrivals (stable id, digest of the normalised text, its length, and a content locator: the file and the row in it that hold
the text) flow through a streaming aggregation whose state lives on disk in RocksDB, keyed by digest and length and without
watermark, so it never expires. A trigger takes in a bounded amount of arrivals, so what comes later hits what the state
holds of earlier ones. The state keeps for each key the id and the locator of the row that stays, and the group's size.
Every hit is checked on the full bytes of the texts; where two texts share a digest (never seen for SHA-256) the group is dealt
again by the texts themselves.

Documents that do not come from Parquet files are written to the shared folder first, which gives them locators. The check
reads all texts but shuffles only those that a table of bits of fixed size doesn't rule out as hits. Groups with more than one
row in MANY are at most MANY, and are broadcast; so no task gets all rows of a huge group of copies.

Texts are equal when identical after lower-casing A-Z only. Edge cases: null text counts as empty; all empty texts are one
group; the largest id of a group stays; rows that repeat an id are rows of their own, and of rows equal in id and text all are
marked kept, but kept_documents() keeps one; ids that are null lose against any other; an empty table gives an empty one;
extra columns are not read, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import P, fresh_path, join_groups, maybe_among, staged

#: Digests that one state store is sized for, and the most stores. A store has about 4 MB of files however little it holds, so
#: their number follows the rows, not the shuffle partitions; it stays as it is for the life of a checkpoint.
STORE_ROWS, MOST_STORES = 20_000, 2_048
#: Arrivals that a trigger takes in.
TRIGGER_BYTES = 64 << 30
#: One row in so many makes a group a broadcast one; and bits of the table of hits (a power of two), at most.
MANY, HIT_BITS = 10_000, 1 << 27
#: State store of the streaming query; memory of all its instances in an executor is bounded together.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

#: What the state is keyed by.
KEY = ["digest", "n_bytes"]


def normalised(text: Column) -> Column:
    """A-Z lowered, nothing else; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


_LOCATOR = {P + "file": "_metadata.file_path", P + "row": "_metadata.row_index"}


def file_backed(docs: DataFrame) -> DataFrame:
    """docs, staged first if it isn't read from Parquet."""
    try:
        docs.select(*_LOCATOR.values())
    except AnalysisException:
        return staged(docs, "contents")
    return docs


def located(docs: DataFrame) -> DataFrame:
    """docs (file-backed) with its rows' content locators (file, row) in columns of our own."""
    return docs.select("*", *[F.col(c).alias(name) for name, c in _LOCATOR.items()])


def arrivals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_hex) -> DataFrame:
    """What the state is told of each row: id, digest, bytes and content locator."""
    norm = normalised(F.col(text_col))
    return located(file_backed(docs)).select(
        F.col(id_col).cast("bigint").alias("doc_id"), digest(norm).alias("digest"), F.octet_length(norm).cast("bigint").alias("n_bytes"),
        F.col(P + "file").alias("file"), F.col(P + "row").alias("row"),
    )


def update_state(spark: SparkSession, arrived_path: str, state_dir: str, stores: int = 8, trigger_bytes: int = TRIGGER_BYTES) -> DataFrame:
    """Feeds new files of arrivals to the state kept under state_dir and returns all groups so far: digest, n_bytes, keep_id, file
    and row (where the text that stays is), group_size.

    Call it again when more files have come: the checkpoint remembers the files that were read, and the state, without
    expiry, what they held. stores: number of state stores, fixed by the first run. Each trigger writes the groups that it
    touched; of a key the largest group size is the latest.
    """
    own = spark.newSession()
    for k, v in STATE_CONF.items():
        own.conf.set(k, v)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.streaming.internal.stateStore.partitions", str(stores))
    schema = "doc_id bigint, digest string, n_bytes bigint, file string, row bigint"
    keyed = (
        own.readStream.schema(schema).option("maxBytesPerTrigger", str(trigger_bytes)).parquet(arrived_path).groupBy(*KEY)
        .agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    )
    out = f"{state_dir}/groups"

    def write(touched: DataFrame, number: int) -> None:
        touched.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = keyed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    groups = "digest string, n_bytes bigint, keep struct<doc_id: bigint, file: string, row: bigint>, group_size bigint"
    files = spark.read.schema(groups).option("basePath", out).parquet(out) if query.lastProgress or _exists(spark, out) else spark.createDataFrame([], groups)
    latest = files.groupBy(*KEY).agg(F.max(F.struct("group_size", "keep")).alias("last"))
    return latest.select(*KEY, F.col("last.keep.doc_id").alias("keep_id"), F.col("last.keep.file").alias("file"), F.col("last.keep.row").alias("row"), F.col("last.group_size").alias("group_size"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def groups_of(docs: DataFrame, id_col: str, text_col: str, digest) -> tuple[DataFrame, DataFrame, int]:
    """The arrivals, written; the state's groups, written; and the number of arrivals."""
    spark = docs.sparkSession
    arrived = fresh_path(spark, "arrivals")
    arrivals(docs, id_col, text_col, digest).write.parquet(arrived)
    told = spark.read.parquet(arrived)
    rows = told.count()
    return told, staged(update_state(spark, arrived, fresh_path(spark, "dedup-state"), max(8, min(MOST_STORES, rows // STORE_ROWS))), "dedup-groups"), rows


def maybe_hit(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of texts (with KEY) whose group may have more than one row: a table of at most HIT_BITS bits, in pieces of 4 KB that
    meet the rows by the piece's number, tells those that surely have not. A full table rules out less, which costs time only."""
    return maybe_among(texts, groups.where("group_size > 1"), KEY, HIT_BITS)


def clashes(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Digests that the full bytes of two texts share, staged. texts: KEY and the normalised text. The partial aggregation leaves
    one text per digest and task, so a huge group of copies costs no more than a small one."""
    met = maybe_hit(texts, groups).groupBy(*KEY).agg(F.min(P + "text").alias("lo"), F.max(P + "text").alias("hi"))
    return staged(met.where("lo <> hi").select(*KEY), "dedup-clash")


def _texts(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    text = normalised(F.col(text_col))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), digest(text).alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias(P + "text"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_hex) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    told, groups, total = groups_of(docs, id_col, text_col, digest)
    groups = groups.drop("file", "row")
    texts = _texts(docs, id_col, text_col, digest)
    clash = clashes(texts, groups)
    if digest is sha256_hex and clash.isEmpty():
        return _result(join_groups(told.drop("file", "row"), groups, KEY, "group_size", total, MANY), F.col("digest"))
    # Digests that two texts share: their rows are grouped by digest and text. The others have their group's values.
    texts = texts.withColumn("sha", F.sha2(P + "text", 256))
    clashing = texts.join(clash, KEY, "left_semi")
    own = clashing.groupBy(*KEY, P + "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    again = clashing.join(own, [*KEY, P + "text"]).select("doc_id", "keep_id", "group_size", "sha")
    rest = join_groups(texts.drop(P + "text").join(clash, KEY, "left_anti"), groups, KEY, "group_size", total, MANY).select("doc_id", "keep_id", "group_size", "sha")
    return _result(rest.unionByName(again), F.col("sha"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_hex) -> DataFrame:
    """The rows of docs that stay, one of each text, with all their columns: those at the locators that the state holds."""
    own = file_backed(docs)
    _, groups, _ = groups_of(own, id_col, text_col, digest)
    placed = located(own)
    if not clashes(_texts(own, id_col, text_col, digest), groups).isEmpty():  # two texts under one digest: one row of each stays
        rank = F.struct(F.col(id_col).cast("bigint").alias("id"), F.col(P + "file").alias("file"), F.col(P + "row").alias("row"))
        groups = placed.groupBy(normalised(F.col(text_col))).agg(F.max(rank).alias("keep")).select("keep.file", "keep.row")
    at = groups.select(F.col("file").alias(P + "at_file"), F.col("row").alias(P + "at_row"))
    return placed.join(at, (F.col(P + "file") == F.col(P + "at_file")) & (F.col(P + "row") == F.col(P + "at_row")), "left_semi").select(*docs.columns)


def _result(rows: DataFrame, sha: Column) -> DataFrame:
    return rows.select("doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), sha.alias("text_sha256"))
