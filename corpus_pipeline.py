"""A training-corpus pipeline over documents: language ID, exact dedup, near-duplicate removal, mixing, tokenisation.

Each stage works on what the one before it kept, written as Parquet and read again. All but the last return the columns of
documents. SQL can't express the stages; tests/llm compares run() with a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatile.llm.bpe import encode_documents
from verbatile.llm.common import P, discard, fresh_path, given_paths, release, staged
from verbatile.llm.exact_dedup import kept_documents
from verbatile.llm.jaccard_join import jaccard_components
from verbatile.llm.lid_crf import UNDEFINED, identify
from verbatile.llm.mixing import mixed_documents

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found (no letter at all) go."""
    found = identify(docs, F.lit(True), carry=tuple(docs.columns))
    return found.where(F.col("lang_pred") != UNDEFINED).select(*[F.col(P + "c_" + c).alias(c) for c in docs.columns])


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, also where ids are null or repeat with other texts."""
    release(spark)
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id (null comes first). Groups are made by a
    key of its own for each row, since ids may be null or repeat."""
    release(spark)
    row = P + "key"
    keyed = staged(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    found = jaccard_components(keyed, id_col=row).select(F.col("doc_id").alias(row), "component_id")
    ranked = keyed.select(row, F.struct(F.col("doc_id"), F.xxhash64("text"), F.col(row).alias("row")).alias("rank"))
    least = found.join(ranked, row).groupBy("component_id").agg(F.min("rank").alias("least")).select(F.col("least.row").alias(row))
    return keyed.join(least, row, "left_semi").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets: documents not taken go, those taken more than once repeat."""
    release(spark)
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every row."""
    release(spark)
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("exact_dedup", exact_duplicates), ("ngram_jaccard_join", near_duplicates), ("weighted_mix", source_mix), ("byte_bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = given_paths()
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        discard(spark, given_paths() - before - {path})  # what the stage has written on its way, and the input it has read
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
