"""The registered queries of this subpackage: thin calls of its operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_documents
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .licenses import scan_licenses
from .lid_crf import identify
from .mixing import mix_documents
from .separators import count_tokens
from .substring_dedup import remove_repeats
from .toxicity_kn import score_documents
from .winnow import winnow_documents


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(number: int, out: int) -> Column:
    """Rows to learn from: those whose crc32 of the id, as text, modulo number is not out."""
    return F.crc32(F.col("doc_id").cast("string")) % number != out


def op1_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir), fold(4, 2))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow_documents(documents(spark, sf_dir))


def op5_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op6_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(documents(spark, sf_dir))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op8_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(5, 0))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_crf_language_id, op2_exact_dedup, op3_separator_scan, op4_winnowing, op5_super_kmer_dedup, op6_weighted_fair_mix, op7_ngram_jaccard, op8_kneser_ney_toxicity, op9_license_scan, op10_byte_bpe)
    return {f.__name__: f for f in made}
