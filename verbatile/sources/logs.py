"""Readers of logs, lists and file manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events of JSON-lines files with file_path; lines that can't be read are left out. schema: DDL of one line."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    parsed = lines.select(F.col("_metadata.file_path").alias("file_path"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e"), F.try_parse_json("value").alias("v"))
    return parsed.where("v IS NOT NULL").select("file_path", "e.*")


def frequency_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """word, frequency from lines of `word count`; malformed lines are left out, of repeated words the most counts."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") == 2)
    d = parts.select(F.lower(F.col("p")[0]).alias("word"), F.col("p")[1].try_cast("bigint").alias("frequency"))
    return d.where("frequency IS NOT NULL AND word <> ''").groupBy("word").agg(F.max("frequency").alias("frequency"))


def manifest(spark: SparkSession, path: str, pattern: str = "*", with_hash: bool = False) -> DataFrame:
    """path, size, modified (and sha256) of files, by path without regard to case."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    columns = ["path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")] + [F.sha2("content", 256).alias("sha256")] * with_hash
    return d.select(*columns).orderBy(F.lower("path"), "path")


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """path and whole text of Markdown files; a byte-order mark is left out."""
    d = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return d.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))


# Endings of documents and of audio files that batches read.
DOCUMENTS, AUDIO, MEDIA = ("pdf", "epub"), ("mp3", "wav", "m4a", "flac", "ogg", "aac"), ("mp3", "mp4")


def listing(spark: SparkSession, path: str, endings: tuple[str, ...], recursive: bool = False) -> DataFrame:
    """path, size, modified of files with one of the endings, in any case, in order of path; contents aren't read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return d.where(ending.isin(*endings)).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy(F.lower("path"), "path")
