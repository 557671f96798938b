"""Readers of JSON stores, lexicons, reviews, assistants' logs and media containers. A file is one document unless said otherwise."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatile.operators import usage


def documents(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """path and whole text of files, without a byte-order mark."""
    d = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return d.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))


def _array(text: Column, names: tuple[str, ...], kind: str) -> Column:
    """A JSON array, or that under the first of the names that an object has."""
    below = [F.from_json(F.get_json_object(text, f"$.{n}"), f"array<{kind}>") for n in names]
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, f"array<{kind}>")).otherwise(F.coalesce(*below) if below else F.lit(None))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """word (trimmed, in lower case, once) of a list, of an object's `words`, or of an object's keys but those that begin with `_`."""
    d = documents(spark, path)
    keys = F.filter(F.map_keys(F.from_json("text", "map<string,string>")), lambda k: ~k.startswith("_"))
    words = F.when(F.ltrim("text").startswith("["), F.from_json("text", "array<string>")).when(F.get_json_object("text", "$.words").isNotNull(), F.from_json(F.get_json_object("text", "$.words"), "array<string>")).otherwise(keys)
    return d.select(F.explode(words).alias("word")).select(F.lower(F.trim("word")).alias("word")).where("word <> ''").distinct()


def decisions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """accepted (broken, replacement, blocked_previous, blocked_following) and rejected (broken) pairs; it is an error to do both."""
    d = documents(spark, path)
    entry = d.select(F.explode(F.from_json(F.get_json_object("text", "$.accepted"), "map<string,string>")).alias("broken", "v"))
    list_of = lambda k: F.coalesce(F.transform(F.from_json(F.get_json_object("v", f"$.{k}"), "array<string>"), F.lower), F.array().cast("array<string>"))
    key = F.lower(F.trim(F.regexp_replace("broken", r"\s+", " ")))
    accepted = entry.select(key.alias("broken"), F.trim(F.coalesce(F.get_json_object("v", "$.replacement"), F.when(~F.col("v").startswith("{"), F.col("v")))).alias("replacement"), list_of("blocked_previous").alias("blocked_previous"), list_of("blocked_following").alias("blocked_following"))
    accepted = accepted.where("broken <> '' AND replacement <> ''")
    rejected = d.select(F.explode(F.from_json(F.get_json_object("text", "$.rejected"), "array<string>")).alias("broken")).select(key.alias("broken")).where("broken <> ''").distinct()
    both = accepted.join(rejected, "broken", "left_semi").select("broken").head(1)
    if both:
        raise ValueError(f"both accepted and rejected: {both[0].broken}")
    return accepted, rejected


RULE = "source string, suggestion string, previous array<string>, following array<string>, confidence double"


def contextual_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of confusions under `rules`; those without source or suggestion are left out."""
    d = documents(spark, path).select(F.explode(_array(F.col("text"), ("rules",), f"struct<{RULE}>")).alias("r")).select("r.*")
    return d.where("trim(source) <> '' AND trim(suggestion) <> ''").withColumn("confidence", F.coalesce("confidence", F.lit(60.0)))


def review_records(spark: SparkSession, path: str) -> DataFrame:
    """token and replacement of the candidates that a review has approved (status `replace`)."""
    kind = "struct<token:string,status:string,replacement:string>"
    d = documents(spark, path).select(F.explode(_array(F.get_json_object("text", "$.candidates"), (), kind)).alias("c")).select("c.*")
    return d.where("status = 'replace' AND token IS NOT NULL AND replacement IS NOT NULL").select(F.lower("token").alias("token"), "replacement").distinct()


EXAMPLE = "struct<id:string,source_file:string,spaced_text:string,joined_text:string,left:string,right:string,user_label:string,review_status:string>"


def reviewed_examples(spark: SparkSession, path: str, labels: tuple[str, ...] = ("join", "keep_spaced")) -> DataFrame:
    """Reviewed training examples with label 1 (the first of labels) or 0. Another schema, an unknown label and a repeated id are
    errors; examples that no one has reviewed are left out."""
    d = documents(spark, path)
    odd = d.where(~F.coalesce(F.get_json_object("text", "$.schema_version") == "1", F.lit(False))).head(1)
    if odd:
        raise ValueError(f"unsupported schema version: {odd[0].path}")
    rows = d.select(F.explode(_array(F.get_json_object("text", "$.examples"), (), EXAMPLE)).alias("e")).select("e.*").where("review_status = 'reviewed'")
    bad = rows.where(~F.coalesce(F.col("user_label").isin(*labels), F.lit(False))).head(1) or rows.groupBy("id").count().where("count > 1").head(1)
    if bad:
        raise ValueError(f"unknown label or repeated id: {bad[0].id}")
    return rows.withColumn("label", (F.col("user_label") == labels[0]).cast("int"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """id of an array or an object's `ids`; repeated ids are an error."""
    d = documents(spark, path).select(F.explode(_array(F.col("text"), ("ids",), "string")).alias("id"))
    twice = d.groupBy("id").count().where("count > 1").head(1)
    if twice:
        raise ValueError(f"repeated id: {twice[0].id}")
    return d


def cached_scan(spark: SparkSession, path: str, schema: str, fingerprint: str) -> DataFrame:
    """Rows of a scan's cache (gzip JSON lines with a fingerprint column) that the fingerprint fits; none if there is no cache or it can't
    be read."""
    try:
        d = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
        d.head(1)
    except Exception as e:  # a missing or corrupt cache is an empty one
        if "PATH_NOT_FOUND" not in str(e) and "FAILED_READ_FILE" not in str(e):
            raise
        d = spark.createDataFrame([], schema)
    return d.where(F.col("fingerprint") == fingerprint)


def config_value(config: dict, path: str, default: object = ...) -> object:
    """The value at a dotted path of a nested dictionary; an error if it is missing and there is no default."""
    for key in path.split("."):
        if not isinstance(config, dict) or key not in config:
            if default is ...:
                raise KeyError(path)
            return default
        config = config[key]
    return config


def references(spark: SparkSession, path: str, sample: Column | str) -> DataFrame:
    """Rows of a manifest's `references` for one sample directory."""
    kind = "struct<sample:string,group_id:string,start:double,end:double,required:array<string>,forbidden:array<string>>"
    return documents(spark, path).select(F.explode(_array(F.get_json_object("text", "$.references"), (), kind)).alias("r")).select("r.*").where(F.col("sample") == sample)


def volume_headings(lines: DataFrame) -> DataFrame:
    """path, line, volume, heading of a list (path, line, text) in which `Volume N` stands over its headings."""
    from pyspark.sql import Window

    number = F.regexp_extract("text", r"(?i)^\s*volume\s+(\d+)\s*$", 1)
    d = lines.withColumn("volume", F.last(F.when(number != "", number.cast("int")), ignorenulls=True).over(Window.partitionBy("path").orderBy("line")))
    return d.where((number == "") & (F.trim("text") != "") & F.col("volume").isNotNull()).select("path", "line", "volume", F.trim("text").alias("heading"))


def assistant_logs(spark: SparkSession, path: str) -> DataFrame:
    """Events of assistants' debug logs: `main.jsonl` files with file, line and the fields of usage.events.

    Lines are numbered as they stand in a file; a log is read as one text."""
    d = documents(spark, path, "main.jsonl")
    return usage.events(d.select(F.col("path").alias("file"), F.posexplode(F.split("text", "\r?\n")).alias("line", "value")))


def free_text_log(spark: SparkSession, path: str, marker: str, counters: dict[str, str]) -> DataFrame:
    """One row per block of a log (file, nth, block) that a marker begins, with each counter summed over what its pattern's first group
    finds in the block."""
    d = usage.blocks(documents(spark, path, "*.log").withColumnRenamed("path", "file"), marker)
    total = lambda p: F.aggregate(F.regexp_extract_all("block", F.lit(p), F.lit(1)), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x.try_cast("bigint"), F.lit(0)))
    return d.select("file", "nth", "block", *[total(p).alias(name) for name, p in counters.items()])


# Durations that containers tell in their heads

def _boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Boxes of an MP4 file: kind, and where their contents begin and end."""
    while at + 8 <= end:
        size, head = int.from_bytes(data[at : at + 4], "big"), 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif not size:
            size = end - at
        if size < head:
            return
        yield data[at + 4 : at + 8], at + head, min(at + size, end)
        at += size


def mp4_seconds(data: bytes) -> float | None:
    """Duration of an MP4 or MOV file by its movie header."""
    for kind, a, b in _boxes(data, 0, len(data)):
        if kind == b"moov":
            for inner, c, d in _boxes(data, a, b):
                if inner == b"mvhd" and d - c >= 20:
                    wide = data[c] == 1
                    place, form = (c + 20, ">IQ") if wide else (c + 12, ">II")
                    if place + struct.calcsize(form) > d:
                        return None
                    scale, length = struct.unpack_from(form, data, place)
                    return length / scale if scale else None
    return None


def _elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Elements of a Matroska file: id, and where their contents begin and end."""

    def number(at: int, keep: bool) -> tuple[int, int] | None:
        if at >= end or not data[at]:
            return None
        n = 9 - data[at].bit_length()
        if at + n > end:
            return None
        value = int.from_bytes(data[at : at + n], "big")
        return (value if keep else value & ((1 << 7 * n) - 1)), n

    while at < end:
        ident = number(at, True)
        size = number(at + ident[1], False) if ident else None
        if not ident or not size:
            return
        begin = at + ident[1] + size[1]
        stop = end if size[0] == (1 << 7 * size[1]) - 1 else min(begin + size[0], end)  # of unknown size
        yield ident[0], begin, stop
        at = stop


def matroska_seconds(data: bytes) -> float | None:
    """Duration of a Matroska or WebM file by its segment's information."""
    for ident, a, b in _elements(data, 0, len(data)):
        if ident == 0x18538067:
            for inner, c, d in _elements(data, a, b):
                if inner == 0x1549A966:
                    scale, ticks = 1_000_000, None
                    for leaf, e, f in _elements(data, c, d):
                        if leaf == 0x2AD7B1:
                            scale = int.from_bytes(data[e:f], "big") or scale
                        elif leaf == 0x4489 and f - e in (4, 8):
                            ticks = struct.unpack(">f" if f - e == 4 else ">d", data[e:f])[0]
                    return None if ticks is None else ticks * scale / 1e9
    return None


def native_seconds(data: bytes | None) -> float | None:
    """By whatever container it is; null if none of them tells."""
    if not data:
        return None
    try:
        return mp4_seconds(data) if data[4:8] == b"ftyp" or data[4:8] == b"moov" else matroska_seconds(data)
    except (struct.error, IndexError, OverflowError):
        return None


def media_seconds(files: DataFrame, *others: Column) -> DataFrame:
    """files (path, content) with seconds: what the container tells, else the first of the others that isn't null, else 0."""

    @F.pandas_udf("double")
    def told(content: pd.Series) -> pd.Series:
        return content.map(native_seconds).astype("float64")

    found = told(F.col("content"))
    return files.select("path", F.coalesce(F.nanvl(found, F.lit(None).cast("double")), *others, F.lit(0.0)).alias("seconds"))


def cached_durations(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files (path, size, modified) with seconds of the cache (path, size, modified, seconds) where path, size and whole second agree, null
    where they have to be told anew."""
    own = cache.select("path", F.col("size").alias("__v_size"), F.floor(F.unix_micros("modified") / 1_000_000).alias("__v_at"), "seconds")
    same = (F.col("size") == F.col("__v_size")) & (F.floor(F.unix_micros("modified") / 1_000_000) == F.col("__v_at"))
    met = files.join(own, "path", "left")
    return met.select(*files.columns, F.when(same, F.col("seconds")).alias("seconds"))
