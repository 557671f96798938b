"""Writers of stores, logs and reports. Small ones are one file; Spark's commit protocol makes each write all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def full_refresh(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Each table overwritten under its name; the rows of each."""
    for name, d in tables.items():
        d.write.mode("overwrite").parquet(f"{path}/{name}")
    return {name: d.sparkSession.read.parquet(f"{path}/{name}").count() for name, d in tables.items()}


def ensured(spark: SparkSession, path: str, schema: str) -> str:
    """Makes an empty table of the schema if there is none, or one whose columns differ: `made`, `kept` or `replaced`."""
    want = spark.createDataFrame([], schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        want.write.parquet(path)
        return "made"
    have = spark.read.parquet(path)
    if [(f.name, f.dataType) for f in have.schema] == [(f.name, f.dataType) for f in want.schema]:
        return "kept"
    want.write.mode("overwrite").parquet(path)
    return "replaced"


def as_json(rows: DataFrame, order: list[str]) -> DataFrame:
    """body: all rows as one JSON array in order, nulls told. A document of its own, so its rows are few."""
    d = rows.select(F.row_number().over(Window.orderBy(*order)).alias("nth"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("j"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "j"))), lambda x: x["j"]), ",\n")
    return d.agg(F.concat(F.lit("[\n"), body, F.lit("\n]")).alias("body"))


def write_json(rows: DataFrame, path: str, order: list[str]) -> None:
    """rows as one JSON array in one file."""
    as_json(rows, order).coalesce(1).write.mode("overwrite").text(path)


def write_cache(rows: DataFrame, path: str, fingerprint: str, order: list[str]) -> None:
    """A scan's cache: gzip JSON lines with the fingerprint, by order, so that equal rows make equal files."""
    rows.withColumn("fingerprint", F.lit(fingerprint)).orderBy(*order).write.mode("overwrite").option("compression", "gzip").json(path)


def write_cleaned(documents: DataFrame, changes: DataFrame, source: str, path: str) -> None:
    """Cleaned documents (doc_id, text), their changes and a summary of them by stage; writing over the source is refused."""
    if path.rstrip("/") == source.rstrip("/") or path.startswith(source.rstrip("/") + "/"):
        raise ValueError("the source would be overwritten")
    documents.write.mode("overwrite").parquet(f"{path}/documents")
    changes.write.mode("overwrite").json(f"{path}/changes")
    counts = changes.groupBy("stage").agg(F.count(F.lit(1)).alias("changes"), F.count_if(~F.col("applied")).alias("open"))
    line = F.concat_ws(" | ", F.lit(""), "stage", F.col("changes").cast("string"), F.col("open").cast("string"), F.lit(""))
    head = documents.sparkSession.createDataFrame([(0, "| stage | changes | open |\n| --- | --- | --- |")], "nth int, value string")
    body = counts.select(F.row_number().over(Window.orderBy("stage")).alias("nth"), F.trim(line).alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("nth").select("value").write.mode("overwrite").text(f"{path}/summary")


def change_rows(before: DataFrame, after: DataFrame, key: list[str], column: str, stage: str, reason: str, confidence: float = 100.0) -> DataFrame:
    """One row for each text that a stage has changed: key, stage, before, after, confidence, reason, applied, at (UTC)."""
    a, b = before.select(*key, F.col(column).alias("before")), after.select(*key, F.col(column).alias("after"))
    d = a.join(b, key).where(~F.col("before").eqNullSafe(F.col("after")))
    return d.select(*key, F.lit(stage).alias("stage"), "before", "after", F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"), F.lit(True).alias("applied"), F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).alias("at"))


def confident(changes: DataFrame, least: float = 90.0) -> DataFrame:
    return changes.where(F.col("confidence") >= least)


def needs_review(changes: DataFrame, least: float = 85.0) -> DataFrame:
    """Changes that weren't applied, or not surely."""
    return changes.where(~F.coalesce("applied", F.lit(False)) | F.coalesce(F.col("confidence") < least, F.lit(True)))


def folder_report(folders: DataFrame, below: float | None = None) -> DataFrame:
    """nth, line of an HTML page: one row per folder (folder, files, bytes) by name; with below, only folders whose mean file size is at
    most that share of the mean of all."""
    d = folders.withColumn("mean", F.try_divide(F.col("bytes").cast("double"), F.col("files")))
    if below is not None:
        whole = folders.agg(F.try_divide(F.sum("bytes").cast("double"), F.sum("files")).alias("all"))
        d = d.crossJoin(F.broadcast(whole)).where(F.col("mean") <= F.col("all") * below)  # one row
    safe = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = [F.concat(F.lit("<td>"), safe(F.col(c)), F.lit("</td>")) for c in ("folder", "files", "bytes")]
    rows = d.select(F.row_number().over(Window.orderBy("folder")).alias("nth"), F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("line"))
    frame = folders.sparkSession.createDataFrame([(0, "<html><body><table>"), (2**31 - 1, "</table></body></html>")], "nth int, line string")
    return frame.unionByName(rows)


def split_manifest(rows: DataFrame, split: str, ident: str, seed: int) -> DataFrame:
    """split, ids (in order), rows and the seed that dealt them."""
    return rows.groupBy(split).agg(F.array_sort(F.collect_set(ident)).alias("ids"), F.count(F.lit(1)).alias("rows")).withColumn("seed", F.lit(seed))


def backup(files: DataFrame, path: str, stamp: str) -> DataFrame:
    """Copies of files (path, content) under a time stamp; path, size and digest of each, read from the copy."""
    at = f"{path}/{stamp}"
    files.select("path", "content").write.mode("errorifexists").parquet(at)
    copy = files.sparkSession.read.parquet(at)
    return copy.select("path", F.octet_length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("sha256"))


def outcomes(results: DataFrame) -> DataFrame:
    """passed and failed of results (name, error), and the failures' texts in order of name."""
    failed = F.col("error").isNotNull()
    return results.agg(F.count_if(~failed).alias("passed"), F.count_if(failed).alias("failed"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(failed, F.struct("name", "error")))), lambda x: F.concat(x["name"], F.lit(": "), x["error"])), "\n").alias("log"))


def moves(source: DataFrame, target: DataFrame) -> DataFrame:
    """path and action for moving files (path, size, sha256) into a target: move, drop (the same is there) or conflict; files that only the
    target has stay."""
    a, b = source.select("path", F.struct("size", "sha256").alias("a")), target.select("path", F.struct("size", "sha256").alias("b"))
    action = F.when(F.col("a").isNull(), "stay").when(F.col("b").isNull(), "move").when(F.col("a") == F.col("b"), "drop").otherwise("conflict")
    return a.join(b, "path", "full").select("path", action.alias("action"))


def approved(store: DataFrame, add: list[str] = (), remove: list[str] = ()) -> DataFrame:
    """A vocabulary (word) after one action: words added or words removed, in any case. Both at once, or words that aren't letters, are
    errors."""
    import re

    if bool(add) == bool(remove):
        raise ValueError("exactly one action")
    bad = next((w for w in [*add, *remove] if not re.fullmatch(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", w.strip())), None)
    if bad is not None:
        raise ValueError(f"not a word: {bad}")
    words = store.sparkSession.createDataFrame([(w.strip(),) for w in [*add, *remove]], "word string")
    folded = words.select(F.lower("word").alias("__v_key"))
    left = store.withColumn("__v_key", F.lower("word")).join(folded, "__v_key", "left_anti").select("word")
    if remove:
        return left.orderBy(F.lower("word"))
    kept = store.withColumn("__v_key", F.lower("word")).join(folded, "__v_key", "left_semi").select("word")
    new = words.withColumn("__v_key", F.lower("word")).join(store.select(F.lower("word").alias("__v_key")), "__v_key", "left_anti").select("word")
    return left.unionByName(kept).unionByName(new).orderBy(F.lower("word"))


def chapters_out(chapters: DataFrame, order: str, title: str) -> DataFrame:
    """chapters with name: `003 - Title`, as wide as the number of chapters asks for, without characters that file systems refuse."""
    n = chapters.count()
    number = F.lpad(F.row_number().over(Window.orderBy(order)).cast("string"), max(2, len(str(n))), "0")
    return chapters.withColumn("name", F.concat(number, F.lit(" - "), F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r'[<>:"/\\|?*]', ""))))
