"""Corpus statistics: tokens, n-grams, hyphens, exact duplicates, repeated lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A word with inner apostrophes or hyphens.
TOKEN = r"[A-Za-z]+(?:['’-][A-Za-z]+)*"


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 1), text of the line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("line"), "text")


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, pos (from 0), token, key (lower case)."""
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    return found.withColumn("key", F.lower("token"))


def top_forms(docs: DataFrame, limit: int) -> DataFrame:
    """The most frequent keys with their number and most common form (the first by code point on ties)."""
    forms = tokens(docs).groupBy("key", "token").agg(F.count(F.lit(1)).alias("n"))
    keys = forms.groupBy("key").agg(F.sum("n").alias("n_total"), F.min(F.struct((-F.col("n")).alias("m"), "token")).alias("best"))
    return keys.select("key", "n_total", F.col("best.token").alias("form")).orderBy(F.desc("n_total"), "key").limit(limit)


def bigrams(docs: DataFrame, minimum: int) -> DataFrame:
    """Neighbouring words of a document and how often they are, from minimum on. Pairs come from one array, without a sort."""
    words = docs.select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0)).alias("w"))
    pairs = words.select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))).alias("p"))
    pairs = pairs.select(F.col("p.a").alias("first"), F.col("p.b").alias("second")).where("second IS NOT NULL")
    return pairs.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= minimum)


def by_content(docs: DataFrame) -> DataFrame:
    """sha256 of each text, its documents and the smallest id."""
    return docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("keep_id"))


def repeated_lines(docs: DataFrame, minimum: int) -> DataFrame:
    """Lines that stand in at least minimum documents: running heads, page artifacts."""
    return lines(docs).where(F.length(F.trim("text")) > 0).groupBy(F.trim("text").alias("artifact")).agg(F.countDistinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_lines")).where(F.col("n_docs") >= minimum)


def evidence(pairs: DataFrame, words: DataFrame, minimum: int = 1) -> DataFrame:
    """For a pair of words that may be one: how often the joined word and the pair stand in the corpus, and the verdict."""
    joined = words.select(F.col("key").alias("joined"), F.col("n").alias("n_joined"))
    d = pairs.withColumn("joined", F.concat("first", "second")).join(joined, "joined")
    verdict = F.when(F.col("n_joined") >= 5 * F.col("n"), "accepted").when(F.col("n") > F.col("n_joined"), "rejected").otherwise("ambiguous")
    return d.where(F.col("n") >= minimum).select("first", "second", F.col("n").alias("n_pair"), "n_joined", verdict.alias("verdict"))


def fence_state(rows: DataFrame, key: str, order: str, is_fence) -> DataFrame:
    """Whether a line is inside a fence: an odd number of fences stands before it."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("inside", F.coalesce(F.sum(is_fence.cast("int")).over(before), F.lit(0)) % 2 == 1)


def forward_fill(rows: DataFrame, key: str, order: str, value, out: str) -> DataFrame:
    """The last value that is not null, up to each row."""
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def collapse_runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Neighbouring rows of one value as one: first and last place, and their number."""
    w = Window.partitionBy(key).orderBy(order)
    d = rows.withColumn("new", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    d = d.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(key, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))
