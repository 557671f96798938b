"""Words that are one edit apart: a join on shared deletions, verified by the optimal string alignment distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbatile.operators import matching

def one_edit_apart(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """a of words and b of lexicon (column word in both; two letters or more) at distance 1: an insertion, deletion,
    substitution or swap of neighbours. Nothing is compared with all, and words may be of any length."""
    long_ = F.length("word") >= 2
    return matching.edits_apart(words.where(long_), lexicon.where(long_), 1).drop("distance")


def suggestions(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word, suggestion, frequency, ambiguous: for each word the most frequent of lexicon (word, frequency) one edit apart (the
    first by code point on ties); ambiguous if the runner-up is more than half as frequent."""
    pairs = one_edit_apart(words, lexicon).join(lexicon.select(F.col("word").alias("b"), "frequency"), "b")
    w = Window.partitionBy("a").orderBy(F.desc("frequency"), "b")
    d = pairs.select("a", "b", "frequency", F.row_number().over(w).alias("nth"), F.lead("frequency").over(w).alias("next")).where("nth = 1")
    return d.select(F.col("a").alias("word"), F.col("b").alias("suggestion"), "frequency", F.coalesce(F.col("frequency") < 2 * F.col("next"), F.lit(False)).alias("ambiguous"))
