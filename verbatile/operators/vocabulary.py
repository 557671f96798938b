"""What a corpus tells of its words: class by context, names and their aliases, decisions on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words that tell the class of their neighbours.
DETERMINERS = ["a", "an", "the", "this", "that", "these", "those", "each", "every"]
SUBJECTS = ["i", "you", "he", "she", "it", "we", "they"]
MODALS = ["can", "could", "may", "might", "must", "shall", "should", "will", "would"]
COPULAS = ["am", "are", "be", "been", "being", "is", "was", "were", "become", "seem"]
DEGREES = ["fairly", "less", "more", "most", "quite", "rather", "so", "too", "very"]
TITLES = ["captain", "colonel", "doctor", "general", "major", "mr", "mrs", "professor"]
#: One to four capitalised words.
NAME = "[A-Z][a-z]+(?: [A-Z][a-z]+){0,3}"


def contexts(docs: DataFrame) -> DataFrame:
    """word, before, after of every place; null at a text's ends. Neighbours come from one array, without a shuffle."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    d = docs.select(words.alias("w"))
    return d.select(F.inline(F.expr("transform(w, (x, i) -> struct(x AS word, get(w, i - 1) AS before, get(w, i + 1) AS after))")))


def word_classes(found: DataFrame) -> DataFrame:
    """word, class, confidence from the votes of its contexts (word, before, after); unknown without votes or where two classes tie.

    Votes are sums, so that tasks add up their own before the shuffle."""
    yes = lambda side, words: F.coalesce(F.col(side).isin(words), F.lit(False))
    n = lambda c, weight: F.when(c, weight).otherwise(0)
    determined, closed = yes("before", DETERMINERS), yes("after", COPULAS) | F.col("after").isNull()
    verb = n(yes("before", ["to", *MODALS]), 3) + n(yes("before", SUBJECTS) & yes("after", DETERMINERS), 3) + n(yes("after", DETERMINERS), 2)
    adjective = n(yes("before", DEGREES + COPULAS), 2) + n(determined & ~closed, 2)
    noun = n(yes("before", TITLES) | yes("after", COPULAS), 3) + n(determined & closed, 2)
    votes = found.groupBy("word").agg(F.sum(verb).alias("verb"), F.sum(adjective).alias("adjective"), F.sum(noun).alias("noun"))
    ranked = F.sort_array(F.array(*[F.struct(F.col(c).alias("n"), F.lit(c).alias("name")) for c in ("verb", "adjective", "noun")]), asc=False)
    d = votes.withColumn("r", ranked).withColumn("margin", F.col("r")[0]["n"] - F.col("r")[1]["n"])
    name = F.when(F.col("margin") > 0, F.col("r")[0]["name"]).otherwise("unknown")
    sure = F.when(F.col("margin") > 0, F.round(F.least(F.lit(0.95), 0.55 + F.col("margin") * 0.1), 2)).otherwise(0.0)
    return d.select("word", name.alias("class"), sure.alias("confidence"))


def names(docs: DataFrame, mentions: int = 2) -> DataFrame:
    """name, n, n_docs of runs of capitalised words that come often enough."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(NAME), F.lit(0))).alias("name"))
    # Two levels: a name that is everywhere is counted by document first.
    found = found.groupBy("name", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy("name").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs")).where(F.col("n") >= mentions)


def aliases(found: DataFrame) -> DataFrame:
    """name, n, canonical: the longest name that begins with the words of this one (the first by code point on ties), else itself;
    a single word that only ends longer names is left out. Names meet by their leading and last words, not pair by pair."""
    parts = F.split("name", " ")
    long = found.select("name", parts.alias("parts")).where(F.size("parts") > 1)
    heads = long.select(F.col("name").alias("longer"), F.explode(F.expr("transform(sequence(1, size(parts) - 1), i -> array_join(slice(parts, 1, i), ' '))")).alias("name"))
    heads = heads.groupBy("name").agg(F.min(F.struct((-F.length("longer")).alias("m"), "longer")).alias("best")).select("name", F.col("best.longer").alias("longer"))
    ends = long.select(F.element_at("parts", -1).alias("name")).distinct().withColumn("ends", F.lit(True))
    d = found.join(heads, "name", "left").join(ends, "name", "left").where("longer IS NOT NULL OR ends IS NULL")
    return d.select("name", "n", F.coalesce("longer", "name").alias("canonical"))


def promote(old: DataFrame, new: DataFrame, key: str, verdict: str) -> DataFrame:
    """key, verdict, state of decisions when later ones are merged in: the later verdict holds."""
    d = old.select(key, F.col(verdict).alias("was")).join(new.select(key, F.col(verdict).alias("now")), key, "full")
    state = F.when(F.col("now").isNull(), "kept").when(F.col("was").isNull(), "added").when(F.col("was") == F.col("now"), "ignored").otherwise("updated")
    return d.select(key, F.coalesce("now", "was").alias(verdict), state.alias("state"))


def spread_pick(d: DataFrame, by: str, order: str, strata: int, each: int) -> DataFrame:
    """Rows evenly spread over equal strata of each group, in order: `each` of a stratum, its middle if that is one, all if it has fewer."""
    w = Window.partitionBy(by)
    d = d.withColumn("place", F.row_number().over(w.orderBy(order)) - 1).withColumn("size", F.count(F.lit(1)).over(w))
    d = d.withColumn("stratum", F.floor(F.col("place") * strata / F.col("size")))
    s = Window.partitionBy(by, "stratum")
    d = d.withColumn("i", F.col("place") - F.min("place").over(s)).withColumn("m", F.count(F.lit(1)).over(s))
    # i is picked if some j of 0..each-1 has floor(j * (m - 1) / (each - 1) + 1/2) = i.
    picked = F.col("i") == F.floor((F.col("m") - 1) / 2) if each == 1 else F.exists(F.sequence(F.lit(0), F.lit(each - 1)), lambda j: F.floor((2 * j * (F.col("m") - 1) + (each - 1)) / (2 * (each - 1))) == F.col("i"))
    return d.where((F.col("m") <= each) | picked).drop("place", "size", "i", "m")
