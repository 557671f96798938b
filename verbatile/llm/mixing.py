"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of their id. A document's virtual finish time is its source's running total
of words up to and with it, divided by the source's target; later passes over a source that is taken more than once go on
from there. The mix is the global order of virtual finish times, truncated at the total budget: what ends before the budget
does is taken whole, the one document that the budget ends in is taken in part. Since all sources are served at their weights,
each has its target by then, but for the documents that are being served at virtual time 1.

The global order is dealt into ranges of virtual time (SLOTS up to time 1, then finer and finer ones in proportion), whose
words are summed. Ranges before the one in which the budget ends are taken whole, those behind it not at all, so that only
that one has to be sorted to find the cut. mixed_order() range-sorts what is taken, for a training run to read.

Running totals are prefix sums in two levels (sums of hash buckets, then rows within a bucket), so neither a hot source nor
the global order is ever in one task; what is, is a row for each source and a row for each range. Edge cases: null text has no
words; null sources are a source of their own, the last; documents without words take nothing; equal finish times go by the
source's name; repeated ids are ordered by their size and the hash of their text; an empty table gives an empty one; extra
columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import P, staged

#: Weights of the sources in order of their names, repeated; and how often a source may be taken at most.
WEIGHTS, MOST = (5, 2, 1), 3
#: Ranges of virtual time up to 1.
SLOTS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> source, source_size, target.

    The targets are min(most * size, level * weight) for the one level at which they add up to all sizes. In order of
    most * size / weight the capped sources come first, so prefix sums over the sources find the level.
    """
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), nth.cast("int") + 1).cast("bigint")
    d = sizes.select("source", "source_size", weight.alias("weight"), F.row_number().over(by_name).alias("nth"))
    cap = F.col("source_size") * most
    order = Window.orderBy((cap / F.col("weight")).asc(), F.col("nth"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    d = d.select(
        "source", "source_size", "weight", "nth", cap.alias("cap"),
        ((F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(after)).alias("level"),
    )
    # The first source that its cap does not hold back sets the level for it and all behind it.
    free = F.col("level") * F.col("weight") <= F.col("cap")
    d = d.withColumn("level", F.max(F.when(free, F.col("level"))).over(everything))
    return d.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def prefix_sum(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, out: str, more: DataFrame | None = None) -> DataFrame:
    """df with out: the sum of value over the rows of the same keys before the row, by bucket and then by order.

    more: a table of one row for each value of keys[0], whose other columns are added; it meets the buckets' sums and not
    the rows, so that a key with very many rows isn't dealt by itself.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias(P + "sum"))
    so_far = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(P + "base", F.coalesce(F.sum(P + "sum").over(so_far), F.lit(0))).drop(P + "sum")
    if more is not None:
        sums = sums.join(more.withColumnRenamed(keys[0], P + "of"), F.col(keys[0]).eqNullSafe(F.col(P + "of"))).drop(P + "of")
    sums = sums.withColumnsRenamed({c: P + "k_" + c for c in (*keys, bucket)})
    same = [F.col(c).eqNullSafe(F.col(P + "k_" + c)) for c in (*keys, bucket)]
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = df.join(sums, same).drop(*[P + "k_" + c for c in (*keys, bucket)])
    return d.withColumn(out, F.col(P + "base") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop(P + "base")


def told(docs: DataFrame, seed: str = "mix", row: Column | None = None) -> DataFrame:
    """What the mix is made from, staged: row (a key of its own for each row, made here if not given), doc_id, source, size
    and the place in the shuffle. No text."""
    row = F.monotonically_increasing_id() if row is None else row
    d = docs.select(row.alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    d = d.withColumn("shuffled", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    return staged(d, "mix-told")


def served(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, bucket_rows: int = 500) -> DataFrame:
    """rows with source_size, target and before: the words of the source's documents that are served before, in a pass. Staged."""
    share = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    n = rows.count()
    digits = next((k for k in range(1, 6) if 16**k * bucket_rows >= n), 6)
    order = [F.col("shuffled"), F.col("doc_id"), F.col("size"), F.col("text_hash"), F.col("row")]
    d = prefix_sum(rows.withColumn("bucket", F.substring("shuffled", 1, digits)), ["source"], "bucket", order, "size", "before", share)
    return staged(d.select("row", "doc_id", "source", "size", "source_size", "target", "before"), "mix-served")


def finish_time(nth: Column | int) -> Column:
    """Virtual finish time of a document in the nth pass (from 0); null where the source has no words."""
    end = F.lit(nth).cast("bigint") * F.col("source_size") + F.col("before") + F.col("size")
    return F.try_divide(end.cast("double"), F.col("target"))


def slot_of(finish: Column, slots: int) -> Column:
    return F.when(finish <= 1, F.floor(finish * slots)).otherwise(F.floor((1 + F.log2(finish)) * slots) + 1).cast("bigint")


def schedule(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, slots: int = SLOTS) -> DataFrame:
    """One row per document and pass that takes words: row, doc_id, source, size, source_size, target, pass (from 0), finish
    (virtual time) and words; and one with 0 words and pass 0 for each document of which nothing is taken."""
    d = served(rows, weights, most)
    items = d.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    items = items.withColumn("finish", finish_time(F.col("pass")))
    items = items.withColumn("slot", slot_of(F.col("finish"), slots))
    sums = items.groupBy("slot").agg(F.sum("size").alias("words"))
    # The budget is all words of all documents. One row for each range goes to one task here.
    over = Window.orderBy("slot")
    upto = staged(sums.select("slot", F.sum("words").over(over).alias("upto"), F.col("words")), "mix-slots")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint")).first()[0]
    cut = upto.where(F.col("upto") >= total).orderBy("slot").first()
    last, left = (cut.slot, total - (cut.upto - cut.words)) if cut else (-1, 0)
    inside = Window.partitionBy("slot").orderBy("finish", F.col("source").asc_nulls_last(), "row", "pass").rowsBetween(Window.unboundedPreceding, -1)
    here = items.where(F.col("slot") == last).withColumn("words", F.greatest(F.least(F.lit(left) - F.coalesce(F.sum("size").over(inside), F.lit(0)), F.col("size")), F.lit(0)))
    taken = items.where(F.col("slot") < last).withColumn("words", F.col("size")).unionByName(here.where("words > 0"))
    columns = ["row", "doc_id", "source", "size", "source_size", "target", "pass", F.col("words").cast("bigint").alias("words"), "finish"]
    # Passes of one row take words in order, so a row that takes none in the first takes none at all.
    first = here.where("pass = 0 AND words = 0").drop("slot").unionByName(items.where((F.col("slot") > last) & (F.col("pass") == 0)).drop("slot").withColumn("words", F.lit(0)))
    without = d.where("size <= 0").withColumns({"pass": F.lit(0), "finish": finish_time(0), "words": F.lit(0)})
    return taken.drop("slot").unionByName(first).unionByName(without).select(*columns)


def mixed_order(plan: DataFrame) -> DataFrame:
    """The passes that take words, range-sorted by virtual finish time: the order in which a training run reads them."""
    return plan.where("words > 0").orderBy("finish", F.col("source").asc_nulls_last(), "row", "pass")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted), finish (virtual
    time of its first pass, null where its source has no words)."""
    plan = schedule(told(docs, seed), weights, most)
    taken = plan.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum("words").cast("bigint").alias("taken"), F.min("finish").alias("finish"))
    return taken.select("doc_id", "size", "source_size", "target", "taken", "finish")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix", id_col: str = "doc_id") -> DataFrame:
    """The documents of the mix with all their columns: one row for each pass, none where nothing is taken of them.

    The document that the budget ends in is kept whole. Rows are told apart by a key of their own, whatever their ids; documents
    without words take nothing and go.
    """
    key = P + "key"
    keyed = staged(docs.withColumn(key, F.monotonically_increasing_id()), "mix-rows")
    plan = schedule(told(keyed.withColumn("doc_id", F.col(id_col)), seed, F.col(key)), weights, most)
    times = plan.where("words > 0").groupBy(F.col("row").alias(key)).agg(F.count(F.lit(1)).cast("int").alias(P + "times"))
    d = keyed.join(times, key).drop(key)
    return d.withColumn(P + "times", F.explode(F.sequence(F.lit(1), F.col(P + "times")))).drop(P + "times")
