"""Keyed records, file trees, model evaluation, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that may go to every executor, or be one task's.
FEW = 100_000


def few(d: DataFrame, most: int = FEW) -> DataFrame:
    """d, to be broadcast; an error if it has more rows than that."""
    n = d.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows")
    return F.broadcast(d)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new replace rows of old with the same key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """What only one of two tables holds, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def lineage(old: DataFrame, new: DataFrame, key: str, inputs: list[str]) -> DataFrame:
    """Whether an artifact can be used again (the digest of its inputs is the same), must be made again, is new or gone."""
    digest = lambda d: d.select(key, F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in inputs]), 256).alias("digest"))
    a, b = digest(old).withColumnRenamed("digest", "before"), digest(new).withColumnRenamed("digest", "after")
    state = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(F.col("before") == F.col("after"), "reuse").otherwise("regenerate")
    return a.join(b, key, "full").select(key, state.alias("state"))


def tree_rollup(files: DataFrame, path: str, size: str) -> DataFrame:
    """folder, files and bytes directly in it and below it; each file tells all its ancestors."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    d = files.select(F.col(size).alias("bytes"), parts.alias("parts"), depth.alias("depth"))
    d = d.select("bytes", "parts", "depth", F.explode(F.sequence(F.lit(1), F.greatest("depth", F.lit(1)))).alias("k"))
    d = d.select("bytes", F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/").alias("folder"), (F.col("k") == F.col("depth")).alias("own"))
    return d.groupBy("folder").agg(F.sum(F.col("own").cast("int")).alias("direct_files"), F.count(F.lit(1)).alias("total_files"), F.sum(F.when(F.col("own"), F.col("bytes")).otherwise(0)).alias("direct_bytes"), F.sum("bytes").alias("total_bytes"))


def confusion(d: DataFrame, label: Column, p: Column, threshold: float) -> DataFrame:
    """tn, fp, fn, tp, accuracy, precision and recall (null without a case) at a threshold."""
    hit = p >= threshold
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    s = d.agg(n((label == 0) & ~hit).alias("tn"), n((label == 0) & hit).alias("fp"), n((label == 1) & ~hit).alias("fn"), n((label == 1) & hit).alias("tp"))
    return s.select("*", F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"))


def hash_sample(d: DataFrame, by: str, key: str, seed: str, n: int) -> DataFrame:
    """The n rows of each group that are first by sha256 of seed, a zero byte and the key."""
    place = F.sha2(F.concat(F.lit(seed), F.char(F.lit(0)), F.col(key).cast("string")), 256)
    return d.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(place))).where(F.col("nth") <= n)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def mutation_gate(records: DataFrame, group: list[str], confidence: str, minimum: float) -> DataFrame:
    """A stage's changes are applied only if none of its group is below the least confidence."""
    return records.withColumn("applied", F.min(confidence).over(Window.partitionBy(*group)) >= minimum)


def threshold_sweep(d: DataFrame, label: Column, p: Column, precision: float, cells: int = 1024) -> DataFrame:
    """The threshold with the most recall (the higher one on ties) among those whose precision is at least the given one.

    Running sums in two levels: within cells of the probability's range, each in a task, and over the cells' totals."""
    g = d.select(label.alias("y"), p.alias("threshold")).groupBy("threshold").agg(F.sum("y").alias("tp"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("cell", F.least(F.floor(F.col("threshold") * cells), F.lit(cells)))
    above = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    # cells + 1 rows at most.
    totals = g.groupBy("cell").agg(F.sum("tp").alias("t"), F.sum("n").alias("m"))
    totals = totals.select("cell", F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t"), F.coalesce(F.sum("m").over(above), F.lit(0)).alias("m"), F.sum("t").over(Window.partitionBy()).alias("all"))
    w = Window.partitionBy("cell").orderBy(F.desc("threshold"))
    g = g.join(F.broadcast(totals), "cell").select("threshold", (F.sum("tp").over(w) + F.col("t")).alias("tp"), (F.sum("n").over(w) + F.col("m")).alias("n"), "all")
    g = g.select("threshold", (F.col("tp") / F.col("n")).alias("precision"), F.try_divide("tp", "all").alias("recall")).where(F.col("precision") >= precision)
    return g.agg(F.max(F.struct("recall", "threshold", "precision")).alias("b")).select("b.threshold", "b.precision", "b.recall")


def grouped_split(d: DataFrame, by: str, seed: str, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """by, split: whole groups go to train, validation or test, in the order of a seeded hash. Groups are taken to be few."""
    groups = d.select(by).distinct()
    place = F.row_number().over(Window.orderBy(F.sha2(F.concat(F.lit(seed), F.char(F.lit(0)), F.col(by).cast("string")), 256)))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    cut = groups.select(by, place.alias("place"), n.alias("n"))
    return cut.select(by, F.when(F.col("place") <= F.floor(F.col("n") * train), "train").when(F.col("place") <= F.floor(F.col("n") * (train + validation)), "validation").otherwise("test").alias("split"))
