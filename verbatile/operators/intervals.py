"""Timed intervals: union, difference, overlap and as-of joins, sessions, coverage. Times are seconds (double)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union(d: DataFrame, key: str, gap: float = 0.0) -> DataFrame:
    """Intervals (key, start, end) merged where they overlap or are at most gap apart."""
    before = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("reach", F.max("end").over(before))
    d = d.withColumn("new", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach") + gap), 1).otherwise(0))
    d = d.withColumn("island", F.sum("new").over(Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def difference(source: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """What of source no interval of covered holds, by a sweep over both sides' ends."""
    ends = lambda d, a, c: d.select(key, F.col("start").alias("at"), F.lit(a).alias("a"), F.lit(c).alias("c")).unionByName(d.select(key, F.col("end").alias("at"), F.lit(-a).alias("a"), F.lit(-c).alias("c")))
    steps = ends(source, 1, 0).unionByName(ends(covered, 0, 1)).groupBy(key, "at").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
    w = Window.partitionBy(key).orderBy("at")
    steps = steps.withColumns({"open": F.sum("a").over(w), "shut": F.sum("c").over(w), "end": F.lead("at").over(w)})
    parts = steps.where((F.col("open") > 0) & (F.col("shut") == 0) & (F.col("end") > F.col("at"))).select(key, F.col("at").alias("start"), "end")
    return union(parts, key)


#: Grids of time: cells of each are so many times wider than those of the one before.
COARSER, GRIDS = 64, 4


def own_grid(length: Column, width: float) -> Column:
    """The grid on which an interval of that length has at most COARSER + 1 cells (on the last one it may have more)."""
    at = F.lit(GRIDS - 1)
    for g in range(GRIDS - 2, -1, -1):
        at = F.when(length <= width * COARSER ** (g + 1), g).otherwise(at)
    return at


def gridded(d: DataFrame, start: Column, end: Column, width: float, all_grids: bool) -> DataFrame:
    """d with grid and cell: a row for each cell that start to end touches on its own grid, and with all_grids on all coarser ones, where
    it has two at most. So a very long interval has few rows, and two intervals meet on the coarser of their grids."""
    own = own_grid(end - start, width)
    d = d.withColumn("__v_own", own)
    grids = F.sequence(F.col("__v_own"), F.lit(GRIDS - 1)) if all_grids else F.array("__v_own")
    d = d.withColumn("grid", F.explode(grids))
    size = F.lit(float(width)) * F.pow(F.lit(float(COARSER)), F.col("grid"))
    return d.withColumn("cell", F.explode(F.sequence(F.floor(start / size), F.floor(end / size))))


def overlaps(left: DataFrame, right: DataFrame, key: str, width: float) -> DataFrame:
    """Pairs of overlapping intervals with their overlap. Both sides are dealt to cells of time of the given width, long ones to
    wider ones, so that the join is on equality; of the grid that is the coarser of the two the cell of the later start owns a pair.
    Intervals that end before they begin are left out. left: key, lid, start, end; right: key, rid, start, end."""
    real = F.col("start") <= F.col("end")
    cells = lambda d: gridded(d.where(real), F.col("start"), F.col("end"), width, True)
    a = cells(left).withColumnsRenamed({"start": "ls", "end": "le", "__v_own": "__v_lown"})
    b = cells(right).withColumnsRenamed({"start": "rs", "end": "re", "__v_own": "__v_rown"})
    size = F.lit(float(width)) * F.pow(F.lit(float(COARSER)), F.col("grid"))
    met = a.join(b, [key, "grid", "cell"]).withColumn("overlap", F.least("le", "re") - F.greatest("ls", "rs"))
    mine = (F.col("grid") == F.greatest("__v_lown", "__v_rown")) & (F.col("cell") == F.floor(F.greatest("ls", "rs") / size))
    return met.where((F.col("overlap") > 0) & mine).drop("cell", "grid", "__v_lown", "__v_rown")


def most_overlap(left: DataFrame, right: DataFrame, key: str, width: float) -> DataFrame:
    """For each left interval the right one with the most overlap (smallest rid on ties)."""
    return overlaps(left, right, key, width).groupBy(key, "lid").agg(F.min(F.struct((-F.col("overlap")).alias("m"), "rid")).alias("best")).select(key, "lid", F.col("best.rid").alias("rid"), (-F.col("best.m")).alias("overlap"))


def asof(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left (key, lid, at) with rid of the last right row (key, rid, at) at or before it: one sort of both sides together."""
    both = left.select(key, "at", F.lit(1).alias("side"), "lid", F.lit(None).cast("bigint").alias("rid")).unionByName(right.select(key, "at", F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("lid"), "rid"))
    w = Window.partitionBy(key).orderBy("at", "side", "rid").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("rid", F.last("rid", ignorenulls=True).over(w)).where("side = 1").select(key, "lid", "at", "rid")


def gap_sessions(d: DataFrame, key: str, at: Column, order: list[str], gap: float) -> DataFrame:
    """d with session: it rises where more than gap lies between a row and the one before."""
    w = Window.partitionBy(key).orderBy(*order)
    d = d.withColumn("new", F.coalesce((at - F.lag(at).over(w) > gap).cast("int"), F.lit(0)))
    return d.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def cue_checks(cues: DataFrame, key: str, longest: float = 12.0, shortest: float = 0.5, fastest: float = 20.0) -> DataFrame:
    """Counts of a medium's faults (key, start, end, text): overlap, long, short, fast and invalid cues."""
    w = Window.partitionBy(key).orderBy("start", "end")
    length, valid = F.col("end") - F.col("start"), F.col("end") > F.col("start")
    d = cues.withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    return d.groupBy(key).agg(
        n(F.col("start") < F.col("reach"))("overlap"), n(length > longest)("long_duration"), n(valid & (length < shortest))("short_duration"),
        n(valid & (F.length(F.regexp_replace("text", r"\s", "")) / length > fastest))("fast"), n(~valid)("invalid_duration"),
    )


def containing(points: DataFrame, cues: DataFrame, key: str, width: float) -> DataFrame:
    """For each point (key, lid, at) the interval (key, rid, start, end) that holds it and whose centre is nearest (smallest
    rid on ties); both sides are dealt to cells of time of the given width, long intervals to wider ones."""
    grids = F.explode(F.sequence(F.lit(0), F.lit(GRIDS - 1)))
    a = points.withColumn("grid", grids).withColumn("cell", F.floor(F.col("at") / (F.lit(float(width)) * F.pow(F.lit(float(COARSER)), F.col("grid")))))
    b = gridded(cues.where(F.col("start") <= F.col("end")), F.col("start"), F.col("end"), width, False)
    met = a.join(b, [key, "grid", "cell"]).where(F.col("at").between(F.col("start"), F.col("end")))
    return met.groupBy(key, "lid").agg(F.min(F.struct(F.abs((F.col("start") + F.col("end")) / 2 - F.col("at")).alias("far"), "rid")).alias("best")).select(key, "lid", F.col("best.rid").alias("rid"))


def room(cues: DataFrame, key: str, extension: float = 0.75) -> DataFrame:
    """cues (key, event_id, start, end) with available: their length and the silence behind them, extension at most."""
    after = F.lead("start").over(Window.partitionBy(key).orderBy("start", "event_id")) - F.col("end")
    return cues.withColumn("available", F.col("end") - F.col("start") + F.greatest(F.lit(0.0), F.least(F.lit(extension), F.coalesce(after, F.lit(extension)))))


def allot(d: DataFrame, key: str, order: str, weight: Column, total: int) -> DataFrame:
    """d with share: a whole part of total in proportion to weight; the last row of a key gets what is left."""
    w = Window.partitionBy(key)
    d = d.withColumn("part", F.floor(weight * total / F.sum(weight).over(w) + 0.5))
    last = F.row_number().over(w.orderBy(F.desc(order))) == 1
    return d.withColumn("share", F.when(last, F.lit(total) - F.sum("part").over(w) + F.col("part")).otherwise(F.col("part"))).drop("part")


def context(d: DataFrame, key: str, order: str, value: str, size: int = 3) -> DataFrame:
    """d with the values of up to size rows before and after each."""
    w = Window.partitionBy(key).orderBy(order)
    return d.withColumns({"before": F.collect_list(value).over(w.rowsBetween(-size, -1)), "after": F.collect_list(value).over(w.rowsBetween(1, size))})
