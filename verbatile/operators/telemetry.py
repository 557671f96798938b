"""Usage telemetry: counter differences, sessions, latest rows, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counter_calls(d: DataFrame, key: str, order: str, counters: list[str], last: list[str], monotone: list[str] | None = None) -> DataFrame:
    """Classifies snapshots of running totals and tells what each adds.

    The first snapshot counts its last usage; one equal in all counters is a duplicate; one that is not below the one before
    in any monotone counter counts the difference; any other is a reset and counts its last usage.
    """
    w = Window.partitionBy(key).orderBy(order)
    now, before = F.struct(*counters), F.lag(F.struct(*counters)).over(w)
    d = d.withColumn("before", before)
    grows = F.lit(True)
    for c in monotone or counters:
        grows = grows & (F.col(c) >= F.col(f"before.{c}"))
    method = F.when(F.col("before").isNull(), "first_last_usage").when(now == F.col("before"), "duplicate_snapshot").when(grows, "cumulative_delta").otherwise("reset_last_usage")
    d = d.withColumn("method", method)
    added = {f"added_{c}": F.when(F.col("method") == "duplicate_snapshot", None).when(F.col("method") == "cumulative_delta", F.col(c) - F.col(f"before.{c}")).otherwise(F.col(x)) for c, x in zip(counters, last, strict=True)}
    return d.withColumns(added).drop("before")


def latest(d: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the given order."""
    return d.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("nth = 1").drop("nth")


def melt(d: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return d.unpivot(ids, values, name, value)


def day_range(d: DataFrame, column: str, first: str, last: str, **chosen: list) -> DataFrame:
    """Rows of an inclusive range of days and of the chosen values; an empty choice does not filter."""
    keep = F.col(column).between(first, last)
    for name, values in chosen.items():
        if values:
            keep = keep & F.col(name).isin(values)
    return d.where(keep)


def tasks(d: DataFrame, key: str, order: str, starts: Column, ends: Column) -> DataFrame:
    """key, task (from 1), n, first, last, status. A task runs from a start to the first end behind it; a start before that
    supersedes it; the last one of a key may be incomplete."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.select(key, order, starts.cast("int").alias("s"), ends.cast("int").alias("e")).withColumn("task", F.sum("s").over(w)).where("task > 0")
    d = d.withColumn("over", F.coalesce(F.sum("e").over(Window.partitionBy(key, "task").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("over = 0")
    d = d.groupBy(key, "task").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.max(order).alias("last"), F.max("e").alias("e"))
    most = F.max("task").over(Window.partitionBy(key))
    return d.withColumn("status", F.when(F.col("e") == 1, "completed").when(F.col("task") < most, "superseded_by_next_task").otherwise("incomplete")).drop("e")
