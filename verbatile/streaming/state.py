"""Streams with state, and incremental runs: counter differences, task sessions, rescans by content, periodic refresh."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COUNTERS = ("input_tokens", "cached_input_tokens", "output_tokens", "total_tokens")


def counter_stream(readings: DataFrame) -> DataFrame:
    """What each reading of running counters (file, line, and COUNTERS) adds to the one before it of its file: method `first`,
    `duplicate` (nothing), `delta`, or `reset` where a counter has fallen (the reading itself).

    The state of a file is its last reading; within a trigger readings are taken by line."""
    names = list(COUNTERS)
    out = "file string, line bigint, method string, " + ", ".join(f"{n} bigint" for n in names)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = []
        for r in pd.concat(batches).sort_values("line").itertuples():
            now = tuple(int(getattr(r, n)) for n in names)
            if last is None:
                method, add = "first", now
            elif now == tuple(last):
                method, add = "duplicate", (0,) * len(names)
            elif all(a >= b for a, b in zip(now, last, strict=True)):
                method, add = "delta", tuple(a - b for a, b in zip(now, last, strict=True))
            else:
                method, add = "reset", now
            rows.append((key[0], r.line, method, *add))
            last = now
        state.update(tuple(last))
        yield pd.DataFrame(rows, columns=["file", "line", "method", *names])

    return readings.groupBy("file").applyInPandasWithState(run, out, ", ".join(f"{n} bigint" for n in names), "append", GroupStateTimeout.NoTimeout)


def task_stream(marks: DataFrame) -> DataFrame:
    """Tasks (file, task, begin, end, events) of marked events (file, line, kind): `start` opens one, `complete` closes it; a start while one
    is open closes that one at the line before. A task is told when it is closed; the state holds the open one."""
    out = "file string, task bigint, begin bigint, end bigint, events bigint"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, begin, n, last = state.get if state.exists else (0, -1, 0, -1)
        rows = []
        for r in pd.concat(batches).sort_values("line").itertuples():
            if r.kind == "start":
                if begin >= 0:
                    rows.append((key[0], number, begin, last, n))
                number, begin, n = number + 1, int(r.line), 0
            if begin >= 0:
                n += 1
            last = int(r.line)
            if r.kind == "complete" and begin >= 0:
                rows.append((key[0], number, begin, last, n))
                begin, n = -1, 0
        state.update((number, begin, n, last))
        yield pd.DataFrame(rows, columns=["file", "task", "begin", "end", "events"])

    return marks.groupBy("file").applyInPandasWithState(run, out, "number bigint, begin bigint, n bigint, last bigint", "append", GroupStateTimeout.NoTimeout)


def fingerprint(lexicon: DataFrame, policy: dict[str, object], column: str = "word") -> str:
    """Digest of a policy and a lexicon, whatever its order: what cached scans depend on. The lexicon's digest is a sum of the words' own, so
    no task holds all of it."""
    import hashlib
    import json

    part = lambda k: F.sum(F.conv(F.substring(F.sha2(F.lower(column), 256), k, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    row = lexicon.select(column).distinct().agg(F.count(F.lit(1)), *[part(k) for k in (1, 16, 31, 46)]).first()
    return hashlib.sha256(json.dumps([policy, list(row)], sort_keys=True, default=str).encode()).hexdigest()


def rescan(files: DataFrame, cache: DataFrame, scan: Callable[[DataFrame], DataFrame], mark: str) -> tuple[DataFrame, dict[str, int]]:
    """The cache (path, sha256, fingerprint, found) after a scan of files (path, text): only changed files are scanned, those that are gone
    leave it, another fingerprint makes all of it anew. scan: from (path, sha256, text) to (path, sha256, found). Also counts."""
    now = files.select("path", F.sha2("text", 256).alias("sha256"), "text")
    good = cache.where(F.col("fingerprint") == mark)
    hits = good.join(now.select("path", "sha256"), ["path", "sha256"], "left_semi")
    misses = now.join(hits.select("path", "sha256"), ["path", "sha256"], "left_anti")
    made = hits.unionByName(scan(misses).withColumn("fingerprint", F.lit(mark)).select(*hits.columns))
    counts = {"hits": hits.count(), "misses": misses.count(), "removed": cache.select("path").join(now.select("path"), "path", "left_anti").count()}
    return made, counts


def refreshed(spark: SparkSession, source: str, schema: str, report: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, every: str | None = None):
    """A report over all lines of a growing folder of JSON lines, written anew below path by each trigger: every so often, or once over what is
    there now. Returns the query."""
    stream = spark.readStream.schema(schema).json(source)

    def write(d: DataFrame, number: int) -> None:
        d.write.mode("overwrite").parquet(path)

    writer = report(stream).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()
