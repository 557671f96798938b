"""Providers (functions that a user supplies, such as models), stages and batches around them. A provider has a name, which is part of
what its results' keys are made of; the defaults need no model and always give the same."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbatile.functions import subtitles


@dataclass(frozen=True)
class Provider:
    """A named function from a series of texts to a series of results of a Spark type."""

    name: str
    function: Callable[[pd.Series], pd.Series]
    kind: str = "string"

    def column(self, c: Column) -> Column:
        return F.pandas_udf(self.function, self.kind)(c)


REGISTRY: dict[str, Provider] = {}


def register(provider: Provider) -> Provider:
    """Makes a provider known by its name; another one under a known name is an error."""
    if REGISTRY.setdefault(provider.name, provider) is not provider:
        raise ValueError(f"provider known already: {provider.name}")
    return provider


# Defaults without a model: the text itself, its first sentence, and how alike two texts are by their words.
ECHO = register(Provider("echo", lambda s: s))
FIRST_SENTENCE = register(Provider("first-sentence", lambda s: s.fillna("").str.extract(r"^(.*?[.!?])(?:\s|$)", expand=False).fillna(s)))


def word_likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words of two texts; 1 if neither has any."""
    words = lambda c: F.array_distinct(F.filter(F.split(subtitles.spaced_key(c), " "), lambda w: w != ""))
    both, either = F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b)))
    return F.when(either == 0, 1.0).otherwise(both / either)


def content_key(provider: Provider, *inputs: Column) -> Column:
    """Digest of a provider's name and inputs."""
    parts = [F.coalesce(c.cast("string"), F.lit("\u0002")) for c in inputs]
    return F.sha2(F.concat_ws("\u0001", F.lit(provider.name), *parts), 256)


def retried(primary: Callable[[str], str], fallback: Callable[[str], str], valid: Callable[[str, str], bool], attempts: int = 3) -> Callable[[pd.Series], pd.DataFrame]:
    """A function of a series: value and attempts (what was tried and how it ended) of the first valid answer of primary in so many
    attempts, else of fallback, else null."""

    def one(text: str) -> tuple[str | None, list[str]]:
        told = []
        for name, function in [*[("primary", primary)] * attempts, ("fallback", fallback)]:
            try:
                answer = function(text)
            except Exception as e:  # a provider may fail in any way; it is told
                told.append(f"{name}: {type(e).__name__}")
                continue
            if valid(text, answer):
                return answer, [*told, f"{name}: ok"]
            told.append(f"{name}: invalid")
        return None, told

    return lambda s: pd.DataFrame([one(t) if t is not None else (None, []) for t in s], columns=["value", "attempts"])


RETRIED = "value string, attempts array<string>"


def with_retries(rows: DataFrame, column: str, out: str, primary, fallback, valid, attempts: int = 3) -> DataFrame:
    return rows.withColumn(out, F.pandas_udf(retried(primary, fallback, valid, attempts), RETRIED)(F.col(column)))


def cached(rows: DataFrame, cache: DataFrame, provider: Provider, column: str) -> tuple[DataFrame, DataFrame]:
    """rows with key and result, and the cache (key, result) with what was missing: the provider is only asked for those, once each."""
    d = rows.withColumn("key", content_key(provider, F.col(column)))
    missing = d.select("key", column).dropDuplicates(["key"]).join(cache, "key", "left_anti")
    grown = cache.unionByName(missing.select("key", provider.column(F.col(column)).alias("result")))
    return d.join(grown, "key", "left"), grown


def probed(rows: DataFrame, order: list[str], invalid: Column, probe: int = 8, most: float = 0.25) -> bool:
    """Whether a backend may go on: of its first rows no more than that share is invalid. Only those rows are looked at."""
    share = rows.orderBy(*order).limit(probe).agg(F.avg(F.when(invalid, 1.0).otherwise(0.0))).first()[0]
    return share is None or share <= most


def promoted(current: float, candidate: float, margin: float = 0.025) -> bool:
    """Whether a candidate backend's invalid rate is better by the margin."""
    return candidate <= current - margin


def machine_review(source_likeness: Column, route_likeness: Column, confidence: Column, routes: Column, grounded: Column, issues: Column) -> Column:
    """accepted where all thresholds are met, or grounded evidence without issues stands in for them; rejected with issues and little
    likeness; else review."""
    met = (source_likeness >= 0.85) & (route_likeness >= 0.90) & (confidence >= 0.85) & (routes >= 2)
    return F.when((issues == 0) & (met | F.coalesce(grounded, F.lit(False))), "accepted").when((issues > 0) & (source_likeness < 0.5), "rejected").otherwise("review")


ANSWER = T.StructType([T.StructField("group_id", T.StringType()), T.StructField("translation", T.StringType()), T.StructField("choice", T.StringType())])


def adjudicated(answers: DataFrame, keep: tuple[str, ...] = (), choices: tuple[str, ...] = ("primary", "independent", "new")) -> DataFrame:
    """answers (group_id, source, answer as JSON; other columns that keep names) with translation and verdict: `malformed` if the JSON lacks a field, has others or is for
    another group; `faulty` with the integrity issues of its translation; else `accepted`."""
    d = answers.withColumn("a", F.from_json("answer", ANSWER))
    keys = F.array_sort(F.json_object_keys("answer"))
    good = keys.eqNullSafe(F.array(*map(F.lit, sorted(ANSWER.names)))) & (F.col("a.group_id") == F.col("group_id")) & F.col("a.choice").isin(*choices) & F.col("a.translation").isNotNull()
    faults = subtitles.integrity_issues(F.col("source"), F.col("a.translation"))
    verdict = F.when(~F.coalesce(good, F.lit(False)), "malformed").when(F.size(faults) > 0, "faulty").otherwise("accepted")
    return d.select(*keep, "group_id", F.when(verdict == "accepted", F.col("a.translation")).alias("translation"), verdict.alias("verdict"), F.when(verdict == "faulty", faults).alias("issues"))


def run_stages(rows: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], enabled: dict[str, bool] | None = None) -> tuple[DataFrame, list[dict]]:
    """rows through stages in order, and a report of each: a stage that fails is rolled back and told, the others go on."""
    report = []
    for name, stage in stages:
        if enabled is not None and not enabled.get(name, True):
            report.append({"stage": name, "status": "disabled"})
            continue
        began = time.monotonic()
        try:
            made = stage(rows)
            made.schema  # noqa: B018  the plan is analysed here, so that a faulty stage fails in its own place
            rows, status = made, {"status": "done"}
        except Exception as e:  # a stage may fail in any way; it is told
            status = {"status": "failed", "error": f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"}
        report.append({"stage": name, **status, "seconds": round(time.monotonic() - began, 3)})
    return rows, report


def resumable(spark, path: str, stages: list[tuple[str, Callable[[], DataFrame]]]) -> dict[str, str]:
    """Runs stages whose outputs aren't there yet, in order; each is written below path and marked in a manifest when it is done. A stage that
    fails is marked and ends the run; a later run takes up from there."""
    states: dict[str, str] = {}
    fs = lambda p: p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = lambda *x: spark._jvm.org.apache.hadoop.fs.Path("/".join((path, *x)))
    mark = lambda name, state: spark.createDataFrame([(json.dumps({"stage": name, "state": state}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest/{name}")
    for name, stage in stages:
        done = at(name, "_SUCCESS")
        if fs(done).exists(done):
            states[name] = "skipped"
            continue
        mark(name, "running")
        try:
            stage().write.mode("overwrite").parquet(f"{path}/{name}")
        except Exception:
            mark(name, "failed")
            states[name] = "failed"
            break
        mark(name, "done")
        states[name] = "done"
    return states


def batch(files: DataFrame, column: str, function: Callable[[str], str], order: str, tasks: int = 4) -> DataFrame:
    """files with result and error: a function that fails for one file fails for that one only. At most so many tasks run it, and results are
    in order."""

    def one(s: pd.Series) -> pd.DataFrame:
        out = []
        for t in s:
            try:
                out.append((function(t), None))
            except Exception as e:  # told, not raised
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["result", "error"])

    d = files.repartition(tasks).withColumn("__v_made", F.pandas_udf(one, "result string, error string")(F.col(column)))
    return d.select(*files.columns, "__v_made.result", "__v_made.error").orderBy(order)


def preflight(artifacts: DataFrame) -> DataFrame:
    """artifact, issue of artifacts (artifact, body): missing, no JSON, no segments, or another number of segments than the first one has."""
    n = F.size(F.from_json(F.get_json_object("body", "$.segments"), "array<string>"))
    d = artifacts.select("artifact", "body", F.when(F.col("body").isNotNull() & F.try_parse_json("body").isNotNull(), n).alias("n"))
    first = artifacts.agg(F.min("artifact").alias("first"))
    want = d.join(F.broadcast(first), F.col("artifact") == F.col("first")).select(F.col("n").alias("want"))
    d = d.crossJoin(F.broadcast(want))  # one row
    issue = F.when(F.col("body").isNull(), "missing").when(F.try_parse_json("body").isNull(), "invalid JSON").when(F.col("n").isNull() | (F.col("n") < 0), "no segments").when(F.col("n") != F.col("want"), "segment count")
    return d.select("artifact", issue.alias("issue")).where("issue IS NOT NULL")


def stage_metrics(checks: DataFrame, by: str) -> DataFrame:
    """by, groups, failed, passed: of checks (by, group_id, issues array) how many groups have issues, and whether none has."""
    bad = F.size("issues") > 0
    return checks.groupBy(by).agg(F.count(F.lit(1)).alias("groups"), F.count_if(bad).alias("failed"), F.bool_and(~bad).alias("passed"))
