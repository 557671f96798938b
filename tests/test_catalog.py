"""Every registered query against its DuckDB SQL, and operators against worked examples."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from verbatile.functions import text as T
from verbatile.operators import corpus, intervals, records, telemetry
from verbatile.plans import catalog
from verbatile.sources import logs
from verbatile.streaming import windows

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, sf_dir, duck, name):
    want = duck.execute(catalog.ORACLES[name])
    columns = [x[0] for x in want.description]
    got = catalog.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want.fetchall()) and rows


def test_intervals(spark):
    make = lambda rows: spark.createDataFrame([("m", float(a), float(b)) for a, b in rows], "k string, start double, end double")
    out = lambda d: sorted((r.start, r.end) for r in d.collect())
    assert out(intervals.difference(make([(1, 4)]), make([(1.5, 2.5)]), "k")) == [(1.0, 1.5), (2.5, 4.0)]
    assert out(intervals.union(make([(1, 1.2), (1.3, 2)]), "k", 0.11)) == [(1.0, 2.0)]
    cues = make([(0, 3), (2, 20), (21, 21)]).withColumn("text", F.lit("x"))
    (r,) = intervals.cue_checks(cues, "k", longest=8).collect()
    assert (r.overlap, r.long_duration, r.invalid_duration) == (1, 1, 1)


def test_counter_calls(spark):
    names = ["i", "c", "o", "r", "t"]
    rows = [(2, 100, 40, 10, 2, 110, 100, 40, 10, 2, 110), (3, 100, 40, 10, 2, 110, 100, 40, 10, 2, 110), (4, 250, 90, 30, 5, 280, 150, 50, 20, 3, 170), (5, 50, 0, 5, 0, 55, 50, 0, 5, 0, 55)]
    d = spark.createDataFrame([("f", *r) for r in rows], "file string, line int, " + ", ".join(f"{n} bigint" for n in names) + ", " + ", ".join(f"l{n} bigint" for n in names))
    got = telemetry.counter_calls(d, "file", "line", names, [f"l{n}" for n in names], ["i", "c", "o", "t"]).orderBy("line").collect()
    assert [r.method for r in got] == ["first_last_usage", "duplicate_snapshot", "cumulative_delta", "reset_last_usage"]
    assert [r.added_i for r in got] == [100, None, 150, 50]


def test_evaluation_and_trees(spark):
    d = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1)], "y int, p double")
    (r,) = records.confusion(d, F.col("y"), F.col("p"), 0.5).collect()
    assert (r.tn, r.fp, r.fn, r.tp, r.accuracy, r.precision, r.recall) == (1, 1, 1, 1, 0.5, 0.5, 0.5)
    files = spark.createDataFrame([("source/notes.txt", 3), ("source/child/clip.mp4", 8)], "path string, size bigint")
    got = {r.folder: (r.direct_files, r.total_files, r.total_bytes) for r in records.tree_rollup(files, "path", "size").collect()}
    assert got == {"source": (1, 2, 11), "source/child": (1, 1, 8)}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.split_boundary(F.lit("some one, toone, noone"))) == "some one, to one, no one"
    assert one(T.is_stutter(F.lit("W-What"))) and not one(T.is_stutter(F.lit("be-a")))
    assert one(T.srt_time(F.lit(3661.5))) == "01:01:01,500"
    assert one(T.dehyphenate(F.lit("exam-\nple"))) == "example"
    assert one(T.is_speakable(F.lit("a b c"))) is False
    assert one(T.strip_invisible(F.lit("a​b­\n"))) == "ab\n"


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type": "x", "n": 1}\nnot json\n{"type": "y"}\n')
    (tmp_path / "words.txt").write_text("Be 5\nbe 7\nbroken\nx y z\nin two\n")
    (tmp_path / "b.md").write_text("﻿# Title\ntext")
    got = logs.json_lines(spark, str(tmp_path), "type string, n bigint").collect()
    assert sorted((r.type, r.n) for r in got) == [("x", 1), ("y", None)]
    assert [tuple(r) for r in logs.frequency_dictionary(spark, str(tmp_path / "words.txt")).collect()] == [("be", 7)]
    assert [r.text for r in logs.markdown(spark, str(tmp_path)).collect()] == ["# Title\ntext"]
    assert {r.size for r in logs.manifest(spark, str(tmp_path), "*.md", True).collect()} == {15}


def test_event_counts_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    query = windows.event_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == catalog.read(spark, sf_dir, "events").count()


def test_runs_and_evidence(spark):
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", "b", "a"])], "k int, o int, v string")
    assert sorted((r.first, r.last, r.v, r.n) for r in corpus.collapse_runs(d, "k", "o", "v").collect()) == [(0, 1, "a", 2), (2, 2, "b", 1), (3, 3, "a", 1)]
