"""Readers, writers, providers and streams on worked examples."""

import gzip
import json
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from verbatile.functions import passages
from verbatile.operators import boundaries, providers
from verbatile.sinks import stores as sinks
from verbatile.sources import stores
from verbatile.streaming import state


def put(folder, name, value):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(folder)


def rows(d, *columns):
    return sorted((tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in d.collect()), key=str)


def test_lexicons(spark, tmp_path):
    for k, value in enumerate((["Bee", "ant", "bee "], {"words": ["ANT", "Bee"]}, {"_note": "x", "Ant": 3, "bee": 1})):
        assert rows(stores.lexicon(spark, put(tmp_path / str(k), "l.json", value)), "word") == ["ant", "bee"]


def test_decisions(spark, tmp_path):
    good = put(tmp_path / "a", "d.json", {"accepted": {"To  gether": "together", "a way": {"replacement": "away", "blocked_previous": ["In"]}, " ": "x"}, "rejected": ["in to", "In To", ""]})
    accepted, rejected = stores.decisions(spark, good)
    assert rows(accepted, "broken", "replacement", "blocked_previous") == [("a way", "away", ["in"]), ("to gether", "together", [])]
    assert rows(rejected, "broken") == ["in to"]
    with pytest.raises(ValueError, match="to gether"):
        stores.decisions(spark, put(tmp_path / "b", "d.json", {"accepted": {"to gether": "together"}, "rejected": ["To gether"]}))


def test_rules_reviews_examples_ids(spark, tmp_path):
    rules = stores.contextual_rules(spark, put(tmp_path / "r", "r.json", {"rules": [{"source": "form", "suggestion": "from", "previous": ["far"]}, {"source": "", "suggestion": "x"}]}))
    assert rows(rules, "source", "suggestion", "confidence") == [("form", "from", 60.0)]
    reviews = stores.review_records(spark, put(tmp_path / "v", "v.json", {"candidates": [{"token": "A-b", "status": "replace", "replacement": "a, b"}, {"token": "c-d", "status": "review"}]}))
    assert rows(reviews, "token", "replacement") == [("a-b", "a, b")]
    example = lambda i, label, status="reviewed": {"id": i, "user_label": label, "review_status": status}
    made = stores.reviewed_examples(spark, put(tmp_path / "e", "e.json", {"schema_version": 1, "examples": [example("1", "join"), example("2", "keep_spaced"), example("3", None, "pending")]}))
    assert rows(made, "id", "label") == [("1", 1), ("2", 0)]
    for k, bad in enumerate(({"schema_version": 2, "examples": []}, {"schema_version": 1, "examples": [example("1", "join"), example("1", "join")]}, {"schema_version": 1, "examples": [example("1", "odd")]})):
        with pytest.raises(ValueError):
            stores.reviewed_examples(spark, put(tmp_path / f"x{k}", "e.json", bad)).collect()
    assert rows(stores.id_list(spark, put(tmp_path / "i", "i.json", {"ids": ["b", "a"]})), "id") == ["a", "b"]
    with pytest.raises(ValueError):
        stores.id_list(spark, put(tmp_path / "j", "i.json", ["a", "a"]))


def test_cache_config_references_volumes(spark, tmp_path):
    schema = "path string, n bigint, fingerprint string"
    d = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n bigint")
    where = str(tmp_path / "cache")
    sinks.write_cache(d, where, "f1", ["path"])
    assert rows(stores.cached_scan(spark, where, schema, "f1"), "path", "n") == [("a", 1), ("b", 2)]
    assert stores.cached_scan(spark, where, schema, "f2").count() == 0 == stores.cached_scan(spark, str(tmp_path / "none"), schema, "f1").count()
    (file,) = [f for f in (tmp_path / "cache").glob("*.gz") if gzip.open(f).read()]
    assert b'"fingerprint":"f1"' in gzip.open(file).read()
    config = {"a": {"b": 1}}
    assert stores.config_value(config, "a.b") == 1 and stores.config_value(config, "a.c", 2) == 2
    with pytest.raises(KeyError):
        stores.config_value(config, "a.c")
    refs = stores.references(spark, put(tmp_path / "q", "q.json", {"references": [{"sample": "s1", "group_id": "g", "required": ["x"]}, {"sample": "s2", "group_id": "h"}]}), "s1")
    assert rows(refs, "group_id", "required") == [("g", ["x"])]
    lines = spark.createDataFrame([("p", i, t) for i, t in enumerate(["lost", "Volume 1", "One", "", "Two", "VOLUME 2", "Three"])], "path string, line int, text string")
    assert rows(stores.volume_headings(lines), "volume", "heading") == [(1, "One"), (1, "Two"), (2, "Three")]


def test_assistant_and_free_text_logs(spark, tmp_path):
    put(tmp_path / "vs" / "debug-logs" / "s1", "main.jsonl", '{"type":"user_message","ts":1,"attrs":{"content":"hi"}}\nbroken\n{"type":"llm_request","ts":2,"attrs":{"model":"m"}}\n')
    assert rows(stores.assistant_logs(spark, str(tmp_path / "vs")), "line", "type") == [(0, "user_message"), (2, "llm_request")]
    put(tmp_path / "log", "a.log", "head\nBEGIN 1\n- In: 5\n- In: 7\nBEGIN 2\nnothing\n")
    d = stores.free_text_log(spark, str(tmp_path / "log"), "BEGIN", {"tokens": r"(?m)^- In: (\d+)"})
    assert rows(d, "nth", "tokens") == [(1, 12), (2, 0)]


def box(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


def element(ident, body):
    return bytes.fromhex(ident) + bytes([0x08, 0, 0, 0, 0][:0]) + bytes([0x10 | 0]) + len(body).to_bytes(3, "big") + body


def test_container_durations(spark):
    old = box(b"ftyp", b"isom") + box(b"free", b"x") + box(b"moov", box(b"mvhd", bytes(12) + struct.pack(">II", 1000, 2500) + bytes(80)))
    wide = box(b"ftyp", b"isom") + box(b"moov", box(b"mvhd", b"\x01" + bytes(19) + struct.pack(">IQ", 600, 1200) + bytes(80)))
    mkv = element("1a45dfa3", b"") + element("18538067", element("1549a966", element("2ad7b1", (1_000_000).to_bytes(3, "big")) + element("4489", struct.pack(">d", 1500.0))))
    assert stores.mp4_seconds(old) == 2.5 and stores.mp4_seconds(wide) == 2.0 and stores.matroska_seconds(mkv) == 1.5
    assert [stores.native_seconds(x) for x in (None, b"", b"junk", old[:40], mkv[:10])] == [None] * 5
    d = spark.createDataFrame([("a", bytearray(old)), ("b", bytearray(b"junk")), ("c", None)], "path string, content binary")
    probe = F.when(F.col("path") == "b", 7.0)
    assert rows(stores.media_seconds(d, probe), "path", "seconds") == [("a", 2.5), ("b", 7.0), ("c", 0.0)]
    files = spark.sql("SELECT * FROM VALUES ('a', 1L, timestamp'2024-01-01 00:00:00.9'), ('b', 2L, timestamp'2024-01-01 00:00:00') t(path, size, modified)")
    cache = spark.sql("SELECT * FROM VALUES ('a', 1L, timestamp'2024-01-01 00:00:00.1', 5.0D), ('b', 3L, timestamp'2024-01-01 00:00:00', 6.0D) t(path, size, modified, seconds)")
    assert rows(stores.cached_durations(files, cache), "path", "seconds") == [("a", 5.0), ("b", None)]


def test_json_texts():
    find = passages.first_value(("model", "name"))
    assert find('{"x": {"model": "deep"}, "name": "top"}') == "top" and find('{"x": [{"name": ""}, {"model": "m"}]}') == "m" and find("no") is None
    said = lambda **p: passages.message_text(json.dumps({"type": "response_item", "payload": {"type": "message", "role": "user", **p}}))
    assert said(content=[{"type": "input_text", "text": " a "}, {"type": "output_text", "text": "no"}, "b", {"content": ["c"]}]) == "a b c"
    assert passages.message_text('{"type": "event_msg", "payload": {"type": "user_message", "message": "hi"}}') == "hi"
    assert passages.message_text('{"type": "event_msg", "payload": {"type": "token_count"}}') is None and passages.message_text("x") is None
    assert passages.normal_form("NFD")("é") == "é" and passages.normal_form()("ﬁ") == "fi"
    with pytest.raises(ValueError):
        passages.normal_form("X")


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(2, None), (1, "a")], "i int, t string")
    at = str(tmp_path / "full")
    assert sinks.full_refresh({"one": d}, at) == {"one": 2} == sinks.full_refresh({"one": d}, at)
    assert [sinks.ensured(spark, str(tmp_path / "t"), s) for s in ("a int", "a int", "a int, b string")] == ["made", "kept", "replaced"]
    sinks.write_json(d, str(tmp_path / "json"), ["i"])
    (file,) = (tmp_path / "json").glob("part-*")
    assert json.loads(file.read_text()) == [{"i": 1, "t": "a"}, {"i": 2, "t": None}]
    docs = spark.createDataFrame([(1, "A")], "doc_id int, text string")
    changes = sinks.change_rows(spark.createDataFrame([(1, "a"), (2, None)], "doc_id int, text string"), spark.createDataFrame([(1, "A"), (2, None)], "doc_id int, text string"), ["doc_id"], "text", "Upper", "why")
    assert rows(changes, "doc_id", "before", "after", "applied") == [(1, "a", "A", True)]
    sinks.write_cleaned(docs, changes, str(tmp_path / "in"), str(tmp_path / "out"))
    (file,) = (tmp_path / "out" / "summary").glob("part-*")
    assert file.read_text().splitlines()[-1] == "| Upper | 1 | 0 |"
    with pytest.raises(ValueError):
        sinks.write_cleaned(docs, changes, str(tmp_path / "in"), str(tmp_path / "in"))
    folders = spark.createDataFrame([("a<b", 2, 20), ("c", 1, 100)], "folder string, files bigint, bytes bigint")
    assert [r.line for r in sinks.folder_report(folders, 1.05).orderBy("nth").collect()][1:-1] == ["<tr><td>a&lt;b</td><td>2</td><td>20</td></tr>"]
    split = spark.createDataFrame([("train", "b"), ("train", "a"), ("test", "c")], "split string, id string")
    assert rows(sinks.split_manifest(split, "split", "id", 7), "split", "ids", "seed") == [("test", ["c"], 7), ("train", ["a", "b"], 7)]
    files = spark.createDataFrame([("p", bytearray(b"xyz"))], "path string, content binary")
    (copy,) = sinks.backup(files, str(tmp_path / "backup"), "20240101").collect()
    assert copy.size == 3 and len(copy.sha256) == 64
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.backup(files, str(tmp_path / "backup"), "20240101")
    done = spark.createDataFrame([("b", "broke"), ("a", None), ("c", "lost")], "name string, error string")
    assert tuple(sinks.outcomes(done).first()) == (1, 2, "b: broke\nc: lost")
    words = spark.createDataFrame([("Bee",), ("ant",)], "word string")
    assert [r.word for r in sinks.approved(words, add=["BEE", "cow"]).collect()] == ["ant", "Bee", "cow"]
    assert [r.word for r in sinks.approved(words, remove=["ANT"]).collect()] == ["Bee"]
    for wrong in ({}, {"add": ["a"], "remove": ["b"]}, {"add": ["a1"]}):
        with pytest.raises(ValueError):
            sinks.approved(words, **wrong)
    parts = spark.createDataFrame([(1, "A: b/c"), (2, None)], "n int, t string")
    assert [r.name for r in sinks.chapters_out(parts, "n", "t").orderBy("n").collect()] == ["01 - A bc", "02 - "]


def test_unique_names_pass_over_numbers_that_are_given(spark):
    d = spark.createDataFrame([(k, "f", n) for k, n in enumerate(["a.md", "A.md", "a (2).md", "a.MD", "b"])], "k int, folder string, name string")
    got = [r.unique for r in boundaries.unique_names(d, "folder", "name", "k").orderBy("k").collect()]
    assert got == ["a.md", "A (3).md", "a (2).md", "a (4).MD", "b"] and len({g.lower() for g in got}) == 5


def test_providers(spark):
    with pytest.raises(ValueError):
        providers.register(providers.Provider("echo", lambda s: s))
    d = spark.createDataFrame([("One. Two.",), ("none",), (None,)], "t string")
    assert rows(d.select(providers.FIRST_SENTENCE.column(F.col("t")).alias("x")), "x") == [None, "One.", "none"]
    calls = {"n": 0}

    def primary(t):
        calls["n"] += 1
        if t == "boom":
            raise RuntimeError
        return "bad" if calls["n"] < 3 else "good"

    answer = providers.retried(primary, lambda t: "plan b", lambda t, a: a != "bad", 2)
    got = answer(pd.Series(["x", "y", "boom", None]))
    assert got.value.tolist() == ["plan b", "good", "plan b", None]
    assert got.attempts.tolist() == [["primary: invalid", "primary: invalid", "fallback: ok"], ["primary: ok"], ["primary: RuntimeError"] * 2 + ["fallback: ok"], []]
    out = providers.with_retries(d, "t", "r", str.upper, lambda t: t, lambda t, a: True)
    assert rows(out.select("r.value"), "value") == ["NONE", None, "ONE. TWO."]
    cache = spark.createDataFrame([], "key string, result string")
    first, grown = providers.cached(spark.createDataFrame([("a",), ("a",), ("b",)], "t string"), cache, providers.ECHO, "t")
    assert first.count() == 3 and grown.count() == 2
    again, same = providers.cached(spark.createDataFrame([("a",)], "t string"), grown, providers.ECHO, "t")
    assert same.count() == 2 and again.first().result == "a"
    rows_ = spark.range(20)
    assert providers.probed(rows_, ["id"], F.col("id") < 2) and not providers.probed(rows_, ["id"], F.col("id") < 3)
    assert providers.promoted(0.2, 0.17) and not providers.promoted(0.2, 0.18)


def test_stages_batches_and_preflight(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "boom")], "k int, t string")
    out, report = providers.run_stages(d, [("up", lambda x: x.withColumn("t", F.upper("t"))), ("bad", lambda x: x.select("nothing")), ("off", lambda x: x.limit(0)), ("end", lambda x: x.withColumn("n", F.length("t")))], {"off": False})
    assert [r["status"] for r in report] == ["done", "failed", "disabled", "done"] and rows(out, "t", "n") == [("A", 1), ("BOOM", 4)]
    path, broken = str(tmp_path / "run"), [True]

    def second():
        if broken:
            raise RuntimeError("not yet")
        return spark.read.parquet(path + "/first")

    stages = [("first", lambda: d), ("second", second)]
    assert providers.resumable(spark, path, stages) == {"first": "done", "second": "failed"}
    broken.clear()
    assert providers.resumable(spark, path, stages) == {"first": "skipped", "second": "done"}

    def work(t):
        if t == "boom":
            raise ValueError("no")
        return t * 2

    assert [tuple(r) for r in providers.batch(d, "t", work, "k").collect()] == [(1, "a", "aa", None), (2, "boom", None, "ValueError: no")]
    parts = spark.createDataFrame([("a", '{"segments": [1, 2]}'), ("b", '{"segments": [1]}'), ("c", None), ("d", "{"), ("e", "{}")], "artifact string, body string")
    assert rows(providers.preflight(parts), "artifact", "issue") == [("b", "segment count"), ("c", "missing"), ("d", "invalid JSON"), ("e", "no segments")]


def stream(spark, folder, schema, step, out, checkpoint):
    query = step(spark.readStream.schema(schema).json(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def test_counter_stream_goes_on(spark, tmp_path):
    schema = "file string, line bigint, input_tokens bigint, cached_input_tokens bigint, output_tokens bigint, total_tokens bigint"
    line = lambda f, n, t: json.dumps({"file": f, "line": n, "input_tokens": t, "cached_input_tokens": 0, "output_tokens": 1, "total_tokens": t + 1})
    folder = put(tmp_path / "in", "1.json", "\n".join([line("a", 2, 15), line("a", 1, 10), line("b", 1, 3)]))
    args = (spark, folder, schema, state.counter_stream, str(tmp_path / "out"), str(tmp_path / "check"))
    stream(*args)
    put(tmp_path / "in", "2.json", "\n".join([line("a", 3, 15), line("a", 4, 4), line("b", 2, 9)]))
    got = rows(stream(*args), "file", "line", "method", "input_tokens")
    assert got == [("a", 1, "first", 10), ("a", 2, "delta", 5), ("a", 3, "duplicate", 0), ("a", 4, "reset", 4), ("b", 1, "first", 3), ("b", 2, "delta", 6)]


def test_task_stream_goes_on(spark, tmp_path):
    event = lambda n, k: json.dumps({"file": "f", "line": n, "kind": k})
    folder = put(tmp_path / "in", "1.json", "\n".join(event(n, k) for n, k in [(1, "x"), (2, "start"), (3, "x"), (4, "complete"), (5, "x"), (6, "start")]))
    args = (spark, folder, "file string, line bigint, kind string", state.task_stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert rows(stream(*args), "task", "begin", "end", "events") == [(1, 2, 4, 3)]
    put(tmp_path / "in", "2.json", "\n".join(event(n, k) for n, k in [(7, "x"), (8, "start"), (9, "complete")]))
    assert rows(stream(*args), "task", "begin", "end", "events") == [(1, 2, 4, 3), (2, 6, 7, 2), (3, 8, 9, 2)]


def test_rescan_and_refresh(spark, tmp_path):
    files = lambda *x: spark.createDataFrame(list(x), "path string, text string")
    words = spark.createDataFrame([("b",), ("A",)], "word string")
    mark = state.fingerprint(words, {"least": 3})
    assert mark == state.fingerprint(spark.createDataFrame([("a",), ("B",)], "word string"), {"least": 3}) != state.fingerprint(words, {"least": 4})
    cache = spark.createDataFrame([], "path string, sha256 string, fingerprint string, found bigint")
    scan = lambda d: d.select("path", "sha256", F.length("text").cast("bigint").alias("found"))
    one, counts = state.rescan(files(("a", "x"), ("b", "yy")), cache, scan, mark)
    assert counts == {"hits": 0, "misses": 2, "removed": 0}
    two, counts = state.rescan(files(("a", "x"), ("b", "yyy"), ("c", "")), one, scan, mark)
    assert counts == {"hits": 1, "misses": 2, "removed": 0} and rows(two, "path", "found") == [("a", 1), ("b", 3), ("c", 0)]
    assert state.rescan(files(("a", "x")), two, scan, "other")[1] == {"hits": 0, "misses": 1, "removed": 2}
    folder = put(tmp_path / "in", "1.json", '{"k": "a"}\n{"k": "b"}')
    run = lambda: state.refreshed(spark, folder, "k string", lambda d: d.groupBy("k").count(), str(tmp_path / "report"), str(tmp_path / "check")).awaitTermination()
    run()
    put(tmp_path / "in", "2.json", '{"k": "a"}')
    run()
    assert rows(spark.read.parquet(str(tmp_path / "report")), "k", "count") == [("a", 2), ("b", 1)]


def test_clusters_and_chunk_sizes(spark, tmp_path):
    import numpy as np

    from verbatile.operators import assembly
    from verbatile.sources import logs

    r = np.random.default_rng(3)
    centres = np.eye(6)[:3]
    vectors = np.concatenate([centres[k] + r.normal(0, 0.05, (12, 6)) for k in range(3)])
    label = assembly.clusters(vectors, 6)
    assert len(set(label.tolist())) == 3 and all(len(set(label[k * 12 : k * 12 + 12].tolist())) == 1 for k in range(3))
    assert assembly.clusters(vectors[:2], 6).tolist() == [0, 0]
    d = spark.createDataFrame([("m", i, [float(x) for x in v]) for i, v in enumerate(vectors)], "medium string, i int, v array<double>")
    assert rows(assembly.speaker_clusters(d, "medium", "i", "v"), "i", "speaker") == sorted(((i, i // 12) for i in range(36)), key=str)
    with pytest.raises(ValueError):
        assembly.speaker_clusters(d, "medium", "i", "v", utterances=10)
    sizes = []
    assert passages.chunk_size(lambda n: sizes.append(n) or 10_000_000 // n, 2600, 1200, 6000, 1400) == 6000 and sizes == [2600, 3770, 5466, 6000]
    assert passages.chunk_size(lambda n: 0, 2600, 1200, 6000, 1400) == 2600 and passages.chunk_size(lambda n: 10, 1300, 1200, 6000, 1400) == 1200
    for name in ("a.PDF", "b.epub", "c.txt"):
        (tmp_path / name).write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in logs.listing(spark, str(tmp_path), logs.DOCUMENTS).collect()] == ["a.PDF", "b.epub"]
