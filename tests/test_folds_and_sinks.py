"""Folds, narration, spelling and sinks against worked examples."""

import itertools

import pytest
from pyspark.sql import functions as F

from verbatile.functions import narration, passages
from verbatile.functions import text as T
from verbatile.operators import folds, markdown, records, spelling
from verbatile.sinks import documents

CUES = "m string, start double, end double, speaker string, text string"


def out(d):
    return [tuple(r)[1:] for r in d.orderBy("start", "end").collect()]


def test_sentences(spark):
    words = [("m", 0.0, 0.2, "a", "One"), ("m", 0.3, 0.5, "a", "two."), ("m", 0.7, 0.9, "a", "Three"), ("m", 2.0, 2.2, "a", "four"), ("m", 2.2, 2.4, "b", "five"), ("m", 2.5, None, "b", "x"), (None, 0.0, 1.0, None, None)]
    got = out(folds.sentences(spark.createDataFrame(words, CUES), "m"))
    assert got == [(0.0, 0.5, "a", "One two."), (0.0, 1.0, None, None), (0.7, 0.9, "a", "Three"), (2.0, 2.2, "a", "four"), (2.2, 2.4, "b", "five")]
    many = spark.createDataFrame([("m", i * 0.3, i * 0.3 + 0.3, "a", "word") for i in range(500)], CUES)
    made = out(folds.sentences(many, "m"))
    assert all(e - s <= 8 and len(t) <= 84 for s, e, _, t in made) and sum(len(t.split()) for *_, t in made) == 500
    assert out(folds.sentences(many.limit(0), "m")) == []


def test_lengthened(spark):
    rows = [("m", 0.0, 0.2, "a", "x"), ("m", 5.0, 5.1, "a", "y"), ("m", 5.1, 9.0, "a", "z"), ("n", 1.0, 1.0, "a", "p"), ("n", 1.0, 1.1, "a", "q")]
    d = folds.lengthened(spark.createDataFrame(rows, CUES), "m")
    assert out(d.where("m = 'm'")) == [(0.0, 0.5, "a", "x"), (4.6, 5.1, "a", "y"), (5.1, 9.0, "a", "z")]
    assert all(e - s >= 0.5 - 1e-9 for s, e, *_ in out(d))
    crowd = spark.createDataFrame([("m", 0.0, 0.0, "a", str(i)) for i in range(3000)] + [("m", 0.0, 0.1, "a", "end")], CUES)
    assert sum(len(r[3].split()) for r in out(folds.lengthened(crowd, "m"))) == 3001


def test_echoes_and_overlap(spark):
    d = spark.createDataFrame([("m", 0.0, 1.0, "a", "Well, yes"), ("m", 1.2, 2.0, "a", "well yes indeed"), ("m", 1.9, 3.0, "b", "no"), ("m", 3.0, 4.0, "b", "go")], CUES)
    assert out(folds.without_echoes(d, "m")) == [(0.0, 2.0, "a", "well yes indeed"), (1.9, 3.0, "b", "no"), (3.0, 4.0, "b", "go")]
    assert [r[0] for r in out(folds.without_overlap(d, "m"))] == [0.0, 1.2, 3.0]


@pytest.mark.parametrize("text", ["", "a" * 95, "One. Two, three four. " * 20, "word " * 60, "x. " + "y" * 50])
def test_chunks(text):
    made = narration.chunks_of(text, 40, 10)
    assert all(0 < len(c) <= 40 for c in made) and "".join(made).replace(" ", "") == text.replace(" ", "")


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert passages.undamaged("cafÃ©\nplain é") == "café\nplain é" and passages.undamaged("plain é") == "plain é"
    assert passages.normal_form("NFKC")("ﬁ①") == "fi1"
    assert one(narration.paragraphs(F.lit("a\nword\n# Head\n***\n\nlast"))) == ["a word", "Head", "last"]
    assert one(T.repeated_letters(F.lit("aaa III bb ttttt"))) == "a III bb t"
    assert one(T.page_ranges(F.lit("1-3, 7,2"))) == [0, 1, 2, 6]
    assert [one(T.human_size(F.lit(n))) for n in (5, 1536, 5 << 20, 3 << 30)] == ["5 B", "1.5 KB", "5.0 MB", "3.0 GB"]
    assert one(T.file_title(F.lit("My_Book [v2]: x?"))) == "My Book x"


def test_one_edit_apart(spark):
    words = ["form", "from", "farm", "for", "forms", "frame", "abba", "baab", "aab", "baa", "x"]
    d = spark.createDataFrame([(w,) for w in words], "word string")

    def near(a, b):
        edits = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        edits |= {a[:i] + c + a[i + k :] for i in range(len(a) + 1) for c in "abcdefghijklmnopqrstuvwxyz" for k in (0, 1)}
        return a != b and b in edits and min(len(a), len(b)) >= 2

    assert {tuple(r) for r in spelling.one_edit_apart(d, d).collect()} == {p for p in itertools.permutations(words, 2) if near(*p)}


def test_threshold_sweep_and_sections(spark):
    d = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.2), (0, 0.1)], "y int, p double")
    assert tuple(records.threshold_sweep(d, F.col("y"), F.col("p"), 0.97, 4).first()) == (0.8, 1.0, 2 / 3)
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["# A", "x", "```", "# B", "```", "# Notes", "y", "# C"])], "doc_id int, line int, text string")
    assert [r.line for r in markdown.without_sections(rows, ["notes"]).orderBy("line").collect()] == [0, 1, 2, 3, 4, 7]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("m", 0.0, 1.5, "a", "x\ny"), ("m", 61.0, 62.0, None, "z")], CUES)
    assert documents.srt(d, "m").first().body == "1\n00:00:00,000 --> 00:00:01,500\nx\ny\n\n2\n00:01:01,000 --> 00:01:02,000\nz\n"
    assert documents.ass(d, "m").first().body.split("\n")[0] == "Dialogue: 0,0:00:00.00,0:00:01.50,a,,0,0,0,,x\\Ny"
    parts = spark.createDataFrame([("b", 1, 61.0, "One"), ("b", 2, 5.0, 'T"wo')], "k string, n int, s double, t string")
    assert documents.chapters(parts, "k", "n", "s", "t").first().body == '00:00:00 One\n00:01:01 T"wo'
    assert documents.cue_sheet(parts, "k", "n", "s", "t").first().body.endswith("  TRACK 02 AUDIO\n    TITLE \"T'wo\"\n    INDEX 01 01:01:00")
    assert [r.line for r in documents.markdown_table(parts.select("k", "t"), ["t"]).orderBy("nth").collect()][1] == "| b | One |"
    documents.write_bodies(documents.srt(d, "m"), "m", str(tmp_path / "srt"))
    assert (tmp_path / "srt" / "m=m").is_dir()
    documents.write_partitions(parts, str(tmp_path / "p"), "n")
    documents.write_partitions(parts.where("n = 2").withColumn("t", F.lit("new")), str(tmp_path / "p"), "n")
    assert sorted(r.t for r in documents.read_partitions(spark, str(tmp_path / "p")).collect()) == ["One", "new"]


def cues_of(spark, rows):
    return spark.createDataFrame([("m", float(a), float(b), s, t) for a, b, s, t in rows], "k string, start double, end double, speaker string, text string")


def rows_of(d):
    return [(round(r.start, 3), round(r.end, 3), r.text) for r in sorted(d.collect(), key=lambda r: r.start)]


def test_echoes_need_words_and_short_cues_join(spark):
    d = cues_of(spark, [(0, 1, "a", "..."), (1.1, 2, "a", "Hello there"), (2.1, 2.9, "a", "hello THERE!"), (3, 3.05, "a", "Oh"), (3.1, 4, "a", "no"), (4, 4.05, "a", "Hm"), (4.1, 5, "b", "what")])
    assert rows_of(folds.without_echoes(d, "k")) == [(0, 1, "..."), (1.1, 2.9, "Hello there"), (3, 4, "Oh no"), (4, 4.05, "Hm"), (4.1, 5, "what")]


def test_short_cues_of_two_speakers_stay_apart(spark):
    d = cues_of(spark, [(0, 2, "a", "First one"), (2, 2.2, "a", "Eh"), (2.2, 4, "b", "Second one")])
    assert rows_of(folds.lengthened(d, "k")) == [(0, 2.2, "First one Eh"), (2.2, 4, "Second one")]
    d = cues_of(spark, [(0, 2, "a", "First one"), (2, 2.2, "c", "Eh"), (2.2, 4, "b", "Second one")])
    assert rows_of(folds.lengthened(d, "k")) == [(0, 2, "First one"), (2, 2.2, "Eh"), (2.2, 4, "Second one")]


def test_fragments_and_continuations(spark):
    d = cues_of(spark, [(0, 1, "a", "When he came,"), (1.5, 2, "a", "it rained."), (2.1, 2.3, "a", "Oh"), (2.5, 3, "b", "yes"), (3.1, 3.3, "b", "No")])
    assert rows_of(folds.fragments(d, "k")) == [(0, 2.3, "When he came, it rained. Oh"), (2.5, 3.3, "yes No")]
    d = cues_of(spark, [(0, 1, "a", "So we"), (1.5, 2, "a", "went home."), (2.1, 3, "a", "Then"), (2.9, 4, "b", "what?"), (40, 41, "b", "late")])
    assert rows_of(folds.continued(d, "k")) == [(0, 2, "So we went home."), (2.1, 4, "Then what?"), (40, 41, "late")]


def test_split_and_wrap(spark):
    text = "One short sentence. " + "another word " * 8
    d = cues_of(spark, [(0, 10, "a", text), (20, 50, "a", "long")])
    got = rows_of(folds.split(d, "k", 60, 12.0, lambda c: [3.1]))
    assert " ".join(t for _, _, t in got[:-3]).replace("  ", " ") == text.strip() and all(len(t) <= 60 for _, _, t in got)
    assert got[0][0] == 0 and all(a[1] == b[0] for a, b in zip(got[:-3], got[1:-3])) and all(b - a <= 12 + 1e-9 for a, b, _ in got)
    assert "".join(t for _, _, t in got[-3:]) == "long" and got[-1][1] == 50
    assert folds.boundaries(0, 10, 2, [4.6, 9], 12) == [0, 4.6, 10]
    assert folds.wrapped("a b", 42) == "a b" and folds.wrapped("aaaa bbbb cccc", 9) == "aaaa bbbb\ncccc" and folds.wrapped("aa bb cc dd", 2) == "aa bb cc dd"
    assert folds.pieces("short, ") == ["short."]


def test_rebalanced(spark):
    d = cues_of(spark, [(0, 3, "a", "x"), (3, 3.4, "a", "y" * 20), (3.4, 5, "a", "z"), (9, 9.1, "a", "q" * 20)])
    got = rows_of(folds.rebalanced(d, "k"))
    assert got == [(0, 2.4, "x"), (2.4, 3.4, "y" * 20), (3.4, 5, "z"), (9, 9.1, "q" * 20)]
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_whole_ass_files(spark):
    d = cues_of(spark, [(0, 1.5, "b", "one\ntwo"), (2, 3, "a", "x"), (4, 5, None, "y")])
    body = documents.ass_document(d, "k").first().body
    assert body.startswith("[Script Info]\n") and body.endswith("\n")
    assert [x.split(",")[0] for x in body.splitlines() if x.startswith("Style:")] == ["Style: Default", "Style: a", "Style: b"]
    assert [x for x in body.splitlines() if x.startswith("Dialogue:")][0] == "Dialogue: 0,0:00:00.00,0:00:01.50,b,,0,0,0,,one\\Ntwo"
