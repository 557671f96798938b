"""Converter prose, vocabulary and matching against worked examples and brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatile.functions import cleanup, headings, lines, numbers
from verbatile.operators import matching, vocabulary


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_cleanup(spark):
    get = lambda f, *x: one(spark, f(*map(F.lit, x)))
    assert get(lines.without_emphasis, "**a b** and __c__, *d* snake_case_name 2*3*4") == "a b and c, d snake_case_name 2*3*4"
    assert get(cleanup.without_footnotes, "a[^1] b\n[^1]: foot\n    more\nc") == "a b\nc"
    assert [get(cleanup.digit_letters, x) for x in ("w0rd", "5ome", "4ab", "AB0C", "a1", "1s", "w00d", "he said 8ig")] == ["word", "some", "4ab", "AB0C", "a1", "1s", "w00d", "he said big"]
    assert [get(headings.is_false_heading, x) for x in ("", "Chapter 1", "“Quoted", "lower", "Oh No!", "12:30", "The End", "3. One,", "Act 2 The Dawn,", "Preface,", "Glossary - terms,")] == [True, False, True, True, True, True, False, True, False, True, False]
    assert get(cleanup.speech_issues, "R&D <draft>") == ["XML_BRACKETS", "RAW_AMPERSAND"] and get(cleanup.speech_issues, "a &amp; “b") == ["UNBALANCED_CURLY_QUOTES"]
    assert get(cleanup.mojibake_score, "Ã© �") == 3 and get(lines.is_capitals, "THE END") and not get(lines.is_capitals, "The END")
    assert one(spark, cleanup.speaks(F.array(F.lit("en-GB")), F.lit("en"))) and not one(spark, cleanup.speaks(F.array(F.lit("en-GB")), F.lit("fr")))
    assert one(spark, cleanup.digit_letters(F.lit(None).cast("string"))) is None


def test_numbers(spark):
    chain = lambda x: one(spark, numbers.tempo_chain(F.lit(x)))
    assert (chain(1.5), chain(2.0), chain(5.0), chain(0.2)) == ([1.5], [2.0], [2.0, 2.0, 1.25], [0.5, 0.5, 0.8])
    assert numbers.zero_error_sample(0.95, 0.95) == 59
    box = lambda *x: [F.lit(float(v)) for v in x]
    assert one(spark, numbers.box_iou(box(0, 0, 2, 2), box(1, 0, 3, 2))) == 2 / 6 and one(spark, numbers.box_iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0


def test_least_cost():
    rng = np.random.default_rng(5)
    for n, m in [(1, 1), (2, 2), (3, 5), (4, 4), (5, 6)] * 6:
        cost = rng.integers(0, 9, (n, m)).astype(float)
        found = matching.least_cost(cost)
        assert len(set(found)) == n
        assert sum(cost[i, j] for i, j in enumerate(found)) == min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))


def test_assign(spark):
    d = spark.createDataFrame([("g", "a", 1, 1.0), ("g", "a", 2, 2.0), ("g", "b", 1, 1.0), ("g", "b", 2, 9.0), ("h", "a", 1, 3.0), ("h", "b", 1, 2.0)], "k string, s string, v int, c double")
    assert sorted(map(tuple, matching.assign(d, "k", "s", "v", "c").collect())) == [("g", "a", 2, 2.0), ("g", "b", 1, 1.0), ("h", "b", 1, 2.0)]
    assert matching.assign(d.limit(0), "k", "s", "v", "c").collect() == []


def test_edits_apart(spark):
    assert [matching.edits(a, b) for a, b in (("ab", "ba"), ("ca", "abc"), ("", "ab"), ("kitten", "sitting"))] == [1, 3, 2, 3]
    random.seed(3)
    words = sorted({"".join(random.choices("abc", k=random.randint(1, 6))) for _ in range(70)})
    d = spark.createDataFrame([(w,) for w in words] + [(None,)], "word string")
    got = sorted(map(tuple, matching.edits_apart(d, d).collect()))
    assert got == sorted((a, b, matching.edits(a, b)) for a in words for b in words if a != b and matching.edits(a, b) <= 2)


def test_nearest(spark):
    cues = spark.createDataFrame([("k", 1, 10.0, 12.0), ("k", 2, 0.0, 1.0), ("x", 3, 0.0, 1.0)], "k string, c bigint, start double, end double")
    turns = spark.createDataFrame([("k", 7, 5.0, 9.0), ("k", 8, 13.0, 20.0), ("k", 9, 2.0, 10.5)], "k string, t bigint, start double, end double")
    assert sorted(map(tuple, matching.nearest(cues, turns, "k", "c", "t").collect())) == [(1, 9, 0.5), (2, 9, 1.5), (3, None, None)]


def test_vocabulary(spark):
    d = spark.createDataFrame([(1, "to run the race"), (2, None), (3, "")], "doc_id int, text string")
    got = {r.word: (r["class"], r.confidence) for r in vocabulary.word_classes(vocabulary.contexts(d)).collect()}
    assert got == {"to": ("unknown", 0.0), "run": ("verb", 0.95), "the": ("unknown", 0.0), "race": ("noun", 0.75)}
    n = spark.createDataFrame([("Ann", 3), ("Ann Lee", 2), ("Ann Lee Poe", 2), ("Lee", 4), ("Poe", 2), ("Zed", 2)], "name string, n int")
    assert sorted((r.name, r.canonical) for r in vocabulary.aliases(n).collect()) == [("Ann", "Ann Lee Poe"), ("Ann Lee", "Ann Lee Poe"), ("Ann Lee Poe", "Ann Lee Poe"), ("Zed", "Zed")]


def test_spread_pick(spark):
    d = spark.range(30).select(F.lit("a").alias("k"), "id")
    assert sorted(r.id for r in vocabulary.spread_pick(d, "k", "id", 3, 2).collect()) == [0, 9, 10, 19, 20, 29]
    assert sorted(r.id for r in vocabulary.spread_pick(d, "k", "id", 3, 1).collect()) == [4, 14, 24]


def test_repaired(spark):
    d = spark.createDataFrame([("m", 0.0, 0.1, "a", "hey"), ("m", 0.2, 2.0, "a", "hey you"), ("m", 1.5, 3.0, "b", "no"), ("m", 4.0, 4.1, "b", "ok")], "k string, start double, end double, speaker string, text string")
    got = sorted((r.start, r.end, r.text) for r in matching.repaired(d, "k").collect())
    assert got == [(0.0, 2.0, "hey you"), (4.0, 4.5, "ok")]


@pytest.mark.parametrize("most", [1, 2])
def test_edits_apart_of_short_and_long_words(spark, most):
    r = random.Random(most)

    def changed(w, n):
        for _ in range(n):
            k, how = r.randrange(len(w) + 1), r.randrange(4)
            w = w[:k] + r.choice("abc") + w[k + (how == 1) :] if how < 2 else w[:k] + w[k + 1 :] if how == 2 else w[: max(0, k - 1)] + w[max(0, k - 1) : k + 1][::-1] + w[k + 1 :]
        return w

    base = ["".join(r.choice("abc") for _ in range(n)) for n in (1, 2, 3, 5, 8, 30, 31, 32, 33, 34, 40, 90)]
    words = sorted({w for b in base for n in range(4) for w in [changed(b, n) for _ in range(6)] if w})
    d = spark.createDataFrame([(w,) for w in words] + [(None,), ("",), (words[0],), ("x" * 20_000,)], "word string")
    got = {(x.a, x.b): x.distance for x in matching.edits_apart(d, d, most).collect()}
    assert got == {(a, b): n for a in words for b in words if a != b and abs(len(a) - len(b)) <= most and (n := matching.edits(a, b)) <= most}


def test_intervals_of_any_length_meet(spark):
    from verbatile.operators import intervals

    r = random.Random(5)
    make = lambda n: [("k", i, a, a + r.choice([0, 1, 30, 5_000, 10**6, 10**9])) for i in range(n) for a in [r.choice([0, -5, 10**6]) + r.random() * 100]]
    left, right = make(60), make(60)
    frame = lambda rows, name: spark.createDataFrame([(k, i, float(a), float(b)) for k, i, a, b in rows] + [("k", 999, 5.0, 1.0)], f"k string, {name} bigint, start double, end double")
    got = {(x.lid, x.rid) for x in intervals.overlaps(frame(left, "lid"), frame(right, "rid"), "k", 1.0).collect()}
    assert got == {(i, j) for _, i, a, b in left for _, j, c, d in right if min(b, d) - max(a, c) > 0}
    points = spark.createDataFrame([("k", i, float(a)) for _, i, a, _ in left], "k string, lid bigint, at double")
    held = {x.lid for x in intervals.containing(points, frame(right, "rid"), "k", 1.0).collect()}
    assert held == {i for _, i, a, _ in left if any(c <= a <= d for _, _, c, d in right)}
