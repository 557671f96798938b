"""Operator 5 against brute force."""

import hashlib
import random
import re

import pytest

from verbatile.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    """{id: (n_words, n_removed, sha)}"""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for s in range(len(words) - k + 1):
            w = tuple(words[s : s + k])
            if w in seen:
                gone[s : s + k] = [True] * k
            seen.add(w)
        left = " ".join(w for w, g in zip(words, gone) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    passage = " ".join(f"p{r.randrange(9)}" for _ in range(70))
    rows = []
    for i in range(n):
        t = [f"w{r.randrange(60)}é" for _ in range(r.randrange(0, 150))]
        if i % 3 == 0:
            t[len(t) // 2 : len(t) // 2] = passage.split()[r.randrange(20) :]
        if i % 7 == 0:
            t += ["a"] * 50
        if i % 11 == 0:
            t += ["x", "y", "z"] * 20
        rows.append((i * 2, "\t ".join(t) + "\n"))
    rows += [(501, None), (502, ""), (503, rows[3][1]), (504, " ".join(["long", "text"] * 30_000)), (505, "one")]
    return rows


@pytest.mark.parametrize("seed,hot", [(1, sd.HOT), (2, 3), (3, 8)])
def test_against_brute_force(make_docs, seed, hot):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sd.remove_repeats(make_docs(rows), hot=hot).collect()}
    assert got == brute(rows, sd.WINDOW)


def test_many_partitions_and_short_windows(make_docs):
    rows = corpus(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sd.remove_repeats(make_docs(rows).repartition(9), window=6, mini=2, hot=5).collect()}
    assert got == brute(rows, 6)


def test_repeated_rows_nulls_and_empty_tables(make_docs):
    text = " ".join(f"w{i}" for i in range(30))
    rows = sd.remove_repeats(make_docs([(1, text), (1, text), (2, text), (None, "a b")]), with_text=True).collect()
    assert sorted(((r.doc_id or -1), r.n_removed, r.kept_text) for r in rows) == [(-1, 0, "a b"), (1, 0, text), (1, 0, text), (2, 30, "")]
    assert sd.remove_repeats(make_docs([])).collect() == []


def test_copies_of_one_text_are_spread(make_docs):
    """Exact copies share all their minimisers, and are still dealt over the salts; rows equal in id and text are sent once."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, text) for i in range(300)] + [(1000 + i, f"a{i} " + text) for i in range(9)]
    docs = sd._texts(make_docs(rows).coalesce(2), "doc_id", "text")
    bits, salts = sd.survey(docs, sd.WINDOW, sd.MINI, 20)
    dealt = sd.super_kmers(docs, bits, salts, sd.WINDOW, sd.MINI).where("salted").groupBy("minimiser", "salt").count().collect()
    assert salts and max(r["count"] for r in dealt) <= 60
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sd.remove_repeats(make_docs(rows), hot=20).collect()}
    assert got == brute(rows, sd.WINDOW)
    same = make_docs([(None, text)] * 300 + [(5, text)]).coalesce(2)
    told = sd._texts(same, "doc_id", "text")
    assert sd.super_kmers(told, bits, salts, sd.WINDOW, sd.MINI).where("salted AND doc_id IS NULL").groupBy("minimiser").count().agg({"count": "max"}).first()[0] <= 2
    assert sorted((r.doc_id or -1, r.n_removed) for r in sd.remove_repeats(same, hot=20).collect()) == [(-1, 0)] * 300 + [(5, 40)]
