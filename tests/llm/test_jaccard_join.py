"""Operator 7 against brute force, and the signature tree on its own."""

import random
import re

import numpy as np
import pytest

from verbatile.llm import jaccard_join, repeats, signature_trees

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=120):
    r = random.Random(seed)
    passage = [f"c{k}" for k in range(40)]
    bases = [[f"w{r.randrange(300)}" for _ in range(r.choice([4, 6, 30, 80, 200]))] for _ in range(12)]
    rows = []
    for i in range(n):
        t = list(r.choice(bases)) if i % 4 else [f"w{r.randrange(300)}" for _ in range(r.randrange(0, 90))]
        for _ in range(r.randrange(0, 4)):
            if t:
                t[r.randrange(len(t))] = f"e{r.randrange(1000)}"
        if i % 5 == 0:
            t += passage
        rows.append((1000 - i, " ".join(w.upper() if i % 9 == 0 else w for w in t)))
    return rows + [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A\tb"), (6, " ".join(f"x{k}" for k in range(30_000)))]


@pytest.mark.parametrize("seed,group", [(1, 5_000), (2, 8)])
def test_against_brute_force(make_docs, seed, group):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(make_docs(rows).repartition(3), group=group).collect()}
    assert got == brute(rows)


def test_repeated_rows_nulls_and_empty_tables(make_docs):
    t = "one two three four five six seven"
    rows = jaccard_join.jaccard_components(make_docs([(3, t), (3, t), (2, t.upper()), (9, "other words here"), (None, "z")])).collect()
    assert sorted(((r.doc_id or -1), r.n_shingles, r.component_id or -1) for r in rows) == [(-1, 1, -1), (2, 3, 2), (3, 3, 2), (3, 3, 2), (9, 1, 9)]
    assert jaccard_join.jaccard_components(make_docs([])).collect() == []


@pytest.mark.parametrize("two_sides", [False, True])
def test_signature_tree(two_sides):
    r = np.random.default_rng(3)
    bases = [r.integers(0, 2**63, size=n, dtype=np.uint64) for n in (3, 20, 20, 300, 900)]
    sets = []
    for _ in range(250):
        b = bases[r.integers(len(bases))]
        s = b[r.random(len(b)) > 0.07]
        sets.append(np.unique(np.concatenate([s, r.integers(0, 2**63, size=int(0.06 * len(b)) + 1, dtype=np.uint64)])))
    other = r.random(len(sets)) < 0.5 if two_sides else None

    def groups(links):
        root = list(range(len(sets)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in links:
            root[find(i)] = find(j)
        return {frozenset(k for k in range(len(sets)) if find(k) == x) for x in {find(k) for k in range(len(sets))}}

    want = [
        (i, j) for i in range(len(sets)) for j in range(i) if (other is None or other[i] != other[j])
        and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
    ]
    got = signature_trees.join(sets, np.arange(len(sets)), 80, other)
    assert groups(got) == groups(want) and len(got) < len(sets)


@pytest.mark.parametrize("rounds", [0, 1])
def test_joined_by_shingle(make_docs, monkeypatch, rounds):
    """What the rounds leave is joined shingle by shingle, in pairs of blocks where a shingle has many classes."""
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    rows = corpus(3, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(make_docs(rows), group=4).collect()}
    assert got == brute(rows)


def test_tables_are_summed_in_a_tree(spark, monkeypatch):
    r = np.random.default_rng(1)
    values = [r.integers(0, 60_000, 5_000).astype(np.uint64) for _ in range(9)]
    told = [(c, d) for v in values for c, d in repeats.task_parts(v)]
    parts = spark.createDataFrame(told, "chunk int, data binary").repartition(5)
    once = repeats.table(parts)
    monkeypatch.setattr(repeats, "STREAM_BYTES", 512)
    monkeypatch.setattr(repeats, "STREAM_FAN", 4)
    assert (repeats.table(parts) == once).all()
    every, n = np.unique(np.concatenate(values), return_counts=True)
    assert (repeats.maybe_repeated(once, every) == (n > 1)).all()


def test_full_table_costs_no_sets(make_docs, monkeypatch):
    """A table that tells of every shingle that it may be repeated, as when the corpus is far too large for it: sets are written of the classes
    that share a prefix shingle with another, not of all, and no more than a fifth of the others."""
    r = random.Random(5)
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(100))) for i in range(60)]
    rows += [(100 + i, t + " more") for i, t in rows[:7]] + [(200, rows[3][1])]
    written, staged = {}, jaccard_join.staged

    def told(df, name):
        out = staged(df, name)
        written[name] = (df.columns, out.count())
        return out

    monkeypatch.setattr(jaccard_join, "staged", told)
    monkeypatch.setattr(repeats, "table", lambda parts, bits: np.full(1 << 18, 255, dtype=np.uint8))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(make_docs(rows)).collect()}
    assert got == brute(rows)
    assert [n for columns, n in written.values() if "set" in columns] == [14]


def test_passages_in_common_cost_no_sets(make_docs, monkeypatch):
    """Texts that share passages with the next one, so that ties alone would make one component of all: with a full table, sets are still
    written of near copies only."""
    r = random.Random(6)
    word = lambda: f"w{r.randrange(10**6)}"
    passages = [[word() for _ in range(20)] for _ in range(61)]
    rows = [(i, " ".join(passages[i] + [word() for _ in range(80)] + passages[i + 1])) for i in range(60)]
    rows += [(100 + i, t + " more") for i, t in rows[:7]]
    written, staged = {}, jaccard_join.staged

    def told(df, name):
        out = staged(df, name)
        written[name] = (df.columns, out.count())
        return out

    monkeypatch.setattr(jaccard_join, "staged", told)
    monkeypatch.setattr(repeats, "table", lambda parts, bits: np.full(1 << 18, 255, dtype=np.uint8))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(make_docs(rows)).collect()}
    assert got == brute(rows)
    assert [n for columns, n in written.values() if "set" in columns] == [14]


def test_stars_of_long_lists(make_docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIST", 2)
    rows = corpus(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(make_docs(rows)).collect()}
    assert got == brute(rows)


def test_sketches_never_part_similar_sets():
    r = np.random.default_rng(8)
    kept = parted = 0
    for _ in range(3_000):
        n = int(r.choice([1, 3, 31, 32, 63, 64, 65, 500, 1024, 3000]))
        a = np.unique(r.integers(0, 2**63, size=n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) > r.choice([0.02, 0.1, 0.5, 1])], r.integers(0, 2**63, size=int(0.1 * n) + 1, dtype=np.uint64)]))
        may = jaccard_join.may_be_similar((len(a), jaccard_join.sketch(a)), (len(b), jaccard_join.sketch(b)), 80)
        similar = signature_trees.enough(len(a), len(b), len(np.intersect1d(a, b)), 80)
        assert may or not similar
        kept, parted = kept + similar, parted + (not may)
    assert kept > 300 and parted > 300


def test_packed_keys():
    r = np.random.default_rng(9)
    for n in (1, 2, 5_000):
        keys, place = np.sort(r.integers(0, 1 << jaccard_join.KEY_BITS, n)), r.integers(0, 1 << 16, n)
        got = jaccard_join._unpacked(jaccard_join._packed(keys, place))
        assert (got[0] == keys).all() and (got[1] == place).all()


def test_pipeline_stage_writes_sets_of_near_copies_only(spark, make_docs, monkeypatch):
    import corpus_pipeline

    r = random.Random(7)
    word = lambda: f"w{r.randrange(10**6)}"
    passages = [[word() for _ in range(20)] for _ in range(31)]
    rows = [(i, " ".join(passages[i] + [word() for _ in range(80)] + passages[i + 1])) for i in range(30)]
    rows += [(100 + i, t + " more") for i, t in rows[:4]]
    written, staged = {}, jaccard_join.staged

    def told(df, name):
        out = staged(df, name)
        written[name] = (df.columns, out.count())
        return out

    monkeypatch.setattr(jaccard_join, "staged", told)
    monkeypatch.setattr(repeats, "table", lambda parts, bits: np.full(1 << 18, 255, dtype=np.uint8))
    kept = corpus_pipeline.near_duplicates(spark, make_docs(rows), "").collect()
    assert sorted(x.doc_id for x in kept) == list(range(30))
    assert [n for columns, n in written.values() if "set" in columns] == [8]
