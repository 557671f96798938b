"""Operators 2, 4, 6 and 10 against brute force, with edge cases."""

import base64
import hashlib
import random
import re

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from verbatile.llm import bpe, exact_dedup, mixing, winnow

LONG = " ".join(f"word{i} and" for i in range(20_000))
TEXTS = ["", None, " \t\n", "Ab c", "aB C", "Ab c", "ÄB c", "äb c", "one", "a " * 300, "x" * 5_000, LONG, LONG, "日本語 テキスト", "don't  stop\n\n now 123 !!", "<|endoftext|>"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(make_docs):
    return make_docs([(i * 3, t, "en", None if i % 5 == 4 else f"s{i % 4}") for i, t in enumerate(TEXTS)])


def lowered(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def check_dedup(docs, **more):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, **more).collect()}
    groups = {}
    for i, t in enumerate(TEXTS):
        groups.setdefault(lowered(t), []).append(i * 3)
    assert len(got) == len(TEXTS)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
            assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup(docs):
    check_dedup(docs)


def test_exact_dedup_checks_bytes_when_digests_clash(docs):
    check_dedup(docs, digest=lambda text: F.substring(F.md5(text), 1, 1))


def test_exact_dedup_repeated_and_null_ids(make_docs):
    rows = exact_dedup.exact_dedup(make_docs([(1, "a"), (1, "A"), (None, "a"), (2, "b")])).collect()
    assert sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in rows) == [(-1, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (2, 2, 1, True)]


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda text: F.substring(F.md5(text), 1, 0)])
def test_exact_dedup_ids_repeat_with_other_texts(make_docs, digest):
    """One row per document, whether digests clash (an empty digest always does) or not."""
    given = [(1, "a"), (1, "b"), (1, "d"), (2, "A"), (None, "c"), (None, "c"), (None, "b"), (3, "ee")]
    rows = exact_dedup.exact_dedup(make_docs(given), digest=digest).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(1, 2, 2, False, sha("a")), (1, 1, 2, True, sha("b")), (1, 1, 1, True, sha("d")), (2, 2, 2, True, sha("a")), (None, None, 2, True, sha("c")), (None, None, 2, True, sha("c")), (None, 1, 2, False, sha("b")), (3, 3, 1, True, sha("ee"))]
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, want))


def test_dedup_state_goes_on(spark, make_docs, tmp_path):
    """A second run of the stream finds in its state what the first one told it."""
    arrived, state = str(tmp_path / "in"), str(tmp_path / "state")
    exact_dedup.arrivals(make_docs([(1, "a"), (2, "b")])).write.parquet(arrived)
    exact_dedup.update_state(spark, arrived, state)
    exact_dedup.arrivals(make_docs([(3, "A"), (4, "c")])).write.mode("append").parquet(arrived)
    groups = exact_dedup.update_state(spark, arrived, state)
    assert sorted((r.keep_id, r.group_size) for r in groups.collect()) == [(2, 1), (3, 2), (4, 1)]


def test_dedup_state_is_hit_by_later_triggers(spark, make_docs, tmp_path):
    """One file a trigger: groups grow over triggers, and the locator is that of the row with the largest id."""
    arrived, state = str(tmp_path / "in"), str(tmp_path / "state")
    docs = exact_dedup.file_backed(make_docs([(i, f"t{i % 3}") for i in range(12)]).repartition(6, "doc_id"))
    exact_dedup.arrivals(docs).write.parquet(arrived)
    groups = exact_dedup.update_state(spark, arrived, state, trigger_bytes=1).collect()
    assert sorted((r.keep_id, r.group_size) for r in groups) == [(9, 4), (10, 4), (11, 4)]
    assert len(list((tmp_path / "state" / "groups").glob("batch=*"))) > 1
    where = {(r[exact_dedup.P + "file"], r[exact_dedup.P + "row"]): r.doc_id for r in exact_dedup.located(docs).collect()}
    assert {where[r.file, r.row] for r in groups} == {9, 10, 11}


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda text: F.substring(F.md5(text), 1, 0)])
def test_kept_documents(make_docs, digest):
    given = [(1, "a"), (1, "b"), (1, "d"), (2, "A"), (None, "c"), (None, "c"), (None, "b"), (3, "ee"), (3, "EE"), (4, None), (5, "")]
    docs = make_docs(given)
    got = exact_dedup.kept_documents(docs, digest=digest)
    assert got.columns == docs.columns
    rows = sorted((r.doc_id or 0, (r.text or "").lower()) for r in got.collect())
    assert rows == [(0, "c"), (1, "b"), (1, "d"), (2, "a"), (3, "ee"), (5, "")]


def test_names_that_functions_use_are_there():
    """A helper that moves to another module is imported where it was: exact_dedup, and with it the pipeline, once ran into a NameError."""
    import builtins
    import dis
    import importlib
    import pkgutil
    import types

    import verbatile.llm

    def used(code):
        names = {i.argval for i in dis.get_instructions(code) if i.opname == "LOAD_GLOBAL"}
        return names.union(*[used(c) for c in code.co_consts if isinstance(c, types.CodeType)])

    lacking = []
    for name in ["corpus_pipeline", *[f"verbatile.llm.{m.name}" for m in pkgutil.iter_modules(verbatile.llm.__path__)]]:
        module = importlib.import_module(name)
        with open(module.__file__, encoding="utf-8") as f:
            code = compile(f.read(), name, "exec")
        lacking += [(name, n) for n in sorted(used(code)) if not hasattr(module, n) and not hasattr(builtins, n)]
    assert lacking == []


def test_hit_filter_and_many_copies(make_docs, monkeypatch):
    """Rows that surely aren't hits are left out, hits never; groups join alike broadcast or not."""
    docs = make_docs([(i, f"t{i}" if i % 4 else "same") for i in range(2000)] + [(5000 + i, f"t{i}") for i in range(1, 40)])
    for many in (1, 10_000):
        monkeypatch.setattr(exact_dedup, "MANY", many)
        _, groups, total = exact_dedup.groups_of(docs, "doc_id", "text", exact_dedup.sha256_hex)
        left = exact_dedup.maybe_hit(exact_dedup._texts(docs, "doc_id", "text", exact_dedup.sha256_hex), groups).count()
        hits = sum(r.group_size for r in groups.where("group_size > 1").collect())
        assert hits <= left < hits + 400
        rows = exact_dedup.exact_dedup(docs).collect()
        assert len(rows) == total and sum(r.kept for r in rows) == groups.count()
        assert {r.group_size for r in rows if r.doc_id % 4 == 0 and r.doc_id < 2000} == {500}


def brute_winnow(text, hash_of, k=winnow.K, w=winnow.W):
    words = re.findall(winnow.PIECE, text)
    h = [hash_of[x] for x in words]
    if 0 < len(h) < k:
        h += [0] * (k - len(h))
    grams = []
    for i in range(len(h) - k + 1):
        g = 0
        for x in h[i : i + k]:
            g = (g * winnow.BASE + x) % winnow.MOD
        grams.append(g)
    chosen = []
    for i in range(max(min(len(grams), 1), len(grams) - w + 1)):
        window = grams[i : i + w]
        at = i + max(j for j, g in enumerate(window) if g == min(window))
        if not chosen or chosen[-1][1] != at:
            chosen.append((grams[at], at))
    return chosen


def jaccard(a, b):
    a, b = {x for x, _ in a}, {x for x, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("bucket_rows", [3, 1000])
def test_winnowing(spark, docs, bucket_rows, monkeypatch):
    monkeypatch.setattr(winnow.neighbour_buckets, "__defaults__", (bucket_rows,))
    monkeypatch.setattr(winnow.with_next, "__defaults__", ("doc_id", bucket_rows, winnow.with_next.__defaults__[2]))
    got = {r.doc_id: r for r in winnow.winnow_documents(docs).collect()}
    rows = sorted([(i * 3, t or "") for i, t in enumerate(TEXTS)], reverse=True)
    edits = {}
    for at, (i, t) in enumerate(rows):
        n, after = len(t) // 3, rows[(at + 1) % len(rows)][1]
        edits[i] = (t, t[: len(t) - n] + after[:n], after)
    words = sorted({w for x in edits.values() for t in x for w in re.findall(winnow.PIECE, t)})
    hashed = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").bitwiseAND(F.lit(winnow.MOD)).alias("h"))
    hash_of = dict(hashed.collect())
    assert len(got) == len(rows)
    for i, (t, edited, after) in edits.items():
        f, e, x = (brute_winnow(s, hash_of) for s in (t, edited, after))
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == " ".join(f"{h:X}@{p}" for h, p in f)
        assert got[i].edited_fingerprint == " ".join(f"{h:X}@{p}" for h, p in e)
        assert got[i].near_edited == pytest.approx(jaccard(f, e)) and got[i].near_next == pytest.approx(jaccard(f, x))


def test_winnowing_one_and_repeated_rows(make_docs):
    (r,) = winnow.winnow_documents(make_docs([(7, "a b c d e f")])).collect()
    assert r.near_next == 1.0
    rows = winnow.winnow_documents(make_docs([(7, "a b c d e f"), (7, "a b c d e f"), (None, "z")])).collect()
    assert sorted(r.n_chars for r in rows) == [1, 11, 11]


def test_mixing(docs, make_docs):
    rows = mixing.mix_documents(docs).collect()
    assert rows and sorted(rows) == sorted(mixing.mix_documents(docs).collect())
    size = {i * 3: len(WORD.findall(t or "")) for i, t in enumerate(TEXTS)}
    source = {i * 3: None if i % 5 == 4 else f"s{i % 4}" for i in range(len(TEXTS))}
    total, taken = {}, {}
    for r in rows:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r.size
        s = source[r.doc_id]
        total[s] = total.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
    # Water-filling by rounds.
    names = sorted([s for s in total if s is not None]) + [None] * (None in total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, left, open_ = {}, sum(total.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * total[s]}
        if not over:
            goal |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            goal[s] = 3 * total[s]
            left -= goal[s]
        open_ -= over
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == total[s] and r.target == pytest.approx(goal[s])
    assert sum(taken.values()) == sum(total.values())  # the budget, to the word
    largest = {s: max(r.size for r in rows if source[r.doc_id] == s) for s in names}
    for s in names:  # what is being served when the budget ends is all that is lacking
        assert taken[s] >= goal[s] - largest[s]


def fair_queue(rows, budget, most=3):
    """A plain sequential queue: rows of (key, source, size, target) in shuffled order; the source whose document ends first is
    served next. Words taken of each key."""
    of, taken = {}, {r[0]: 0 for r in rows}
    for r in rows:
        of.setdefault(r[1], []).append(r)
    target = {r[1]: r[3] for r in rows}
    place, served, done = dict.fromkeys(of, 0), dict.fromkeys(of, 0), 0
    while done < budget:
        ahead = []
        for s, own in of.items():
            while place[s] < most * len(own) and own[place[s] % len(own)][2] == 0:
                place[s] += 1
            if place[s] < most * len(own):
                ahead.append(((served[s] + own[place[s] % len(own)][2]) / target[s], (s is None, s or ""), s))
        _, _, s = min(ahead)
        key, _, size, _ = of[s][place[s] % len(of[s])]
        words = min(size, budget - done)
        taken[key] += words
        served[s], place[s], done = served[s] + size, place[s] + 1, done + words
    return taken


@pytest.mark.parametrize("seed", range(4))
def test_mix_is_that_of_a_sequential_queue(make_docs, seed):
    r = random.Random(seed)
    source = lambda: r.choice(["a", "a", "a", "b", "c", "d", None])
    given = [(r.choice([i, i, 7, None]), None if r.random() < 0.1 else "w " * r.choice([0, 1, 3, 10, 200]) + f"x{i}", "en", source()) for i in range(60)]
    rows = mixing.told(make_docs(given))
    plan = mixing.schedule(rows, slots=r.choice([1, 4, 1 << 16])).collect()
    where = {x.row: x for x in plan}
    assert len(where) == len(given) == rows.count()
    told = sorted(rows.collect(), key=lambda x: (x.shuffled, x.doc_id is not None, x.doc_id or 0, x.size, x.text_hash, x.row))
    want = fair_queue([(x.row, x.source, x.size, where[x.row].target) for x in told], sum(x.size for x in told))
    got = dict.fromkeys(where, 0)
    for x in plan:
        got[x.row] += x.words
    assert got == want


def test_mixed_order_and_documents(docs, make_docs):
    plan = mixing.schedule(mixing.told(docs))
    order = mixing.mixed_order(plan).collect()
    finish = [r.finish for r in order]
    assert finish == sorted(finish) and all(r.words == r.size for r in order[:-1])
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == len(order)
    # Documents without words, null and repeated ids.
    odd = make_docs([(None, "a b"), (None, "c"), (3, None), (3, "d e f"), (4, " "), (4, "g")])
    assert sorted(r.text for r in mixing.mixed_documents(odd).collect()) == ["a b", "c", "d e f", "g"]
    assert mixing.mixed_documents(make_docs([(1, None), (2, "")])).collect() == []


def test_bpe_matches_the_library(docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encode_documents(docs, path, public_tokenizers.PATTERN, with_ids=True).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids, r = own.encode_ordinary(t or ""), got[i * 3]
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == (t or "")
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_bpe_merges_short_words_in_lockstep(monkeypatch, seed):
    """Words of all sizes, and ranks in any order (a merge may bring up a lower rank), as the library has them; only long words go one by one."""
    draw = random.Random(seed or 0)
    if seed is None:
        tokens, letters = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), "abcdefghinorstuéß日 "
    else:
        longer = {"".join(draw.choices("abc", k=draw.randint(2, 6))).encode() for _ in range(400)}
        tokens, letters = [*map(bytes, zip(range(256))), *sorted(longer)], "abc"
        draw.shuffle(tokens)
    words = sorted({"".join(draw.choices(letters, k=n)) for n in range(1, 75) for _ in range(40)} | {c * n for c in letters[:3] for n in range(1, 70)})
    own = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    codec, single, one_by_one = bpe.Codec(tuple(tokens), r"(?s).+"), bpe.Codec.merge, []
    monkeypatch.setattr(bpe.Codec, "merge", lambda self, word: one_by_one.append(len(word)) or single(self, word))
    for word, got in zip(words, codec.encode(words), strict=True):
        want = own.encode_ordinary(word)
        assert [int.from_bytes(got[i : i + 2], "little") for i in range(0, len(got), 2)] == want and codec.decode(want) == word.encode()
    assert min(one_by_one) > 32


def test_perfect_hash_is_minimal_and_perfect():
    import numpy as np

    keys = np.arange(1, 5001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    perfect = bpe.PerfectHash(keys)
    assert sorted(perfect(keys).tolist()) == list(range(5000)) and perfect.size == 5000


def test_empty_tables(make_docs):
    none = make_docs([])
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for got in (exact_dedup.exact_dedup(none), winnow.winnow_documents(none), mixing.mix_documents(none), mixing.mixed_documents(none), bpe.encode_documents(none, path, public_tokenizers.PATTERN)):
        assert got.collect() == []


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op6_weighted_fair_mix"])
def test_against_sql(spark, sf_dir, name):
    from verbatile.llm.oracles import oracle_sql
    from verbatile.llm.queries import queries

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = c.execute(oracle_sql()[name])
    columns = [x[0] for x in want.description]
    assert sorted(tuple(r[c] for c in columns) for r in queries()[name](spark, sf_dir).collect()) == sorted(want.fetchall())
