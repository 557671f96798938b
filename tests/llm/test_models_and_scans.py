"""Operators 1, 3, 8 and 9, and the pipeline."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from verbatile.llm import bpe, licenses, lid_crf, mixing, separators, toxicity_kn
from verbatile.llm.queries import fold, queries

BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
EOD = 50256


def brute_crf(model, words):
    """Posteriors by listing all label sequences."""
    score = lid_crf.Features(words, model.lexicon).scores(model.weights)
    n, total = len(model.langs), np.zeros((len(words), len(model.langs)))
    for labels in itertools.product(range(n), repeat=len(words)):
        s = sum(score[t, k] for t, k in enumerate(labels)) + sum(model.moves[a, b] for a, b in zip(labels, labels[1:]))
        for t, k in enumerate(labels):
            total[t, k] += np.exp(s)
    return total / total.sum(axis=1, keepdims=True)


def test_forward_backward_is_exact():
    rows = [("aa", "kala mala tana " * 30), ("bb", "zirp quix strop " * 30), ("cc", "öna üla äma " * 30)]
    model = lid_crf.train(rows)
    words = ["kala", "zirp", "quix", "öna", "neu", "tana"]
    got = model.posteriors(sorted(set(words)), np.array([sorted(set(words)).index(w) for w in words]), np.array([len(words)]))
    assert got == pytest.approx(brute_crf(model, words), abs=1e-6)
    # Blocks: a long text has the posteriors of the plain recursion.
    long_ = [random.Random(1).choice(words) for _ in range(3 * lid_crf.BLOCK + 5)]
    names = sorted(set(words))
    code = np.array([names.index(w) for w in long_])
    got = model.posteriors(names, np.concatenate([code, code[:1]]), np.array([len(code), 0, 1]))
    psi = np.exp(lid_crf.Features(names, model.lexicon).scores(model.weights))[code]
    step = np.exp(model.moves)
    alpha, beta = [psi[0] / psi[0].sum()], [np.ones(3)]
    for p in psi[1:]:
        a = (alpha[-1] @ step) * p
        alpha.append(a / a.sum())
    for p in psi[:0:-1]:
        b = step @ (p * beta[-1])
        beta.append(b / b.sum())
    post = np.array(alpha) * np.array(beta[::-1])
    assert got[:-1] == pytest.approx(post / post.sum(axis=1, keepdims=True), abs=1e-6)


def test_code_switched_words_are_labelled():
    model = lid_crf.train([("aa", "kala mala tana " * 40), ("bb", "zirp quix strop " * 40)])
    _, _, post = lid_crf.label_words(model, ["kala mala tana kala zirp quix strop zirp quix"])
    assert [model.langs[k] for k in post.argmax(axis=1)] == ["aa"] * 4 + ["bb"] * 5


def test_language_id_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries()["op1_crf_language_id"](spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_language_id_edge_cases(make_docs):
    docs = make_docs([(1, "kala mala", "aa", "s"), (2, "zirp quix", "bb", "s"), (3, None), (4, "12 %%"), (5, "KALA", None, None), (5, "KALA", None, None), (6, "kala " * 60_000, None, None)])
    rows = lid_crf.identify(docs, F.lit(True)).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in rows) == [(1, "aa"), (2, "bb"), (3, "und"), (4, "und"), (5, "aa"), (5, "aa"), (6, "aa")]
    assert {r.lang_pred for r in lid_crf.identify(docs, F.lit(False)).collect()} == {"und"}
    signs = make_docs([(1, "½ ² Ⅷ ① ٣"), (2, "kala½mala Ⅷ"), (3, "x" * 50)])
    model_docs = docs.unionByName(signs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.doc_id, r.lang_pred) for r in lid_crf.identify(model_docs, F.lit(True)).join(signs.select("doc_id", F.col("text").alias("t")), "doc_id").where("t = '½ ² Ⅷ ① ٣'").collect()} >= {(1, "und")}
    assert lid_crf.words_in("m² ½kala Ⅷ été ß3x") == ["m", "kala", "été", "ß", "x"]
    assert lid_crf.identify(make_docs([]), F.lit(True)).collect() == []


def test_separator_scan(make_docs):
    texts = ["one two", "", None, "three " * 500, "x", "", "<|endoftext|>", "ü" * 70]
    docs = make_docs([(i * 5 or None, t) for i, t in enumerate(texts)]).repartition(2)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(BPE))}, special_tokens={})
    blocks, order = separators.write_token_files(docs, BPE, public_tokenizers.PATTERN, EOD, block_tokens=7)
    found = separators.scan(blocks, EOD)
    got = {r.doc_id: r.n_tokens for r in order.join(found, ["file", "nth"]).collect()}
    assert got == {i * 5 or None: len(own.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert all(r.terminated for r in found.collect())
    assert separators.count_tokens(make_docs([]), BPE, public_tokenizers.PATTERN, EOD).collect() == []


@pytest.mark.parametrize("size", [1, 3, 64])
def test_raw_token_files(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(separators, "GROUP_BLOCKS", 2)
    r = random.Random(size)
    for name in ("a.bin", "b.bin", "c.bin"):
        ids = [EOD if r.random() < 0.2 else r.randrange(1000) for _ in range(r.randrange(1, 90))]
        (tmp_path / name).write_bytes(np.array(ids, dtype="<u2").tobytes())
    read = lambda whole: sorted((r.file[-5:], r.nth, r.start, r.n_tokens, r.terminated) for r in separators.scan(separators.read_token_files(spark, str(tmp_path), size, whole=whole), EOD).collect())
    got = read(separators.WHOLE)
    want = []
    for f in sorted(tmp_path.glob("*.bin")):
        start, nth, ids = 0, 0, np.fromfile(f, dtype="<u2")
        for i, x in enumerate(ids):
            if x == EOD:
                want.append((f.name, nth, start, i - start, True))
                start, nth = i + 1, nth + 1
        if start < len(ids):
            want.append((f.name, nth, start, len(ids) - start, False))
    assert got == want == read(20)  # and by byte ranges
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="odd number"):
        read(separators.WHOLE)


def test_toxicity_tells_classes_apart(spark, make_docs):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{int(r.paretovariate(0.6)) % 5000}" for _ in range(r.randrange(20, 120))]
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            words[r.randrange(len(words))] = r.choice(["vile", "dolt", "fool"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "w1 " * 50_000), (903, "vile dolt fool"), (903, "vile dolt fool")]
    labels += [(900, 1), (901, None), (None, 1)]
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = toxicity_kn.score_documents(make_docs(rows), marks, fold(5, 0)).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    score = {x.doc_id: x.score for x in got}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {x.doc_id for x in got if x.held_out and x.doc_id < 600} == set(held)
    bad, good = [score[i] for i in held if i % 6 == 0], [score[i] for i in held if i % 6]
    assert np.mean([a > b for a in bad for b in good]) > 0.95
    assert score[903] > 0.5 > score[901]
    only = toxicity_kn.score_documents(make_docs(rows[:9]), marks.where("toxic = 0"), fold(5, 0)).collect()
    assert {x.score for x in only} == {0.0}
    assert toxicity_kn.score_documents(make_docs([]), marks, fold(5, 0)).collect() == []


def brute_kneser_ney(texts, corpus, symbols):
    """A function (class, context, symbol) -> probability, by dictionaries: class orders of 5, 4 and 3 characters over shared
    ones of 2, 1 and 0. texts: (class, words); corpus: all words, with repeats."""
    low, high, mark = toxicity_kn.LOW, toxicity_kn.HIGH, "\n"

    def tables(counted, lengths, top):
        grams = {k: {} for k in lengths}
        left = {k: {} for k in lengths}
        for word, n in counted.items():
            line = mark + word + mark
            for i in range(1, len(line)):
                for k in lengths:
                    if i >= k:
                        gram = line[i - k : i + 1]
                        if (k > 0 and gram[0] == mark) if top == low - 1 else (i != k and k < low):
                            continue  # the shared model does not see the beginning; short contexts of classes are whole words
                        if k == top or (top == high and i == k):
                            grams[k][gram] = grams[k].get(gram, 0) + n
                        else:
                            left[k].setdefault(gram, set()).add(line[i - k - 1])
        for k in lengths:
            for gram, before in left[k].items():
                grams[k][gram] = grams[k].get(gram, 0) + len(before)
        return grams

    def step(grams, context, symbol, below):
        cut = toxicity_kn.discounts(*[sum(c == j for c in grams.values()) for j in (1, 2, 3, 4)])
        mine = {g: c for g, c in grams.items() if g[:-1] == context}
        total = sum(mine.values())
        if not total:
            return below
        d = {g: min(cut[min(c, 3) - 1], c) for g, c in mine.items()}
        own = mine.get(context + symbol, 0) - d.get(context + symbol, 0)
        return (own + sum(d.values()) * below) / total

    words = {w: corpus.count(w) for w in corpus}
    shared = tables(words, range(low), low - 1)
    classes = [tables({w: sum(w in t for k, t in texts if k == c) for w in {w for k, t in texts if k == c for w in t}}, range(1, high + 1), high) for c in (0, 1)]

    def p(c, context, symbol):
        value = 1 / len(symbols)
        for k in range(low):
            if len(context) >= k and mark not in context[len(context) - k :]:
                value = step(shared[k], context[len(context) - k :], symbol, value)
        for k in range(1, high + 1):
            own = context[len(context) - k :]
            if c is not None and len(context) >= k and (k >= low or own[0] == mark):
                value = step(classes[c][k], own, symbol, value)
        return value

    return p


def test_toxicity_probabilities(spark, make_docs):
    """The model's ratios are those of a plain Kneser-Ney, whose probabilities after any context add up to 1."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(1, 8)))
    texts = [(c, [word() for _ in range(r.randrange(5, 25))]) for c in (0, 1) for _ in range(12)]
    texts[0][1].extend(["Überall", "zzz"])
    texts[13][1].append("zzzz")
    texts = [(c, [w.lower() for w in ws]) for c, ws in texts]
    other = [word() for _ in range(100)]
    corpus = [w for _, ws in texts for w in ws] + other
    symbols = sorted(set("".join(corpus)) | {"\n"})
    p = brute_kneser_ney(texts, corpus, symbols)
    for context in ["\n", "\na", "\nab", "\nabc", "abcda"[:4], "bcdab", "zzz", "\nzzz", "überal"[-5:], "dddd"]:
        for c in (None, 0, 1):
            assert sum(p(c, context, x) for x in symbols) == pytest.approx(1)

    docs = make_docs([(k, " ".join(ws)) for k, (_, ws) in enumerate(texts)] + [(99, " ".join(other))])
    shared = toxicity_kn.shared_model(toxicity_kn.trigrams(toxicity_kn.shared_words(docs)))
    rows = np.array([(x.a, x.b, x.x, x.p) for x in shared.select("a", "b", "x", "p").collect()], dtype="<f8")
    for a, b, x, got in rows.tolist():
        context = "".join(chr(int(c)) for c in (a, b) if c >= 0)
        assert got == pytest.approx(p(None, context, chr(int(x))))
    sample = toxicity_kn.Sample([("".join(w + "\n" for w in dict.fromkeys(ws)), np.ones(len(set(ws)))) for _, ws in texts], rows)
    model = toxicity_kn.Model(sample, tuple(sample.counts(np.array([k for k, (x, _) in enumerate(texts) if x == c])) for c in (0, 1)))
    asked = [*dict.fromkeys(corpus), "abcdabcdabcd", "zzzzz", "überallzz", "d"]
    got = model.ratios(toxicity_kn.Letters("".join(w + "\n" for w in asked)))
    for w, ratio in zip(asked, got, strict=True):
        line, want = "\n" + w + "\n", 0.0
        for i in range(1, len(line)):
            context = line[max(0, i - toxicity_kn.HIGH) : i]
            want += np.log(p(1, context, line[i])) - np.log(p(0, context, line[i]))
        assert ratio == pytest.approx(want, abs=1e-4), w


def test_toxicity_ignores_what_neither_class_tells_apart(spark, make_docs):
    rows = [(i, f"plain{i % 7} words{i % 5} here{i % 3} so{i // 4 % 9} " + ("vileness" if i % 4 == 0 else "fineness")) for i in range(400)]
    rows += [(900, "qqq xyxyxyx"), (901, "uvuvuvuv qqq"), (902, "vileness of"), (903, "vilenesses of")]
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity_kn.score_documents(make_docs(rows), marks, F.lit(True)).collect()}
    assert got[900].score == got[901].score < min(got[902].score, got[903].score)  # spelled alike: evidence, though never seen
    assert got[0].predicted == 1 and got[1].predicted == 0


def test_toxicity_on_held_out_labels(spark, sf_dir):
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = queries()["op8_kneser_ney_toxicity"](spark, sf_dir).where("held_out").join(marks, "doc_id").collect()
    bad, good = ([r.score for r in rows if r.toxic == c] for c in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in bad for b in good]) > 0.85


def test_patience_alignment():
    assert licenses.longest_increasing([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.choice("abcdefgh") for _ in range(r.randrange(12))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(licenses.patience(list("abcdef"), list("abxdef"))) == 5


def test_license_scan(make_docs):
    mit = licenses.TEMPLATES["MIT-text"]
    words = mit.split()
    words[10:12] = ["other"]
    filler = "some words of the text that has no license in it and the like " * 40
    docs = make_docs([
        (1, filler + "Released under the MIT License. " + filler), (2, filler), (3, None), (4, ""),
        (5, filler + " ".join(words) + filler), (6, "RELEASED UNDER THE\nMIT licence"), (7, "All rights reserved. " * 3 + filler),
        (8, filler * 200 + "Licensed under CC BY-NC 4.0."), (9, "license mit the under released"), (1, "Released under the MIT License."),
    ])
    got = {(r.doc_id, r.license) for r in licenses.scan_licenses(docs).collect()}
    assert got == {(1, "MIT"), (2, None), (3, None), (4, None), (5, "MIT-text"), (6, "MIT"), (7, "All-rights-reserved"), (8, "CC-BY-NC-4.0"), (9, None)}
    (whole,) = [r for r in licenses.scan_licenses(docs).collect() if r.doc_id == 8]
    assert whole.coverage == 1.0 and whole.end_word - whole.first_word == 7
    assert licenses.scan_licenses(make_docs([])).collect() == []


@pytest.mark.parametrize("between", [" ", " again ", " and some more words here "])
def test_license_scan_finds_repeated_notices_in_mid_text(between):
    """One, two and three copies of every template give the same license at full coverage."""
    own = licenses.Templates(licenses.TEMPLATES, 0.8)
    for name, notice in licenses.TEMPLATES.items():
        texts = ["some more text here. " * 30 + between.join([notice] * times) + " and the text goes on." * 30 for times in (1, 2, 3, 20)]
        found = own.scan(pa.array(texts))
        assert all({x[0]: x[1] for x in f}[name] == 1.0 for f in found), name
        assert len({f[0][0] for f in found}) == 1


def subsequence_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j], row[j + 1])), row[j + 1]
    return row[-1]


def test_license_coverage_against_every_window(make_docs):
    """Best coverage over all windows of a text by brute force, of notices with words changed, left out and put in."""
    r = random.Random(6)
    names = ["MIT", "GPL-3.0", "CC-BY-SA-4.0", "MPL-2.0", "All-rights-reserved"]
    own, texts = licenses.Templates({n: licenses.TEMPLATES[n] for n in names}, 0.8), []
    for _ in range(60):
        words = licenses.WORD.findall(licenses.TEMPLATES[r.choice(names)])
        for _ in range(r.randrange(4)):
            k = r.randrange(len(words) + 1)
            words[k : k + r.randrange(2)] = [r.choice(["the", "of", "new", "work", words[0]])] * r.randrange(2)
        filler = [r.choice(["the", "of", "this", "is", "work", "license", "a"]) for _ in range(r.randrange(40))]
        texts.append(" ".join(filler + words * r.randrange(1, 3) + filler))
    cut = {n: [w.lower() for w in licenses.WORD.findall(licenses.TEMPLATES[n])] for n in names}
    for text, found in zip(texts, own.scan(pa.array(texts)), strict=True):
        words, got = [w.lower() for w in licenses.WORD.findall(text)], {x[0]: x for x in found}
        for n, t in cut.items():
            span = licenses.SPREAD * len(t)
            best = max(subsequence_length(t, words[k : k + span]) for k in range(max(1, len(words) - span + 1))) / len(t)
            if n in got:
                _, share, first, end = got[n]
                assert 0.8 - 1e-9 <= share and subsequence_length(t, words[first:end]) >= round(share * len(t))
                assert best - share < 0.15
            else:
                assert best < 0.8 + 2 / len(t)  # patience may miss a word or two of the longest subsequence


def test_license_scan_finds_all_planted_lines(spark, sf_dir):
    lines = ["Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "All rights reserved."]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    found = {r.doc_id for r in queries()["op9_license_scan"](spark, sf_dir).where("license IS NOT NULL").collect()}
    assert found == {d.doc_id for d in docs if any(line in (d.text or "") for line in lines)}


def test_pipeline(spark, sf_dir, make_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, stages = docs.collect(), corpus_pipeline.STAGES
    assert [n for n, _ in stages] == ["language_id", "exact_dedup", "ngram_jaccard_join", "weighted_mix", "byte_bpe"]
    from tests.llm.test_jaccard_join import brute
    from tests.llm.test_text_operators import lowered

    left = [r for r in rows if any(ch.isalpha() for ch in r.text or "")]
    last = {}
    for r in left:
        last[lowered(r.text)] = max(r.doc_id, last.get(lowered(r.text), -1))
    left = [r for r in left if last[lowered(r.text)] == r.doc_id]
    groups = brute([(r.doc_id, r.text) for r in left])
    left = {r.doc_id for r in left if groups[r.doc_id][1] == r.doc_id}
    now = docs
    for _, stage in stages[:3]:
        now = stage(spark, now, sf_dir)
        assert now.columns == docs.columns
    assert sorted(r.doc_id for r in now.select("doc_id").collect()) == sorted(left)
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    taken = [r.doc_id for r in out.collect()]
    # The mix by a sequential queue, and the library's tokens.
    from tests.llm.test_text_operators import fair_queue

    target = {r.doc_id: r.target for r in mixing.mix_documents(now).collect()}
    told = sorted(mixing.told(now).collect(), key=lambda r: (r.shuffled, r.doc_id))
    words = fair_queue([(r.doc_id, r.source, r.size, target[r.doc_id]) for r in told], sum(r.size for r in told))
    size = {r.doc_id: r.size for r in told}
    assert Counter(taken) == {i: -(-n // size[i]) for i, n in words.items() if n}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(BPE))}, special_tokens={})
    text = {r.doc_id: r.text for r in rows}
    for r in out.collect():
        ids = own.encode_ordinary(text[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    for _, stage in stages[:4]:
        assert stage(spark, make_docs([]), sf_dir).collect() == []


def test_pipeline_keeps_documents_whose_ids_are_null_or_repeat(spark, sf_dir, make_docs):
    words = lambda k: " ".join(f"{c}{k}" for c in "abcdefghijklmnopqrstuvwxyz")
    near = words("n") + " " + words("m") + " " + words("o")
    given = [(None, words("p")), (None, words("q")), (None, words("p").upper()), (1, words("r")), (1, words("s")), (1, "12 34"), (None, "5 6"), (2, near), (3, near + " x"), (3, words("t")), (4, words("r")), (1, words("u"))]
    docs, left = make_docs(given), []
    for _, stage in corpus_pipeline.STAGES[:4]:
        path = corpus_pipeline.fresh_path(spark, "kept")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        left.append(sorted(((r.doc_id or 0), r.text.lower()) for r in docs.collect()))
    some = [(i or 0, t.lower()) for i, t in given]
    assert left[0] == sorted(x for x in some if x[1] not in ("12 34", "5 6"))
    assert left[1] == sorted(x for x in set(left[0]) if x != (1, words("r")))
    assert left[2] == sorted(x for x in left[1] if x[1] != near + " x")
    # One source: each document is taken once.
    assert left[3] == left[2]
    assert len(corpus_pipeline.tokens(spark, docs, sf_dir).collect()) == len(left[3])


def test_entry_registers_all():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)] and "pipeline" in entry.queries()
    assert duckdb is not None
