"""Toxicity by class-conditional Kneser-Ney models of spelling.

For each class (toxic and ordinary) an interpolated Kneser-Ney model gives the probability of a word, character by character
up to its end mark: after the last five, four and three characters, or after all of the word so far if that is shorter, by
the counts of the class; below that by counts that the classes share. Counts of a class are the learned documents that a word
stands in, at lower orders distinct characters before (continuation counts); discounts are estimated for each class and order
from the counts of counts. The shared model (after two, one and no characters, wherever in a word) is of all words of all
documents, so an expression that neither class knows costs both the same and tells nothing, and one that is rare in a class
leans on what the corpus spells alike.

A word's ratio is log P(word | toxic) - log P(word | ordinary). A document's evidence is the length-normalised comparison: the
mean over its words of what the ratio exceeds a dead zone by, since the many words that hardly tell the classes apart would
drown the few that do; the dead zone (one of ZONES, 0 and none at all among them) and the curve that turns evidence into a
probability are chosen by cross-validation on the rows that may be learned from. Both classes weigh the same there, however
rare toxic labels are: a score of 0.5 says that the text is as likely among toxic documents as among ordinary ones.

The class counts come from a bounded sample of labelled rows: rows_per_class of each class and CHARS_PER_CLASS of their
texts, chosen by a hash of the id; a labelled text beyond MAX_CHARS is scored but not learned from. One task fits them. The
shared counts are grouped, written tables (words, then trigrams of characters) that grow with the corpus. Scoring needs them
for the trigrams of the sample only: of any other the share is the same in both classes and cancels out. So what is broadcast
is the bounded class model.

Words are runs of letters and digits, in lower case. Edge cases: null and empty texts have no evidence and score what the
curve gives for none; null labels are not learned from, of contradictory labels of one id the larger counts; equal texts of a
class are learned once; where a class has no labelled row, every score is the share of toxic labels; repeated rows score alike;
empty tables give empty results; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, P, Words, mix64, slices, staged

ROWS_PER_CLASS, CHARS_PER_CLASS, MAX_CHARS = 4_000, 8_000_000, 200_000
#: Least and greatest context length of the class models in the middle of a word.
LOW, HIGH = 3, 5
#: Dead zones to choose from (None: the plain mean), and folds of the choice.
ZONES, FOLDS = (None, 0.0, 0.5, 1.0, 1.5, 2.0, 3.0), 4
#: Marks the beginning and the end of a word.
MARK = 10
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: pa.Array) -> Words:
    return Words(texts, lower=True, spaces=NOT_ALNUM)


def spelled(words: Words, rows: np.ndarray) -> str:
    """The chosen words, one line each, in lower case."""
    lo, hi = words.starts[rows], words.ends[rows]
    size = hi - lo + 1
    to = np.cumsum(size) - size
    index = np.arange(int(size.sum())) - np.repeat(to - lo, size)
    data = words.data[np.minimum(index, len(words.data) - 1)]
    data[to + size - 1] = MARK
    return data.tobytes().decode("utf-8").lower()


class Letters:
    """The characters of words (lines of a string), each with the hashes of the contexts and n-grams that end at it.

    A character's context does not reach beyond its word's beginning mark, which counts as a character.
    """

    def __init__(self, lines: str | np.ndarray):
        """lines: each with a line feed at its end; or their code points, with one before them too."""
        self.codes = np.frombuffer(("\n" + lines).encode("utf-32-le"), dtype="<i4") if isinstance(lines, str) else lines
        mark = self.codes == MARK
        self.at = np.arange(1, len(self.codes), dtype=np.int32)
        begin = np.flatnonzero(mark)[:-1].astype(np.int32)
        self.n_words = len(begin)
        self.word = np.cumsum(mark, dtype=np.int32)[:-1] - 1
        self.reach = self.at - begin[self.word] if len(begin) else self.at
        #: Where each word's characters begin, among all characters.
        self.first = begin

    def parts(self, words: int = 20_000) -> Iterator[Letters]:
        """The same words, some at a time."""
        ends = np.append(self.first, len(self.codes) - 1)
        for k in range(0, self.n_words, words):
            yield Letters(self.codes[ends[k] : ends[min(k + words, self.n_words)] + 1])

    def before(self, k: int) -> np.ndarray:
        """The character k places before each; only to be used where reach is k or more."""
        return self.codes[np.maximum(self.at - k, 0)]

    def low(self) -> tuple[np.ndarray, np.ndarray]:
        """The one or two characters before each that the shared model looks at: never the beginning mark, -1 for none."""
        return np.where(self.reach >= 3, self.before(2), -1), np.where(self.reach >= 2, self.before(1), -1)

    def hashes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each context length: k, whether the classes have a context of that length here, its hash, the n-gram's hash."""
        h = np.full(len(self.at), 7, dtype=np.uint64)
        own = mix64(self.codes[1:].astype(np.uint64) + np.uint64(977))
        for k in range(1, HIGH + 1):
            h = mix64(h * _STEP + (self.before(k).astype(np.uint64) + np.uint64(1)))
            yield k, (self.reach == k) | (self.reach > k) & (k >= LOW), h, mix64(h ^ own)


class Table:
    """Sorted 64-bit hashes with values. Hashes are spread evenly, so their leading bits tell where to look."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = min(24, max(1, (2 * len(keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def __reduce__(self):
        return Table, (self.keys, self.values)  # the starts are made again where it is read

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is in the table, and its value (0 if not)."""
        value = np.zeros(len(asked), dtype=self.values.dtype)
        there = np.zeros(len(asked), dtype=bool)
        if not len(self.keys):
            return there, value
        at, left = self.starts[(asked >> self.shift).astype(np.int64)], np.arange(len(asked))
        inside = np.flatnonzero(at < len(self.keys))
        at, left = at[inside], left[inside]
        while len(left):
            key, wanted = self.keys[at], asked[left]
            hit = key == wanted
            there[left[hit]] = True
            value[left[hit]] = self.values[at[hit]]
            on = np.flatnonzero((key < wanted) & (at + 1 < len(self.keys)))
            at, left = at[on] + 1, left[on]
        return there, value


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Discounts of counts of one, two and more, from the numbers of n-grams that are counted once, twice, ..."""
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    most = lambda k, more, less: float(np.clip(k - (k + 1) * y * more / less if less else 0.5, 0.1, k - 0.1))
    return most(1, n2, n1), most(2, n3, n2), most(3, n4, n3)


def shared_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n: how often each word stands in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column(0))
                _, first, n = np.unique(words.hashes(), return_index=True, return_counts=True)
                if len(n):
                    yield pa.RecordBatch.from_arrays([pa.array(spelled(words, first).split("\n")[:-1], pa.string()), pa.array(n.astype(np.int64))], ["word", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n bigint")
    return staged(found.groupBy("word").agg(F.sum("n").alias("n")), "kn-words")


def trigrams(words: DataFrame) -> DataFrame:
    """a, b, x, n: how often each character follows two others in words (word, n); b is MARK at a word's beginning, and a is -1
    then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 100_000):
                part = batch.slice(k, 100_000)
                a, b, x, n = tally(Letters("".join(w + "\n" for w in part.column(0).to_pylist())), np.asarray(part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a, b, x, n)], ["a", "b", "x", "n"])

    return words.mapInArrow(run, "a bigint, b bigint, x bigint, n bigint").groupBy("a", "b", "x").agg(F.sum("n").alias("n"))


def tally(letters: Letters, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct trigrams of words that are counted n times, and their counts."""
    kinds, which = np.unique(keys_of(np.where(letters.reach >= 2, letters.before(2), -1), letters.before(1), letters.codes[1:]), return_inverse=True)
    total = np.bincount(which, weights=n[letters.word], minlength=len(kinds)).astype(np.int64)
    low = (1 << 21) - 1
    return (kinds >> 42) - 1, ((kinds >> 21) & low) - 1, kinds & low, total


def keys_of(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One number for three characters, of which the first two may be -1."""
    return ((a.astype(np.int64) + 1) << 42) | ((b.astype(np.int64) + 1) << 21) | x.astype(np.int64)


def shared_model(tri: DataFrame) -> DataFrame:
    """a, b, x, p: the Kneser-Ney probability of each character after two others, after one (a is -1) and after none (b too)."""
    pairs = tri.groupBy("b", "x").agg(F.count(F.lit(1)).alias("n"))
    single = pairs.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    counts = lambda d: discounts(*d.agg(*[F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)]).first())

    def level(d: DataFrame, context: list[str], below: DataFrame, on: list[str]) -> DataFrame:
        one, two, more = counts(d)
        cut = F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)
        sums = d.groupBy(*context).agg(F.sum("n").alias("total"), F.sum(cut).alias("free"))
        joined = d.join(sums, context) if context else d.crossJoin(F.broadcast(sums))  # sums is one row then
        return joined.join(below.withColumnRenamed("p", "q"), on).select(*context, "x", ((F.col("n") - cut + F.col("free") * F.col("q")) / F.col("total")).alias("p"))

    none = F.lit(-1).cast("bigint")
    zero = level(single, [], single.select("x", (F.lit(1.0) / F.lit(max(1, single.count()))).alias("p")), ["x"])
    one = level(pairs.where(F.col("b") != MARK), ["b"], zero, ["x"])
    two = level(tri.where((F.col("a") >= 0) & (F.col("a") != MARK)), ["a", "b"], one, ["b", "x"])
    return two.unionByName(one.withColumn("a", none)).unionByName(zero.withColumns({"a": none, "b": none}))


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, rows_per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, toxic, words (the distinct ones, with their number in the text) of the bounded sample, staged, and the number of
    labelled rows of each class."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(learn)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # A first, wider choice by rows, of a bounded number of ids, which may go to the executors; then by rows and characters.
    total = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1_000_000)) / 1_000_000
    by_class = lambda share: F.coalesce(*[F.when(F.col("toxic") == k, F.lit(s)) for k, s in sorted(share.items())], F.lit(0.0))
    share = {k: min(1.0, rows_per_class / n) for k, n in total.items()}
    met = own.join(F.broadcast(known.where(place < by_class(share))), "doc_id").where(F.length("text") <= MAX_CHARS)
    size = {r[0]: r[1] for r in met.groupBy("toxic").agg(F.sum(F.length("text"))).collect()}
    share = {k: s * min(1.0, CHARS_PER_CLASS / max(1, size.get(k, 0))) for k, s in share.items()}
    rows = met.where(place < by_class(share)).select("doc_id", "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, lines, times = words_of(part.column(2)), [], []
                hashes = words.hashes()
                for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                    _, first, n = np.unique(hashes[a:b], return_index=True, return_counts=True)
                    lines.append(spelled(words, a + first))
                    times.append(n.astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lines, pa.string()), pa.array(times, pa.binary())], ["doc_id", "toxic", "words", "times"])

    return staged(rows.mapInArrow(run, "doc_id bigint, toxic int, words string, times binary"), "kn-sample"), total


def sample_trigrams(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """The shared probabilities of the trigrams that the sample's words have, packed: data (a, b, x, p)."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = Letters("".join(batch.column(0).to_pylist()))
            kinds, some = np.unique(keys_of(*letters.low(), letters.codes[1:]), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(v[some].astype(np.int64)) for v in (*letters.low(), letters.codes[1:])], ["a", "b", "x"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([np.column_stack([np.asarray(c).astype("<f8") for c in batch.columns]).tobytes()], pa.binary())], ["data"])

    mine = rows.select("words").mapInArrow(own, "a bigint, b bigint, x bigint").distinct()
    return shared.join(mine, ["a", "b", "x"], "left_semi").select("a", "b", "x", "p").mapInArrow(pack, "data binary")


class Sample:
    """The distinct words of learned texts, the texts as places in them, and the shared probability of every character."""

    def __init__(self, texts: list[tuple[str, np.ndarray]], shared: np.ndarray):
        place: dict[str, int] = {}
        self.texts = [np.array([place.setdefault(w, len(place)) for w in lines.split("\n")[:-1]], dtype=np.int32) for lines, _ in texts]
        self.times = [n for _, n in texts]
        self.letters = Letters("".join(w + "\n" for w in place))
        self.n_words = len(place)
        s = shared.reshape(-1, 4)
        keys = mix64(keys_of(s[:, 0], s[:, 1], s[:, 2]).view(np.uint64))
        order = np.argsort(keys)
        known, p = Table(keys[order], s[order, 3]).find(mix64(keys_of(*self.letters.low(), self.letters.codes[1:]).view(np.uint64)))
        self.base = np.where(known, p, 1e-12)  # all are known if the sample is of the corpus
        self.orders: list[Order] = []
        for k, has, context, gram in self.letters.hashes():
            self.orders.append(Order(k, has, context, gram, self.letters.reach))
            if k > 1:
                self.orders[-2].extend(self.orders[-1])

    def counts(self, of: np.ndarray) -> np.ndarray:
        """How many of the texts each word stands in."""
        return np.bincount(np.concatenate([self.texts[k] for k in of] or [np.zeros(0, dtype=np.int64)]), minlength=self.n_words)


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, where one of each is, and the number of each key."""
    order = np.argsort(keys, kind="stable").astype(np.int32)
    ranked = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(keys), dtype=np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return ranked[new], order[new], number


class Order:
    """The n-grams and contexts of one length among a sample's characters, numbered."""

    def __init__(self, k: int, has: np.ndarray, context: np.ndarray, gram: np.ndarray, reach: np.ndarray):
        self.k, self.rows = k, np.flatnonzero(has).astype(np.int32)
        self.grams, some, self.gram = numbered(gram[self.rows])
        self.some = some
        self.contexts, _, of = numbered(context[self.rows][some])
        self.context = of
        self.head = reach[self.rows] == k
        self.longer, self.longer_of = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)

    def extend(self, longer: Order) -> None:
        """What the n-grams of the next length, but for those at a word's beginning, shorten to."""
        mine = np.full(max(int(self.rows.max(initial=-1)), int(longer.rows.max(initial=-1))) + 1, -1, dtype=np.int32)
        mine[self.rows] = self.gram
        of = mine[longer.rows[longer.some]]
        self.longer, self.longer_of = np.flatnonzero(of >= 0).astype(np.int32), of[of >= 0]

    def counts(self, n: np.ndarray, longer: Order | None) -> np.ndarray:
        """Of each n-gram how often it stands in words that are counted n times (by character), or, if there are longer ones and
        it is not a word's beginning, after how many distinct characters."""
        own = n[self.rows]
        c = np.bincount(self.gram, weights=own if longer is None else np.where(self.head, own, 0), minlength=len(self.grams))
        if longer is not None:
            seen = np.bincount(longer.gram, weights=n[longer.rows], minlength=len(longer.grams)) > 0
            c += np.bincount(self.longer_of[seen[self.longer]], minlength=len(self.grams))
        return c


def class_model(sample: Sample, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each order: the probability of each of its n-grams, whether the class knows each of its contexts, and its back-off weight."""
    p, n = sample.base.copy(), count[sample.letters.word].astype(np.float32)
    for order, longer in zip(sample.orders, [*sample.orders[1:], None], strict=True):
        c = order.counts(n, longer)
        cut = np.minimum(np.array([0.0, *discounts(*[float((c == j).sum()) for j in (1, 2, 3, 4)])])[np.minimum(c, 3).astype(np.int64)], c)
        total = np.bincount(order.context, weights=c, minlength=len(order.contexts))
        knows = total > 0
        weight = np.where(knows, np.bincount(order.context, weights=cut, minlength=len(order.contexts)) / np.maximum(total, 1), 1.0)
        own = (c - cut) / np.maximum(total, 1)[order.context]
        # Unknown contexts have weight 1 and no n-grams: what is shorter tells all.
        p[order.rows] = weight[order.context][order.gram] * p[order.rows] + own[order.gram]
        # What the n-grams tell, by one place of each.
        yield p[order.rows[order.some]], knows, weight


class Model:
    """Ratios of the two classes: of each order what an n-gram that the sample has tells, and what the back-off from a context
    tells where the n-gram is unknown; a dead zone and a curve over the evidence."""

    def __init__(self, sample: Sample, counts: tuple[np.ndarray, np.ndarray]):
        used = (counts[0] + counts[1])[sample.letters.word] > 0
        self.orders: list[tuple[Table, Table]] = []
        for order, (p0, knows0, w0), (p1, knows1, w1) in zip(sample.orders, class_model(sample, counts[0]), class_model(sample, counts[1]), strict=True):
            known = np.zeros(len(order.grams), dtype=bool)
            known[order.gram[used[order.rows]]] = True
            ratio = (np.log(p1) - np.log(p0)).astype(np.float32)
            met = knows0 | knows1
            back = (np.log(np.maximum(w1, 1e-12)) - np.log(np.maximum(w0, 1e-12))).astype(np.float32)
            self.orders.append((Table(order.grams[known], ratio[known]), Table(order.contexts[met], back[met])))
        self.zone: float | None = None
        self.curve = np.zeros(3)

    def ratios(self, letters: Letters) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        return np.concatenate([np.zeros(0), *[self._ratios(part) for part in letters.parts()]])

    def _ratios(self, letters: Letters) -> np.ndarray:
        told = np.zeros(len(letters.at))
        for (_, has, context, gram), (grams, contexts) in zip(letters.hashes(), self.orders, strict=True):
            # A known n-gram tells all; else the back-off from a known context adds to what the shorter ones told.
            rows = np.flatnonzero(has)
            met, back = contexts.find(context[rows])
            rows, back = rows[met], back[met]
            knows, value = grams.find(gram[rows])
            told[rows] = np.where(knows, value, told[rows] + back)
        return np.add.reduceat(told, letters.first)

    def above(self, ratios: np.ndarray) -> np.ndarray:
        return ratios if self.zone is None else np.maximum(ratios - self.zone, 0.0)

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(evidence) @ self.curve, -30, 30)))


def features(evidence: np.ndarray) -> np.ndarray:
    """What the curve is linear in; a rise of evidence never lowers them."""
    return np.column_stack([np.ones(len(evidence)), evidence, np.log(np.maximum(evidence, 0) + 1e-3)])


def curve(evidence: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Newton's method, lightly regularised, with no weight below 0 but the constant; and its loss."""
    best = (np.zeros(3), np.inf)
    for used in ([0, 1, 2], [0, 1], [0, 2]):
        x, w, ridge = features(evidence)[:, used], np.zeros(len(used)), np.full(len(used), 0.01)
        ridge[0] = 1e-6
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.diag(ridge), x.T @ (weight * (p - label)) + ridge * w)
            w = w - step / max(1.0, float(np.abs(step).max()) / 4)
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
        loss = float(-(weight * np.where(label > 0, np.log(p), np.log(1 - p))).sum())
        if (w[1:] >= 0).all() and loss < best[1]:
            full = np.zeros(3)
            full[used] = w
            best = (full, loss)
    if best[1] == np.inf:
        rate = np.clip((weight * label).sum() / weight.sum(), 1e-6, 1 - 1e-6)
        best = (np.array([np.log(rate / (1 - rate)), 0.0, 0.0]), np.inf)
    return best


def train(rows: list[tuple[int, int, str, np.ndarray]], total: dict[int, int], shared: np.ndarray) -> Model | float:
    """rows: (id, class, distinct words, their numbers); shared: probabilities of their trigrams (a, b, x, p). The model, or the
    share of toxic labels where a class has no row."""
    once = {(toxic, lines, n.tobytes()): (i, toxic, lines, n) for i, toxic, lines, n in rows}
    rows = [once[k] for k in sorted(once, key=lambda k: (once[k][0], k))]
    label = np.array([r[1] for r in rows], dtype=np.int64)
    if len(set(label.tolist())) < 2:
        return float(total.get(1, 0) / max(1, sum(total.values())))
    sample = Sample([(lines, n) for _, _, lines, n in rows], shared)
    fold = mix64(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)) % np.uint64(FOLDS)
    both = lambda rest: tuple(sample.counts(np.flatnonzero(rest & (label == c))) for c in (0, 1))
    ratios = np.zeros((FOLDS, sample.n_words))
    for f in range(FOLDS):
        rest = fold != f
        ratios[f] = Model(sample, both(rest if len(set(label[rest].tolist())) > 1 else np.ones(len(label), dtype=bool))).ratios(sample.letters)
    model, least = Model(sample, both(np.ones(len(label), dtype=bool))), np.inf
    weight = len(label) / 2 / np.bincount(label, minlength=2)[label]
    tried = Model.__new__(Model)
    for zone in ZONES:
        tried.zone = zone
        worth = [tried.above(r) for r in ratios]
        evidence = np.array([float((worth[int(f)][t] * n).sum() / max(1, n.sum())) for f, t, n in zip(fold, sample.texts, sample.times, strict=True)])
        fitted_curve, loss = curve(evidence, label, weight)
        if loss < least or zone is ZONES[0]:
            least, model.zone, model.curve = loss, zone, fitted_curve
    return model


def fitted(rows: DataFrame, shared: DataFrame, total: dict[int, int]) -> Model | float:
    """train() in a task, so that only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, known = [], []
        for batch in batches:
            for i, toxic, words, times, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if data is None:
                    texts.append((i, toxic, words, np.frombuffer(times, dtype="<i4")))
                else:
                    known.append(np.frombuffer(data, dtype="<f8"))
        model = train(texts, total, np.concatenate(known) if known else np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    empty = lambda kind: F.lit(None).cast(kind)
    told = sample_trigrams(rows, shared).select(empty("bigint").alias("doc_id"), empty("int").alias("toxic"), empty("string").alias("words"), empty("binary").alias("times"), "data")
    made = rows.withColumn("data", empty("binary")).unionByName(told).repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made.model) if made else train([], total, np.zeros(0))


def score_documents(docs: DataFrame, labels: DataFrame, learn: Column, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out (learn is false), score, predicted, evidence. learn: an expression over doc_id."""
    rows, total = training_rows(docs, labels, learn, rows_per_class)
    shared = shared_model(staged(trigrams(shared_words(docs)), "kn-trigrams"))
    model = docs.sparkSession.sparkContext.broadcast(fitted(rows, shared, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                evidence = np.zeros(part.num_rows)
                if isinstance(own, float):
                    score = np.full(part.num_rows, own)
                else:
                    words = words_of(part.column(2))
                    _, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
                    worth = own.above(own.ratios(Letters(spelled(words, first))))
                    sums = np.concatenate([[0.0], np.cumsum(worth[which])])
                    evidence = (sums[words.first[1:]] - sums[words.first[:-1]]) / np.maximum(words.count, 1)
                    score = own.scores(evidence)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(evidence)], ["doc_id", "held_out", "score", "predicted", "evidence"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    return own.select("doc_id", (~F.coalesce(learn, F.lit(False))).alias(P + "held"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, evidence double")
