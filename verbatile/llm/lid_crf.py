"""Language ID by a linear-chain conditional random field over words.

Each word's features are its character n-grams with word boundaries (those at a boundary are its affixes), and the word
itself if it is in the lexicon that training gathered. Their weights and the transitions between languages are learned
together; forward-backward gives each word of a code-switched text a distribution over languages. Long texts are cut into
blocks whose transfer matrices are multiplied block by block, so that all texts of a slice are worked on at once and the
result is that of the whole chain. A document's language has the largest mean probability over its words, its score is that
mean.

The model is fitted in one task on a bounded sample (docs_per_language documents of each language, chosen by a hash of the
id, of those with at most MAX_CHARS characters; longer ones are labelled whole like all others), cut into short pieces that
are strung together across languages, which teaches the transitions. Its size is bounded by SLOTS, LEXICON and the number of
languages.

Words are runs of letters (Unicode category L). Edge cases: a text that is null, empty or has no letter is `und` with score 0; a tie goes to the first language by code
point; with nothing to learn from, all is `und`; repeated rows get equal results; empty tables give empty results; extra
columns are not read, whatever their names.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, hashed_sample, mix64, slices

DOCS_PER_LANGUAGE, MAX_CHARS, SLOTS, LEXICON = 500, 200_000, 1 << 17, 20_000
GRAMS, BLOCK = (1, 2, 3, 4), 64
UNDEFINED = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_in(text: str) -> list[str]:
    """The runs of letters. The pattern also lets number signs such as fractions through, which cut words here."""
    found = _WORD.findall(text)
    if "".join(found).isalpha() or not found:
        return found
    return "".join(c if c.isalpha() else " " for c in " ".join(found)).split()


class Features:
    """The hashed features of words, as (feature, word) pairs in order of word for each kind."""

    def __init__(self, words: list[str], lexicon: np.ndarray | None = None):
        self.n = len(words)
        codes = np.frombuffer(("\n" + "\n".join(words) + "\n").lower().replace("İ", "i").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        edge = codes == 10
        word = np.cumsum(edge) - 1
        self.kinds: list[tuple[np.ndarray, np.ndarray]] = []
        mixed = mix64(codes + np.uint64(0x9E3779B97F4A7C15))
        inner = np.cumsum(edge)
        for n in GRAMS:
            m = len(codes) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, dtype=np.uint64)
            for k in range(n):
                h = mix64(h * np.uint64(31) + mixed[k : k + m])
            if n == 1:
                good = ~edge[:m]
            else:  # no boundary but the first or the last
                good = inner[n - 2 : n - 2 + m] - inner[:m] == 0
                good &= ~(edge[:m] & edge[n - 1 :]) if n == 2 else True
            at = np.flatnonzero(good & (word[:m] < self.n))
            self.kinds.append(((h[at] % np.uint64(SLOTS)).astype(np.int64), word[at]))
        first = np.flatnonzero(edge)[:-1] + 1
        place = (np.arange(len(codes)) - np.repeat(np.concatenate([[0], first[1:], [len(codes)]])[:-1], np.diff(np.concatenate([[0], first[1:], [len(codes)]])))).astype(np.uint64)
        self.whole = np.add.reduceat(np.where(edge, np.uint64(0), mix64(codes + (place << np.uint64(32)))), first) if self.n else np.zeros(0, dtype=np.uint64)
        if lexicon is not None and len(lexicon) and self.n:
            at = np.minimum(np.searchsorted(lexicon, self.whole), len(lexicon) - 1)
            known = np.flatnonzero(lexicon[at] == self.whole)
            self.kinds.append((SLOTS + at[known], known))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """For each word the sum of its features' weights."""
        out = np.zeros((self.n, weights.shape[1]))
        for feature, word in self.kinds:
            sums = np.zeros((len(feature) + 1, weights.shape[1]))
            np.cumsum(weights[feature], axis=0, out=sums[1:])
            cut = np.searchsorted(word, np.arange(self.n + 1))
            out += sums[cut[1:]] - sums[cut[:-1]]
        return out


class Crf:
    def __init__(self, langs: list[str], lexicon: np.ndarray):
        self.langs, self.lexicon = langs, lexicon
        self.weights = np.zeros((SLOTS + len(lexicon), len(langs)), dtype=np.float32)
        self.moves = np.zeros((len(langs), len(langs)))

    def fit(self, words: list[str], code: np.ndarray, label: np.ndarray, epochs: int = 2, batch: int = 64, rate: float = 0.3) -> None:
        """code: index into words, label: language, both [sequences, BLOCK]. Adagrad on the exact gradient."""
        n_langs, rng = len(self.langs), np.random.default_rng(7)
        square, square_moves = np.full(self.weights.shape, 1e-3, dtype=np.float32), np.full(self.moves.shape, 1e-3)
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(code)), max(1, len(code) // batch)):
                used, at = np.unique(code[rows], return_inverse=True)
                at = at.reshape(code[rows].shape)
                features = Features([words[i] for i in used], self.lexicon)
                score = features.scores(self.weights)
                psi = np.exp(score - score.max(axis=1, keepdims=True))[at]
                post, pairs = self._expect(psi)
                grad = post
                b, t = np.indices(at.shape)
                grad[b, t, label[rows]] -= 1
                by_word = np.stack([np.bincount(at.ravel(), weights=grad[:, :, k].ravel(), minlength=len(used)) for k in range(n_langs)], axis=1)
                for feature, word in features.kinds:
                    slots, where = np.unique(feature, return_inverse=True)
                    g = np.stack([np.bincount(where, weights=by_word[word, k], minlength=len(slots)) for k in range(n_langs)], axis=1)
                    square[slots] += g * g
                    self.weights[slots] -= rate * g / np.sqrt(square[slots])
                seen = np.zeros_like(self.moves)
                np.add.at(seen, (label[rows][:, :-1].ravel(), label[rows][:, 1:].ravel()), 1)
                g = pairs - seen
                square_moves += g * g
                self.moves -= rate * g / np.sqrt(square_moves)

    def _expect(self, psi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of whole sequences psi [sequences, length, languages], and the expected transitions."""
        step, (rows, length, n) = np.exp(self.moves - self.moves.max()), psi.shape
        alpha, beta = np.empty_like(psi), np.ones_like(psi)
        alpha[:, 0] = psi[:, 0] / psi[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, length):
            a = (alpha[:, t - 1] @ step) * psi[:, t]
            alpha[:, t] = a / a.sum(axis=1, keepdims=True)
        pairs = np.zeros((n, n))
        for t in range(length - 1, 0, -1):
            after = psi[:, t] * beta[:, t]
            b = after @ step.T
            joint = alpha[:, t - 1].T @ (after / (alpha[:, t - 1] * b).sum(axis=1, keepdims=True))
            pairs += joint * step
            beta[:, t - 1] = b / b.sum(axis=1, keepdims=True)
        post = alpha * beta
        return post / post.sum(axis=2, keepdims=True), pairs

    def posteriors(self, words: list[str], code: np.ndarray, count: np.ndarray) -> np.ndarray:
        """For each word of all texts (code: index into words, text after text; count: words of each text) the distribution
        over languages, by forward-backward over the whole text."""
        n, score = len(self.langs), Features(words, self.lexicon).scores(self.weights)
        psi = np.exp(score - score.max(axis=1, keepdims=True)) + 1e-30
        step = np.exp(self.moves - self.moves.max()) + 1e-12
        blocks = -(-count // BLOCK)
        first_word = np.concatenate([[0], np.cumsum(count)])[:-1]
        text = np.repeat(np.arange(len(count)), blocks)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = first_word[text] + nth * BLOCK
        size = np.minimum(count[text] - nth * BLOCK, BLOCK)
        words_at = np.minimum(start[:, None] + np.arange(BLOCK), len(code) - 1)
        local = psi[code[words_at]]
        real = np.arange(BLOCK) < size[:, None]
        opens = nth == 0  # nothing comes before a text's first word, so no transition leads to it
        norm = lambda x: x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)
        # Transfer matrix of each block: from the state before it to the one at its end.
        transfer = np.broadcast_to(np.eye(n), (len(text), n, n)).copy()
        for t in range(BLOCK):
            rows = np.flatnonzero(real[:, t])
            moved = transfer[rows] @ step
            if t == 0:
                moved[opens[rows]] = transfer[rows][opens[rows]]
            transfer[rows] = norm(moved * local[rows, t][:, None, :])
        # Over the blocks of each text, in step: what comes in from the left and from the right.
        left, right = np.full((len(text), n), 1 / n), np.ones((len(text), n))
        at = np.cumsum(blocks) - blocks
        for k in range(1, int(blocks.max(initial=0))):
            b = at[blocks > k] + k
            left[b] = norm(np.einsum("bi,bij->bj", left[b - 1], transfer[b - 1]))
        for k in range(1, int(blocks.max(initial=0))):
            b = (at + blocks)[blocks > k] - 1 - k
            right[b] = norm(np.einsum("bij,bj->bi", transfer[b + 1], right[b + 1]))
        alpha, beta = np.empty((len(text), BLOCK, n)), np.empty((len(text), BLOCK, n))
        a = left
        for t in range(BLOCK):
            moved = np.where(opens[:, None], a, a @ step) if t == 0 else a @ step
            a = np.where(real[:, t, None], norm(moved * local[:, t]), a)
            alpha[:, t] = a
        b = right
        for t in range(BLOCK - 1, -1, -1):
            beta[:, t] = b
            b = np.where(real[:, t, None], norm((local[:, t] * b) @ step.T), b)
        post = alpha * beta
        return (post / post.sum(axis=2, keepdims=True))[real]


def training_rows(docs: DataFrame, learn: Column, docs_per_language: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """doc_id, lang and text of the bounded sample."""
    ids = docs.where(learn & F.col(lang_col).isNotNull() & (F.length(text_col) <= MAX_CHARS)).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(lang_col).alias("lang"))
    chosen, _ = hashed_sample(ids, "lang", docs_per_language)
    # Bounded by docs_per_language a language, so the sample's ids may go to every executor.
    texts = docs.where(learn & F.col(lang_col).isNotNull() & (F.length(text_col) <= MAX_CHARS))
    texts = texts.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")


def fitted(sample: DataFrame) -> Crf | None:
    """The field fitted on a bounded sample (doc_id, lang, text), in a task rather than in the driver's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(rows))], pa.binary())], ["model"])

    # The order does not depend on how the sample was dealt.
    made = sample.select("doc_id", "lang", "text").repartition(1).sortWithinPartitions("doc_id", "lang", "text").mapInArrow(run, "model binary").first()
    return pickle.loads(made.model) if made else None


def train(rows: list[tuple[str, str]], seed: int = 5) -> Crf | None:
    """Fits the field on (language, text) rows; None if no row has a word."""
    rng = np.random.default_rng(seed)
    found = [(lang, w) for lang, text in rows if text and (w := words_in(text))]
    if not found:
        return None
    langs = sorted({lang for lang, _ in found})
    # Pieces of 5 to 40 words, dealt in random order: a code-switched text.
    pieces = []
    for lang, words in found:
        at = 0
        while at < len(words):
            size = int(rng.integers(5, 41))
            pieces.append((langs.index(lang), words[at : at + size]))
            at += size
    rng.shuffle(pieces)
    stream = [w for _, p in pieces for w in p]
    label = np.concatenate([np.full(len(p), k) for k, p in pieces])
    if short := -len(stream) % BLOCK:
        stream, label = stream + stream[:1] * short, np.concatenate([label, np.full(short, label[0])])
    code, words = pd.factorize(np.array(stream, dtype=object))
    count = np.bincount(code)
    top = np.argsort(-count, kind="stable")[:LEXICON]
    lexicon = np.unique(Features([words[i] for i in top if count[i] >= 5]).whole)
    model = Crf(langs, lexicon)
    model.fit(list(words), code.reshape(-1, BLOCK), label.reshape(-1, BLOCK))
    return model


def label_words(model: Crf, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """The words of the texts, their number in each, and the posteriors of all words."""
    found = [words_in(t) for t in texts]
    count = np.array([len(w) for w in found], dtype=np.int64)
    if not count.sum():
        return found, count, np.zeros((0, len(model.langs)))
    code, words = pd.factorize(np.array([w for ws in found for w in ws], dtype=object))
    return found, count, model.posteriors(list(words), code, count)


def identify(docs: DataFrame, learn: Column, docs_per_language: int = DOCS_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", with_words: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, held_out (learn is false), lang_pred, score, with with_words the words' languages, and
    the columns that carry names, unchanged, as P + "c_" + name.

    learn: which rows the model may learn from. One pass over the documents without a shuffle, besides the sample's.
    """
    model = fitted(training_rows(docs, learn, docs_per_language, id_col, text_col, lang_col))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id bigint, held_out boolean, lang_pred string, score double" + ", words array<string>, word_langs array<string>" * with_words
    schema += "".join(f", `{P}c_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = part.column(2).to_pylist()
                pred, score = np.full(len(texts), UNDEFINED, dtype=object), np.zeros(len(texts))
                words, word_langs = [[] for _ in texts], [[] for _ in texts]
                if own is not None:
                    found, count, post = label_words(own, texts)
                    cut = np.concatenate([[0], np.cumsum(count)])
                    sums = np.zeros((len(post) + 1, len(own.langs)))
                    np.cumsum(post, axis=0, out=sums[1:])
                    mean = (sums[cut[1:]] - sums[cut[:-1]]) / np.maximum(count, 1)[:, None]
                    has = count > 0
                    best = mean.argmax(axis=1)
                    pred[has] = np.array(own.langs, dtype=object)[best[has]]
                    score[has] = np.clip(mean.max(axis=1)[has], 0, 1)
                    if with_words:
                        which = post.argmax(axis=1)
                        words, word_langs = found, [[own.langs[k] for k in which[a:b]] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                columns = [part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array(score)]
                names = ["doc_id", "held_out", "lang_pred", "score"]
                if with_words:
                    columns += [pa.array(words, pa.list_(pa.string())), pa.array(word_langs, pa.list_(pa.string()))]
                    names += ["words", "word_langs"]
                columns += part.columns[3:]
                names += part.schema.names[3:]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).cast("bigint").alias(P + "id"), (~F.coalesce(learn, F.lit(False))).alias(P + "held"), F.col(text_col).alias("text"), *[F.col(c).alias(P + "c_" + c) for c in carry]).mapInArrow(run, schema)
