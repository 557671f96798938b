"""Substring deduplication by super-k-mer partitioning.

A window is WINDOW consecutive words of one document. Its minimiser is the smallest hash of the runs of MINI words in it,
the leftmost on ties. Neighbouring windows with the same minimiser travel as one packed string (a super-k-mer) to the bucket
of that minimiser, where sorting brings equal windows together exactly: windows are compared by their words, hashes only
order them. Every window but the first of its kind (smallest document, then earliest start) covers words that are removed.

* A minimiser that occurs once in the corpus has no repeated window; a bit table of fixed size keeps those at home.
* Hot minimisers are salted by document (id and text, so that copies of a text are spread too). Within a salt the first window
  of each kind is found as before; those first ones, one for each salt and kind, then meet by the window's words, spread over
  all tasks. Rows equal in id and text are one document, and of those a task sends one to a hot minimiser's buckets.

Windows are judged on the input, not on what is left. Edge cases: null and empty texts have no words; texts shorter than a
window lose nothing; rows that share an id are ordered by a hash of their text, and rows equal in both are one document with
one result each; a null id comes before all others; an empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import repeats
from .common import P, Words, mix64, slices, staged

WINDOW, MINI = 20, 4
#: Super-k-mers from which a minimiser is hot, and the most hot minimisers (the bound rises with the corpus to keep to it).
HOT, MOST_HOT = 4096, 1_000_000
#: Bits of a packed minimiser that hold its place; rows handled at once in a bucket.
PLACE_BITS, CHUNK_ROWS = 21, 30_000
#: Of minimisers that are rare in a task the survey hears one in so many.
RARE = 16


class SuperKmers:
    """The super-k-mers of a slice of texts: minimiser, text, first window (word index in its text) and number of windows."""

    def __init__(self, words: Words, window: int = WINDOW, mini: int = MINI):
        n, w = len(words), window - mini + 1
        none = np.zeros(0, dtype=np.int64)
        self.minimiser, self.text, self.start, self.windows, self.first_word = none.astype(np.uint64), none, none, none, none
        if n < window:
            return
        h, mixed = words.hashes(), None
        for k in range(mini):
            part = h[k : n - mini + 1 + k]
            mixed = mix64(part) if mixed is None else mix64(mixed * np.uint64(0x9E3779B97F4A7C15) + part)
        text = words.docs()
        place = np.arange(n) - words.first[text]
        low = np.uint64((1 << PLACE_BITS) - 1)
        key = (mixed & ~low) | (place[: len(mixed)].astype(np.uint64) & low)
        # Minimum over w neighbours: doubling, then two overlapping spans.
        have = 1
        while 2 * have <= w:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        if have < w:
            key = np.minimum(key[: len(key) - (w - have)], key[w - have :])
        at = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
        if not len(at):
            return
        key, own = key[at], text[at]
        begin = np.ones(len(at), dtype=bool)
        begin[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(begin)
        self.minimiser, self.text = key[first] >> np.uint64(PLACE_BITS), own[first]
        self.first_word, self.start = at[first], place[at[first]]
        self.windows = np.diff(np.append(first, len(at)))


def packed(words: Words, kmers: SuperKmers, rows: np.ndarray, window: int) -> pa.Array:
    """The chosen super-k-mers as strings: their words, unchanged, joined by one space."""
    size = words.ends - words.starts
    joined = np.full(int(size.sum()) + len(size), 32, dtype=np.uint8)
    to = np.concatenate([[0], np.cumsum(size + 1)])
    shift = np.repeat(to[:-1] - words.starts, size)
    source = np.arange(int(size.sum())) + np.repeat(words.starts - np.concatenate([[0], np.cumsum(size)])[:-1], size)
    joined[source + shift] = words.data[source]
    lo = to[kmers.first_word[rows]]
    hi = to[kmers.first_word[rows] + kmers.windows[rows] + window - 1] - 1
    length = hi - lo
    offsets = np.concatenate([[0], np.cumsum(length)])
    index = np.arange(int(offsets[-1])) + np.repeat(lo - offsets[:-1], length)
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(offsets.astype("<i4").tobytes()), pa.py_buffer(joined[index].tobytes()))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))


def survey(texts: DataFrame, window: int, mini: int, hot: int) -> tuple[np.ndarray, dict[int, int]]:
    """The table of minimisers that may occur more than once, and the number of salts of each hot one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros(0, dtype=np.uint64)]
        for batch in batches:
            for part in slices(batch, "text"):
                found.append(SuperKmers(Words(part.column(0)), window, mini).minimiser)
        values = np.concatenate(found)
        parts = repeats.task_parts(values)
        kinds, n = np.unique(values, return_counts=True)
        # Numbers of what is frequent in the task; of the rest one in RARE, drawn anew in each task, stands for RARE. An estimate
        # is good enough here: it decides what is salted, not what is found.
        salt = mix64(np.array([TaskContext.get().partitionId()], dtype=np.uint64))
        often, drawn = n >= 8, mix64(kinds ^ salt) % np.uint64(RARE) == 0
        n = np.where(often, n, n * RARE)
        keys, n = np.append(kinds[often | drawn].astype(np.int64), -1), np.append(n[often | drawn], len(values))
        blank = [None] * len(keys)
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in parts] + blank, pa.int32()), pa.array([d for _, d in parts] + blank, pa.binary()), pa.array([None] * len(parts) + keys.tolist(), pa.int64()), pa.array([None] * len(parts) + n.tolist(), pa.int64())],
            ["chunk", "data", "minimiser", "n"],
        )

    told = staged(texts.select("text").mapInArrow(run, "chunk int, data binary, minimiser bigint, n bigint"), "kmer-survey")
    counts = told.where("minimiser IS NOT NULL").groupBy("minimiser").agg(F.sum("n").alias("n"))
    total = counts.where("minimiser = -1").first()
    limit = max(hot, (total.n if total else 0) // MOST_HOT)
    salts = {r.minimiser: -(-r.n // limit) for r in counts.where((F.col("n") > limit) & (F.col("minimiser") >= 0)).collect()}
    return repeats.table(told), salts


def super_kmers(texts: DataFrame, bits: np.ndarray, salts: dict[int, int], window: int, mini: int) -> DataFrame:
    """minimiser, salt, salted, doc_id, tie, start, alone (no other minimiser place can hide in it) and the packed words."""
    sent = texts.sparkSession.sparkContext.broadcast((bits, np.array(sorted(salts), dtype=np.int64), np.array([salts[k] for k in sorted(salts)], dtype=np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot, ways = sent.value
        sent_by: set[tuple] = set()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words = Words(part.column(2))
                k = SuperKmers(words, window, mini)
                long_ = words.count >= 1 << PLACE_BITS
                rows = np.flatnonzero(repeats.maybe_repeated(bits, k.minimiser) | long_[k.text])
                if not len(rows):
                    continue
                value, text = k.minimiser[rows].astype(np.int64), k.text[rows]
                salt, salted = np.zeros(len(rows), dtype=np.int32), np.zeros(len(rows), dtype=bool)
                tie = np.asarray(part.column(1))[text]
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, value), len(hot) - 1)
                    salted = hot[at] == value
                    ids = np.asarray(part.column(0).fill_null(-(2**63)))
                    spread = mix64(mix64(tie.view(np.uint64)) + ids[text].view(np.uint64)) >> np.uint64(1)
                    salt[salted] = (spread[salted] % ways[at[salted]].astype(np.uint64)).astype(np.int32)
                    # Of rows equal in id and text the first of the task stands for all.
                    again = np.zeros(part.num_rows, dtype=bool)
                    for i in np.unique(text[salted]).tolist():
                        key = (part.column(0)[i].as_py(), part.column(1)[i].as_py())
                        again[i] = key in sent_by
                        sent_by.add(key)
                    stay = ~(salted & again[text])
                    rows, value, text, salt, salted, tie = (x[stay] for x in (rows, value, text, salt, salted, tie))
                columns = [pa.array(value), pa.array(salt), pa.array(salted), part.column(0).take(pa.array(text)), pa.array(tie), pa.array(k.start[rows]), pa.array(~long_[text]), packed(words, k, rows, window)]
                yield pa.RecordBatch.from_arrays(columns, ["minimiser", "salt", "salted", "doc_id", "tie", "start", "alone", "words"])

    return texts.select("doc_id", "tie", "text").mapInArrow(run, "minimiser bigint, salt int, salted boolean, doc_id bigint, tie bigint, start bigint, alone boolean, words string")


def repeated_windows(batch: pa.RecordBatch, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of super-k-mers in order of (bucket, document, start): for every window its row, its place in the flat words, whether
    an equal window comes before it, its place in its text, and whether it is the first of its kind here. Equal windows have
    equal words; hashes only sort."""
    lists = pc.split_pattern(batch.column("words"), " ")
    code = np.asarray(lists.flatten().dictionary_encode().indices).astype(np.int64)
    ends = np.asarray(lists.offsets)[1:].astype(np.int64) - int(lists.offsets[0].as_py())
    counts = np.diff(np.concatenate([[0], ends]))
    windows = counts - window + 1
    row = np.repeat(np.arange(len(counts)), windows)
    at = np.arange(len(row)) + np.repeat((ends - counts) - (np.cumsum(windows) - windows), windows)
    mixed = mix64(code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    h = np.zeros(len(code) - window + 1, dtype=np.uint64)
    for k in range(window):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + len(h)]
    # Salts of one bucket may be in one batch, and are told apart.
    salt = np.asarray(batch.column("salt")).astype(np.int64)[row]
    h = mix64(h[at] + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    same = np.zeros(len(order), dtype=bool)
    same[1:] = ranked[1:] == ranked[:-1]
    again = np.flatnonzero(same)
    a, b = at[order[again]], at[order[again - 1]]
    equal = salt[order[again]] == salt[order[again - 1]]
    for k in range(window):
        equal &= code[a + k] == code[b + k]
    doc, tie, start = (np.asarray(batch.column(c).fill_null(-(2**63)) if c == "doc_id" else batch.column(c)) for c in ("doc_id", "tie", "start"))
    repeated = np.zeros(len(at), dtype=bool)
    if equal.all():
        first, here = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))], order
    else:  # different windows share a hash: settle all by their words
        seen: dict[tuple[bytes, int], int] = {}
        first = np.array([seen.setdefault((code[i : i + window].tobytes(), int(salt[k])), k) for k, i in enumerate(at)])
        here = np.arange(len(at))
    place = start[row] + at - (ends - counts)[row]
    differs = (doc[row[first]] != doc[row[here]]) | (tie[row[first]] != tie[row[here]]) | (place[first] != place[here])
    repeated[here] = differs
    head = np.zeros(len(at), dtype=bool)
    head[first] = True
    return row, at, repeated, place, head


def bucket_windows(kmers: DataFrame, window: int) -> DataFrame:
    """Sorts the windows of each bucket. Rows: doc_id, tie, first and last repeated window; for hot buckets also the windows
    that are first in their salt, with their words, for which last is null."""
    schema = "doc_id bigint, tie bigint, first bigint, last bigint, words string"

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole buckets, several together; buckets of one row that can't repeat itself are left out."""
        rest = None
        for batch in batches:
            # Strings of 64-bit offsets: a table of any size is one batch when combined.
            batch = batch.set_column(batch.schema.get_field_index("words"), "words", batch.column("words").cast(pa.large_string()))
            t = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            key = np.asarray(t.column("minimiser")) * 1_000_003 + np.asarray(t.column("salt"))
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            rest = t.slice(cut).to_batches()[0] if cut < t.num_rows else None
            yield from whole(t.slice(0, cut), key[:cut])
        if rest is not None:
            t = pa.Table.from_batches([rest])
            yield from whole(t, np.asarray(t.column("minimiser")) * 1_000_003 + np.asarray(t.column("salt")))

    def whole(t: pa.Table, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        new = np.ones(len(key) + 1, dtype=bool)
        new[1:-1] = key[1:] != key[:-1]
        lonely = new[:-1] & new[1:] & np.asarray(t.column("alone").combine_chunks()) & ~np.asarray(t.column("salted").combine_chunks())
        t, key = t.filter(pa.array(~lonely)), key[~lonely]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        at = 0
        while at < len(key):
            k = np.searchsorted(starts, at + CHUNK_ROWS)
            to = int(starts[k]) if k < len(starts) else len(key)
            yield t.slice(at, to - at).combine_chunks().to_batches()[0]
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            row, at, repeated, place, head = repeated_windows(batch, window)
            marked = np.flatnonzero(repeated)
            go_on = np.zeros(len(marked), dtype=bool)
            go_on[1:] = (marked[1:] == marked[:-1] + 1) & (row[marked[1:]] == row[marked[:-1]])
            begin = np.flatnonzero(~go_on)
            end = np.append(begin[1:], len(marked))[: len(begin)] - 1
            ids, ties = batch.column("doc_id"), batch.column("tie")
            r = pa.array(row[marked[begin]]) if len(marked) else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(r), ties.take(r), pa.array(place[marked[begin]]), pa.array(place[marked[end]]), pa.nulls(len(r), pa.string())], ["doc_id", "tie", "first", "last", "words"])
            salted = np.asarray(batch.column("salted"))
            if salted.any():
                firsts = np.flatnonzero(head & salted[row])
                flat = pc.split_pattern(batch.column("words"), " ").flatten()
                for k in range(0, len(firsts), CHUNK_ROWS):
                    open_ = firsts[k : k + CHUNK_ROWS]
                    index = at[open_][:, None] + np.arange(window)
                    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.arange(len(open_) + 1) * window, pa.int32()), flat.take(pa.array(index.ravel())).cast(pa.string())), " ")
                    r = pa.array(row[open_])
                    yield pa.RecordBatch.from_arrays([ids.take(r), ties.take(r), pa.array(place[open_]), pa.nulls(len(r), pa.int64()), texts], ["doc_id", "tie", "first", "last", "words"])

    dealt = kmers.repartition("minimiser", "salt").sortWithinPartitions("minimiser", "salt", "doc_id", "tie", "start")
    return dealt.mapInArrow(run, schema)


def repeated_spans(texts: DataFrame, window: int = WINDOW, mini: int = MINI, hot: int = HOT) -> DataFrame:
    """doc_id, tie, first, last: runs of windows that also start earlier."""
    bits, salts = survey(texts, window, mini, hot)
    found = staged(bucket_windows(super_kmers(texts, bits, salts, window, mini), window), "kmer-windows")
    spans = found.where("words IS NULL").select("doc_id", "tie", "first", "last")
    if not salts:
        return spans
    kind = Window.partitionBy("words").orderBy("doc_id", "tie", "first")
    later = found.where("words IS NOT NULL").withColumn(P + "nth", F.dense_rank().over(kind)).where(F.col(P + "nth") > 1)
    return spans.unionByName(later.select("doc_id", "tie", "first", F.col("first").alias("last")))


def remove_repeats(docs: DataFrame, window: int = WINDOW, mini: int = MINI, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space), and with with_text kept_text."""
    texts = _texts(docs, id_col, text_col)
    spans = repeated_spans(texts, window, mini, hot).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    spans = spans.withColumnsRenamed({"doc_id": P + "id", "tie": P + "tie"})
    met = texts.join(spans, F.col("doc_id").eqNullSafe(F.col(P + "id")) & (F.col("tie") == F.col(P + "tie")), "left").select("doc_id", "text", "spans")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, removed, sha, kept = Words(part.column(1)), [], [], []
                lists = part.column(2)
                for i in range(part.num_rows):
                    keep = None
                    if lists[i].is_valid:
                        own = lists[i].values
                        first, last = np.asarray(own.field("first")), np.asarray(own.field("last"))
                        mark = np.zeros(int(words.count[i]) + 1, dtype=np.int64)
                        np.add.at(mark, first, 1)
                        np.add.at(mark, last + window, -1)
                        keep = np.cumsum(mark)[:-1] == 0
                    left = words.joined(i, keep)
                    removed.append(0 if keep is None else int((~keep).sum()))
                    sha.append(hashlib.sha256(left).hexdigest())
                    kept.append(left.decode("utf-8", "surrogatepass") if with_text else None)
                columns = [part.column(0), pa.array(words.count), pa.array(removed, pa.int64()), pa.array(sha, pa.string())] + [pa.array(kept, pa.string())] * with_text
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    return met.mapInArrow(run, schema)
