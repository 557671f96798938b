"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves whole pre-tokens that are tokens themselves, a batch of
distinct pre-tokens at a time. Tier two: a heap over linked bytes merges the rest, lowest rank first and leftmost on ties. Short
pre-tokens, a heap each, are merged in lockstep.

Edge cases: null text encodes as the empty text (no ids); white space and special-token strings are ordinary text;
texts of any length are encoded whole; repeated rows give repeated results; an empty table gives an empty one; extra
columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, hash_spans, mix64, slices

#: Pre-tokens that a worker remembers; beyond it the memory is emptied and filled anew (speed only, results are the same).
MEMO_ENTRIES = 400_000
#: New pre-tokens that are looked up, and merged in lockstep, at once; and the size classes of the latter in bytes, powers of two.
WORDS_AT_ONCE, LOCKSTEP = 1 << 13, (8, 16, 32)
#: In a heap: no token is made of the place's token and the next.
NO_PAIR = 1 << 62
#: Slots per key at each level of the perfect hash.
GAMMA = 2


def read_ranks(path: str) -> tuple[bytes, ...]:
    """The tokens of a rank file, in order of rank. It is read on the driver; the vocabulary is sent to the executors."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    return tuple(tokens)


def packed(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens' bytes in one buffer (8 spare bytes at its end), their starts and ends."""
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)))
    data = np.frombuffer(b"".join(tokens) + bytes(8), dtype=np.uint8)
    return data, np.concatenate([np.zeros(1, dtype=np.int64), ends[:-1]]) if len(tokens) else ends, ends


def pair_slots(keys: np.ndarray, mask: int) -> np.ndarray:
    return (mix64(keys.astype(np.uint64)) & np.uint64(mask)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash by levels of bit arrays: a key takes the first level at which no other key shares its slot."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        before, left = 0, np.unique(keys)
        if len(left) != len(keys):
            raise ValueError("two keys have one hash")
        while len(left):
            slots = GAMMA * len(left) + 1
            at = self._slots(left, len(self.levels), slots)
            alone = np.bincount(at, minlength=slots) == 1
            self.levels.append((alone, before + np.cumsum(alone) - 1, slots))
            before += int(alone.sum())
            left = left[~alone[at]]
        self.size = before

    @staticmethod
    def _slots(keys: np.ndarray, level: int, slots: int) -> np.ndarray:
        return (mix64(keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(slots)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """A number below size for each key, its own if it is one of the keys; -1 if it surely is not."""
        found, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (alone, rank, slots) in enumerate(self.levels):
            at = self._slots(keys[open_], level, slots)
            hit = alone[at]
            found[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return found


class Codec:
    """Encodes and decodes with the given vocabulary and pre-token pattern."""

    def __init__(self, tokens: tuple[bytes, ...], pattern: str):
        self.tokens, self.find = tokens, regex.compile(pattern).findall
        keys = hash_spans(*packed(list(tokens)))
        self.perfect = PerfectHash(keys)
        self.by_slot = [0] * len(tokens)
        for rank, slot in enumerate(self.perfect(keys).tolist()):
            self.by_slot[slot] = rank
        rank_of = {t: i for i, t in enumerate(tokens)}
        self.narrow = len(tokens) < 1 << 16
        self.byte = [rank_of[bytes([b])] for b in range(256)]
        #: Rank of the token that two tokens make, by their ranks.
        self.pair = {a << 32 | b: i for i, t in enumerate(tokens) for k in range(1, len(t)) if (a := rank_of.get(t[:k])) is not None and (b := rank_of.get(t[k:])) is not None}
        #: The same of two bytes, by their values; and each id as decimal and as a number of 2 or 4 bytes.
        self.bytes = [self.pair.get(a << 32 | b, -1) for a in self.byte for b in self.byte]
        self.one_byte, self.two_bytes = np.array(self.byte, dtype=np.int64), np.array(self.bytes, dtype=np.int64)
        self.pair_keys, self.pair_ranks = self._pair_table()
        self.decimal = list(map(str, range(len(tokens))))
        self.width = np.dtype("<u2" if self.narrow else "<u4")
        self.short = [i.to_bytes(self.width.itemsize, "little") for i in range(len(tokens))]
        self.memo: dict[str, bytes] = {}

    def _pair_table(self) -> tuple[np.ndarray, np.ndarray]:
        """self.pair as arrays: keys (-1: a free slot) and ranks, at most a quarter full."""
        slots = 1 << (4 * len(self.pair) + 1).bit_length()
        keys, ranks = np.full(slots, -1, dtype=np.int64), np.full(slots, -1, dtype=np.int64)
        own = np.fromiter(self.pair, dtype=np.int64, count=len(self.pair))
        taken: dict[int, int] = {}
        for key, at in zip(own.tolist(), pair_slots(own, slots - 1).tolist()):
            while at in taken:
                at = at + 1 & slots - 1
            taken[at] = key
        at = np.fromiter(taken, dtype=np.int64, count=len(taken))
        keys[at] = own
        ranks[at] = np.fromiter(self.pair.values(), dtype=np.int64, count=len(self.pair))
        return keys, ranks

    def merge(self, word: bytes) -> list[int]:
        """The ids of a pre-token: a heap of mergeable neighbours over a linked list of its bytes."""
        byte, pair, two = self.byte, self.pair.get, self.bytes
        ids, n = [byte[b] for b in word], len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [two[a << 8 | b] for a, b in zip(word, word[1:])]
        heap = [r << 40 | i for i, r in enumerate(rank) if r >= 0]
        rank.append(-1)
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, r = top & 0xFFFFFFFFFF, top >> 40
            if rank[i] != r:
                continue  # one of the two has merged with another since
            j = after[i]
            k = after[j]
            ids[i], after[i], rank[j] = r, k, -1
            rank[i] = -1
            if k < n:
                before[k] = i
                if (x := pair(r << 32 | ids[k], -1)) >= 0:
                    rank[i] = x
                    heappush(heap, x << 40 | i)
            if (p := before[i]) >= 0:
                rank[p] = x = pair(ids[p] << 32 | r, -1)
                if x >= 0:
                    heappush(heap, x << 40 | p)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as numbers of self.width: those of one size class in lockstep, longer ones one by one."""
        found = [b""] * len(words)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        least = 0
        for most in LOCKSTEP:
            own = np.flatnonzero((size > least) & (size <= most)).tolist()
            for at in range(0, len(own), WORDS_AT_ONCE):
                part = own[at : at + WORDS_AT_ONCE]
                for i, ids in zip(part, self._lockstep([words[i] for i in part], most), strict=True):
                    found[i] = ids
            least = most
        for i in np.flatnonzero(size > least).tolist():
            found[i] = np.array(self.merge(words[i]), dtype=self.width).tobytes()
        return found

    def _lockstep(self, words: list[bytes], most: int) -> list[bytes]:
        """The same merging as in merge() for words of 1 to most bytes (a power of two), a merge of each word at a time. Words are columns; row most
        stands for no neighbour. A heap has its leaves at the bytes and is built by levels, each node the lower of two; its entries are rank and place,
        so that its top is the lowest rank, and the leftmost on ties."""
        data, starts, ends = packed(words)
        n, none = len(words), len(self.tokens)
        row, size = np.arange(most + 1)[:, None], ends - starts
        raw = data[np.minimum(starts + row, len(data) - 1)].astype(np.int64)
        inside = row < size
        ids = np.where(inside, self.one_byte[raw], none)
        after = np.where(row + 1 < size, row + 1, most)
        before = np.where((row > 0) & inside, row - 1, most)
        rank = self.two_bytes[raw[:-1] << 8 | raw[1:]]
        heap = np.full((most + 1, n), NO_PAIR)
        heap[:-1] = np.where((row[:-1] + 1 < size) & (rank >= 0), rank * most + row[:-1], NO_PAIR)
        ids, after, before, leaf = ids.ravel(), after.ravel(), before.ravel(), heap.ravel()  # row * n + column
        while True:
            level = heap[:-1]
            while len(level) > 1:
                level = np.minimum(level[: len(level) // 2], level[len(level) // 2 :])
            column = np.flatnonzero(level[0] != NO_PAIR)
            if not len(column):
                break
            r, i = np.divmod(level[0][column], most)
            at = i * n + column
            j = after[at]
            k = after[j * n + column]
            p = before[at]
            ids[at], ids[j * n + column], after[at], before[k * n + column] = r, none, k, i
            leaf[j * n + column] = NO_PAIR
            x, y = self._pairs(np.concatenate([r, ids[p * n + column]]), np.concatenate([ids[k * n + column], r])).reshape(2, -1)
            leaf[at] = np.where(x >= 0, x * most + i, NO_PAIR)
            leaf[p * n + column] = np.where(y >= 0, y * most + p, NO_PAIR)
        left = ids.reshape(most + 1, n).T
        stay = left != none
        cuts, flat = [0, *(np.cumsum(stay.sum(axis=1)) * self.width.itemsize).tolist()], left[stay].astype(self.width).tobytes()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that pairs make, -1 for none: open addressing, the next slot after a taken one."""
        key, mask = a << 32 | b, len(self.pair_keys) - 1
        found, open_, slot = np.full(len(key), -1, dtype=np.int64), np.arange(len(key)), pair_slots(key, mask)
        while len(open_):
            got = self.pair_keys[slot]
            hit = got == key[open_]
            found[open_[hit]] = self.pair_ranks[slot[hit]]
            more = np.flatnonzero(~hit & (got >= 0))
            open_, slot = open_[more], slot[more] + 1 & mask
        return found

    def ids(self, words: Sequence[str]) -> list[bytes]:
        """The ids of distinct pre-tokens, as little-endian numbers of self.width."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        slots = self.perfect(hash_spans(*packed(raw))).tolist() if raw else []
        found = [self.short[rank] if slot >= 0 and self.tokens[rank := self.by_slot[slot]] == data else None for data, slot in zip(raw, slots, strict=True)]
        rest = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(rest, self.merge_all([raw[i] for i in rest]), strict=True):
            found[i] = ids
        return found

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def forget(self) -> None:
        """Empties the memory: a worker lives on behind its task, and what it holds is lacking elsewhere."""
        self.memo.clear()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """For each text its ids as little-endian numbers of self.width. What is remembered of a pre-token is of a kind that the garbage
        collector need not walk through."""
        found, memo = [self.find(t) for t in texts], self.memo
        new = set().union(*found).difference(memo)
        if len(memo) + len(new) > MEMO_ENTRIES:
            memo.clear()
            new = set().union(*found)
        for words in batched(new, WORDS_AT_ONCE):
            memo.update(zip(words, self.ids(words)))
        for words in found:
            yield b"".join(map(memo.__getitem__, words))

    def encode_short(self, texts: list[str]) -> Iterator[bytes]:
        """For each text its ids as little-endian 16-bit numbers, which the vocabulary must have room in."""
        if not self.narrow:
            raise ValueError("the vocabulary has more than 2^16 tokens")
        return self.encode(texts)


@lru_cache(maxsize=2)
def codec(tokens: tuple[bytes, ...], pattern: str) -> Codec:
    """One codec per Python worker, kept from task to task."""
    return Codec(tokens, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with with_ids also ids (array of int) and decoded.

    A single pass without a shuffle; the vocabulary (bounded by the file, about 1 MB) goes out once as a broadcast.
    """
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    schema = f"{id_col} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokens.value, pattern)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                count, ids_sha, out_sha, ids_all, texts = [], [], [], [], []
                for got in own.encode(part.column(1).to_pylist()):
                    found = np.frombuffer(got, dtype=own.width)
                    ids = found.tolist()
                    line, raw = " ".join(map(own.decimal.__getitem__, ids)), own.decode(ids)
                    count.append(len(ids))
                    ids_sha.append(hashlib.sha256(line.encode()).hexdigest())
                    out_sha.append(hashlib.sha256(raw).hexdigest())
                    if with_ids:
                        ids_all.append(found.astype(np.int32))
                        texts.append(raw.decode("utf-8", "surrogatepass"))
                columns = [part.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())]
                if with_ids:
                    columns += [pa.array(ids_all, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids)
        own.forget()

    return docs.select(F.col(id_col).cast("bigint").alias(P + "id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
