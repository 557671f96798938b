"""N-gram Jaccard join of documents: distinct shingles of K words, links at a similarity of PERCENT / 100 or more.

1. Every text is lower-cased (A-Z), cut into words and shingled; equal sets become one class (two 64-bit sums tell sets
   apart), represented by the smallest id.
2. Texts that may be similar to another. Of a text's n shingles another that is similar lacks n - ceil(0.8 n) at most. Half of the
   shingles (by one bit) are dealt by hash ranges, 36 bits of each, and each range tells which of its own are in one text only; a text
   with too many of those has no link and goes no further. This holds however large the corpus is; nothing of it is broadcast.
3. Candidate classes. If two sets are similar, their first n - ceil(0.8 n) + 1 shingles, in any order that is the same for
   all, share one. The order puts shingles first that surely occur once among what is left (a bit table of fixed size tells), and the
   common ones last, so that most documents have nothing in their prefix that another could share. Pairs of classes with a prefix
   shingle in common are tied, unless sizes or bitmaps of the sets rule out that they are similar (of a shingle of more than LIST
   classes, all are tied to the smallest); the connected components of these ties hold all links. Only prefixes are written for
   this, a fifth of the shingles at most; whole sets are made again from the texts of classes that are tied to another.
4. Each component is joined by signature trees (see signature_trees), which give a forest of its links. A component beyond
   GROUP classes is first cut into blocks at random, which joins nearly all of its near copies; only what is still apart
   from something that it shares a shingle with goes on, in smaller components. What is left after ROUNDS of that is joined
   shingle by shingle: each one's classes together, in pairs of blocks where more than GROUP have it.
5. Connected components of the links.

No group is in one task, no pairs of a large group are listed, and no candidate or link is left out.

Edge cases: with fewer words than K, the whole sequence is one shingle; without words or text the set is empty and linked
with nothing, each such document being its own component; rows that share an id share a component only if linked; a null id
is smaller than all others and its component's id may be null; an empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, signature_trees
from .common import P, Words, discard, join_groups, maybe_among, mix64, release, slices, staged, staged_at
from .components import components

K, PERCENT = 5, 80
#: Classes that are joined in one task at most; common shingles that are told apart (a bound of what is broadcast).
GROUP, ROUNDS, COMMON = 5_000, 3, 200_000
#: Slots of the table of repeated shingles, as a power of two (64 MB of bits).
TABLE_BITS = 29
#: A shingle is a candidate for the common ones if that many texts of one task have it.
OFTEN = 4
#: High bits of a shingle by which texts that share nothing are told (another's shingle may have the same), and those that deal them out.
KEY_BITS, BUCKET_BITS = 36, 9
BUCKETS = 1 << BUCKET_BITS
#: Classes with one prefix shingle that are paired, at most; more are tied in a star.
LIST = 128


def shingle_sets(words: Words, k: int = K) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, n = words.hashes(), len(words)
    grams = np.zeros(0, dtype=np.uint64)
    for j in range(k):
        part = h[j : max(0, n - k + 1) + j] if n >= k else h[:0]
        grams = mix64(part + np.uint64(j)) if not len(grams) else mix64(grams * np.uint64(0x9E3779B97F4A7C15) + part)
    out = []
    for a, c in zip(words.first[:-1].tolist(), words.count.tolist(), strict=True):
        if c >= k:
            out.append(np.unique(grams[a : a + c - k + 1]))
        elif c:
            g = np.uint64([c])
            for x in h[a : a + c]:
                g = mix64(g * np.uint64(0xD6E8FEB86659FD93) + x)
            out.append(g)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def sums(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell sets apart."""
    a = int(np.add.reduce(mix64(s), dtype=np.uint64)) if len(s) else 0
    b = int(np.add.reduce(mix64(s ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)) if len(s) else 0
    return (a - 2**64 if a >= 2**63 else a), (b - 2**64 if b >= 2**63 else b)


def prefix(s: np.ndarray, table: np.ndarray, common: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """Of the shingles of which two similar sets share one, those that may occur more than once in the corpus. The order is
    that of the hashes, but first come all that surely occur once, and last the common ones by rank."""
    n = len(s)
    if not n:
        return s
    again = s[repeats.maybe_repeated(table, s)]
    left = (n - -(-percent * n // 100) + 1) - (n - len(again))
    if left <= 0:
        return again[:0]
    if len(common):
        at = np.minimum(np.searchsorted(common, again), len(common) - 1)
        again = again[np.argsort(np.where(common[at] == again, rank[at], -1), kind="stable")]
    return again[:left]


def _scan(texts: DataFrame, schema: str, each, finish=None) -> DataFrame:
    """mapInArrow over (doc_id, text): each(part, sets, state) gives batches, finish(state) the last ones of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            for part in slices(batch, "text"):
                yield from each(part, shingle_sets(Words(part.column(1), lower=True)), state)
        if finish is not None:
            yield from finish(state)

    return texts.mapInArrow(run, schema)


def profiles(texts: DataFrame) -> DataFrame:
    """doc_id, n, s1, s2, block, place of each text (a block: texts of one task, place: which of them); and what each block has of the half of
    all shingles that is looked at by uncommon(): rows block, bucket, data (see _packed), and with bucket -1 the block's n. To be staged."""
    names = ["doc_id", "n", "s1", "s2", "block", "place", "bucket", "data"]
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.binary()]

    def rows(count: int, **given) -> pa.RecordBatch:
        made = {c: x if isinstance(x, pa.Array) else pa.array(x, kinds[names.index(c)]) for c, x in given.items()}
        return pa.RecordBatch.from_arrays([made.get(c, pa.nulls(count, kind)) for c, kind in zip(names, kinds, strict=True)], names)

    def tell(state):
        sets = state["sets"]
        values, place = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        half = (values >> np.uint64(20)) & np.uint64(1) == 0
        keys, place = (values[half] >> np.uint64(64 - KEY_BITS)).astype(np.int64), place[half]
        order = np.argsort(keys)
        keys, place = keys[order], place[order]
        cut = np.searchsorted(keys, np.arange(BUCKETS + 1) << (KEY_BITS - BUCKET_BITS))
        told = [(i, _packed(keys[x:y], place[x:y])) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
        told.append((-1, np.array([len(s) for s in sets], dtype="<u4").tobytes()))
        yield rows(len(told), block=[state["block"]] * len(told), bucket=[i for i, _ in told], data=[d for _, d in told])
        state.update(sets=[], held=0, block=state["block"] + 1)

    def each(part, sets, state):
        state.setdefault("block", TaskContext.get().partitionId() << 32)
        for at in range(0, len(sets), 1 << 14):
            some, docs = sets[at : at + (1 << 14)], part.column(0)[at : at + (1 << 14)]
            held = state.setdefault("sets", [])
            found = [sums(s) for s in some]
            first = len(held)
            held += some
            yield rows(len(some), doc_id=docs, n=[len(s) for s in some], s1=[x for x, _ in found], s2=[y for _, y in found], block=[state["block"]] * len(some), place=range(first, len(held)))
            state["held"] = state.get("held", 0) + sum(map(len, some))
            if state["held"] > 4_000_000 or len(held) > 40_000:  # bounded memory, and two bytes a place
                yield from tell(state)

    def finish(state):
        if state.get("sets"):
            yield from tell(state)

    return _scan(texts, "doc_id bigint, n bigint, s1 bigint, s2 bigint, block bigint, place int, bucket int, data binary", each, finish)


def _packed(keys: np.ndarray, place: np.ndarray) -> bytes:
    """Rising keys as their differences, and the place of each, byte by byte of all: high bytes are mostly 0."""
    n = len(keys)
    step = np.diff(keys, prepend=keys[:1]).astype("<u8").view(np.uint8).reshape(n, 8)[:, :5].T.tobytes()
    flat = np.int64([n, keys[0]]).tobytes() + step + place.astype("<u2").view(np.uint8).reshape(n, 2).T.tobytes()
    return len(flat).to_bytes(4, "little") + pa.compress(flat, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = pa.decompress(data[4:], int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)
    n, first = np.frombuffer(flat, dtype="<i8", count=2).tolist()
    step = np.zeros((n, 8), dtype=np.uint8)
    step[:, :5] = np.frombuffer(flat, dtype=np.uint8, count=5 * n, offset=16).reshape(5, n).T
    place = np.ascontiguousarray(np.frombuffer(flat, dtype=np.uint8, offset=16 + 5 * n).reshape(2, n).T).view("<u2").ravel()
    return np.cumsum(step.view("<i8").ravel()) + first, place


def uncommon(told: DataFrame, percent: int) -> DataFrame:
    """block, place of the texts that may be similar to another: at most n - ceil(percent n / 100) of their shingles are surely in no
    other text. Each bucket of keys finds those of its own and tells every block how many each of its texts has."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_bucket(held):
            parts = [_unpacked(d) for _, d in held]
            keys = np.concatenate([k for k, _ in parts])
            order = np.argsort(keys, kind="stable")
            up = keys[order]
            same = up[1:] == up[:-1]
            single = np.ones(len(up), dtype=bool)
            single[1:] &= ~same
            single[:-1] &= ~same
            once = np.empty_like(single)
            once[order] = single
            at, counts = 0, []
            for _, place in parts:
                n = np.minimum(np.bincount(place[once[at : at + len(place)]]), 255).astype(np.uint8).tobytes()
                counts.append(len(n).to_bytes(4, "little") + pa.compress(n, codec="zstd", asbytes=True) if n else None)
                at += len(place)
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in held], pa.int64()), pa.array([-2] * len(held), pa.int32()), pa.array(counts, pa.binary())], ["block", "bucket", "data"])

        now, held = None, []
        for batch in batches:
            for block, bucket, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and held:
                    yield from of_bucket(held)
                    held = []
                now = bucket
                held.append((block, data))
        if held:
            yield from of_bucket(held)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_block(block, size, sums):
            least = -(-percent * size // 100)
            may = np.flatnonzero((size > 0) & (sums <= size - least))
            return pa.RecordBatch.from_arrays([pa.array([block] * len(may), pa.int64()), pa.array(may.astype(np.int32))], ["block", "place"])

        now, sums = None, None
        for batch in batches:
            for block, bucket, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket == -1:  # comes last of its block
                    size = np.frombuffer(data, dtype="<u4").astype(np.int64)
                    yield of_block(block, size, sums[: len(size)] if now == block else np.zeros(len(size), dtype=np.int64))
                elif data is not None:
                    if now != block:
                        now, sums = block, np.zeros(1 << 16, dtype=np.int64)
                    n = np.frombuffer(pa.decompress(data[4:], int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True), dtype=np.uint8)
                    sums[: len(n)] += n

    kind = "block bigint, bucket int, data binary"
    records = told.where("bucket IS NOT NULL").select("block", "bucket", "data")
    counts = records.where("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(alone, kind)
    dealt = counts.unionByName(records.where("bucket = -1")).repartition("block").sortWithinPartitions("block", "bucket")
    return dealt.mapInArrow(total, "block bigint, place int")


def repeats_of(texts: DataFrame) -> DataFrame:
    """Rows with a shingle that is frequent in a task (shingle, n), and a task's part of the table of repeated shingles (chunk, data).
    To be staged."""

    def tell(state):
        value, n = np.unique(np.concatenate(state["sets"]), return_counts=True)
        parts = repeats.task_parts(np.repeat(value, np.minimum(n, 2)), TABLE_BITS)
        often = n >= OFTEN
        few, many = len(parts), int(often.sum())
        columns = [pa.concat_arrays([pa.nulls(few, pa.int64()), pa.array(value[often].view(np.int64))]), pa.concat_arrays([pa.nulls(few, pa.int64()), pa.array(n[often].astype(np.int64))])]
        columns += [pa.array([c for c, _ in parts] + [None] * many, pa.int32()), pa.array([d for _, d in parts] + [None] * many, pa.binary())]
        state.update(sets=[], held=0)
        yield pa.RecordBatch.from_arrays(columns, ["shingle", "n", "chunk", "data"])

    def each(part, sets, state):
        state.setdefault("sets", []).extend(sets)
        state["held"] = state.get("held", 0) + sum(map(len, sets))
        if state["held"] > 8_000_000:  # bounded memory; what is frequent is told by as many texts as that allows
            yield from tell(state)

    def finish(state):
        if state.get("held"):
            yield from tell(state)

    return _scan(texts, "shingle bigint, n bigint, chunk int, data binary", each, finish)


def common_shingles(told: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, at most COMMON, sorted by hash, and their ranks by frequency."""
    top = told.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(COMMON).select("shingle")
    # As Arrow: the partial heads are merged in a task, and the driver gets 8 bytes a shingle.
    value = top.toArrow().column(0).to_numpy().view(np.uint64)
    order = np.argsort(value)
    return value[order], (len(value) - order).astype(np.int64)


def candidates(texts: DataFrame, classes: DataFrame, table: np.ndarray, common: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """node, prefix (its shingles that may be in the prefix of another class), n and sketch of the classes that have such a one."""
    sent = texts.sparkSession.sparkContext.broadcast((table, *common))

    def each(part, sets, state):
        rows, s1, s2, first, size, marks = [], [], [], [], [], []
        for i, s in enumerate(sets):
            p = prefix(s, *sent.value, percent)
            if len(p):
                a, b = sums(s)
                rows.append(i)
                s1.append(a)
                s2.append(b)
                first.append(p.view(np.int64))
                size.append(len(s))
                marks.append(sketch(s))
        if rows:
            columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(size, pa.int64()), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "s1", "s2", "prefix", "n", "sketch"])

    kind = "doc_id bigint, s1 bigint, s2 bigint, prefix array<bigint>, n bigint, sketch binary"
    found = staged(of_classes(_scan(texts, kind, each), classes).select("node", "prefix", "n", "sketch"), "join-candidates")
    sent.destroy()
    return found


def of_classes(found: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows (doc_id, s1, s2) that stand for a class, with its node."""
    same = [F.col(c).eqNullSafe(F.col(P + c)) for c in ("doc_id", "s1", "s2")]
    return found.join(classes.select("node", *[F.col(c).alias(P + c) for c in ("doc_id", "s1", "s2")]), same)


def whole_sets(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """node and set of the classes, from their texts alone; staged."""

    def each(part, sets, state):
        found = [sums(s) for s in sets]
        columns = [part.column(0), pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "s1", "s2", "set"])

    found = _scan(maybe_among(texts, classes, ["doc_id"]), "doc_id bigint, s1 bigint, s2 bigint, set binary", each)
    return staged(of_classes(found, classes).select("node", "set"), "join-sets")


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows (node) with label: that of labels, or the node itself."""
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))


def sketch(s: np.ndarray) -> bytes:
    """A bitmap of a set: n to 2 n bits, a power of two within 64 and 2^14."""
    bits = 1 << min(14, max(6, int(len(s)).bit_length()))
    marks = np.zeros(bits, dtype=bool)
    marks[(s % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(marks, bitorder="little").tobytes()


def may_be_similar(a: tuple[int, bytes], b: tuple[int, bytes], percent: int) -> bool:
    """False only if the sets (size, sketch) surely are not: two sets share at most the bits of both and the smaller excess."""
    (n, x), (m, y) = ((size, np.frombuffer(marks, dtype="<u8")) for size, marks in (a, b))
    if 100 * min(n, m) < percent * max(n, m):
        return False
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    both, in_x, in_y = (int(np.bitwise_count(bits).sum()) for bits in (x & y, x, y))
    return (100 + percent) * (both + min(n - in_x, m - in_y)) >= percent * (n + m)


def postings(found: DataFrame, labels: DataFrame | None) -> DataFrame:
    """node, n, label, shingle of prefix shingles whose nodes have different labels; m: the shingle's smallest node, members: their
    number."""
    told = labelled(found.select("node", "n", F.explode("prefix").alias("shingle")), labels)
    shared = told.groupBy("shingle").agg(F.min("node").alias("m"), F.count(F.lit(1)).alias("members"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return told.join(shared.where("lo < hi").select("shingle", "m", "members"), "shingle")


def ties(found: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """Edges (a, b) between nodes that share a prefix shingle. Of a shingle's nodes each pair with different labels is an edge if sizes
    and sketches allow that it is similar; where more than LIST have it, each is tied to the smallest."""
    rows = postings(found, labels)
    paired = rows.where(F.col("members") <= LIST).select("shingle", "node", "label", "n").repartition("shingle").sortWithinPartitions("shingle", "n", "node")
    pairs = paired.mapInArrow(lambda batches: _pairs(batches, percent), "a bigint, b bigint").distinct()
    marks = found.select("node", "n", "sketch").distinct()  # rows of one id may have one text
    for side in ("a", "b"):
        pairs = pairs.join(marks.select(F.col("node").alias(side), F.struct("n", "sketch").alias(side + "s")), side)
    stars = rows.where(F.col("members") > LIST).where("node <> m").select(F.col("node").alias("a"), F.col("m").alias("b")).distinct()
    return staged(pairs.select("a", "b", "as", "bs").mapInArrow(lambda batches: _similar(batches, percent), "a bigint, b bigint").unionByName(stars), "join-ties")


def _pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (shingle, node, label, n) by shingle and n, the pairs of a shingle whose sizes and labels allow a link."""

    def of(shingle, node, label, n):
        for step in range(1, LIST):
            i = np.flatnonzero(shingle[step:] == shingle[:-step]) if step < len(shingle) else ()
            if not len(i):
                return
            i = i[(label[i] != label[i + step]) & (100 * n[i] >= percent * n[i + step])]
            if len(i):
                both = np.unique(np.sort(np.stack([node[i], node[i + step]]), axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[1]), pa.array(both[0])], ["a", "b"])

    held = [np.zeros(0, dtype=np.int64)] * 4
    for batch in batches:
        held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last shingle may go on
        yield from of(*(h[:cut] for h in held))
        held = [h[cut:] for h in held]
    yield from of(*held)


def _similar(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = ([(x["n"], x["sketch"]) for x in batch.column(c).to_pylist()] for c in (2, 3))
        yield batch.select([0, 1]).filter(pa.array([may_be_similar(x, y, percent) for x, y in zip(one, two, strict=True)], pa.bool_()))


def grouped(edges: DataFrame) -> DataFrame:
    """node, label (its component), members (of the component), for the nodes of the edges."""
    found = staged(components(edges), "join-groups")
    return found.join(found.groupBy("label").agg(F.count(F.lit(1)).alias("members")), "label")


def tree_links(rows: DataFrame, percent: int) -> DataFrame:
    """Joins each group (grp, part) of rows (node, label, set; side 0 or 1, or null for a self-join) and returns links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = {}, None
        for batch in batches:
            d = batch.to_pydict()
            for grp, part, node, label, side, data in zip(*(d[c] for c in ("grp", "part", "node", "label", "side", "set")), strict=True):
                if (grp, part) != key:
                    yield from _joined(held, percent)
                    held, key = {}, (grp, part)
                held[node] = (label, side, np.frombuffer(data, dtype="<u8"))
        yield from _joined(held, percent)

    dealt = rows.select("grp", "part", "node", "label", "side", "set").repartition("grp", "part").sortWithinPartitions("grp", "part", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _joined(held: dict, percent: int) -> Iterator[pa.RecordBatch]:
    if len(held) < 2:
        return
    nodes = list(held)
    sides = [held[n][1] for n in nodes]
    other = None if sides[0] is None else np.array(sides) == 1
    links = signature_trees.join([held[n][2] for n in nodes], np.array([held[n][0] for n in nodes]), percent, other)
    if links:
        yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in links], pa.int64()), pa.array([nodes[j] for _, j in links], pa.int64())], ["a", "b"])


def links_of(found: DataFrame, sets_of, percent: int, group: int) -> DataFrame:
    """A forest of all links between candidate classes. sets_of: gives node and set of the nodes in a table."""
    links, labels, sets, rounds = None, None, None, 0
    while True:
        edges = ties(found, labels, percent)
        if edges.isEmpty():
            break
        release(found.sparkSession)
        if sets is None:
            tied = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            found, sets = found.join(tied, "node", "left_semi"), sets_of(tied)
            release(found.sparkSession)
        blocks = F.ceil(F.col("members") / group)
        block = F.pmod(F.xxhash64("node", F.lit(rounds)), blocks)
        big = True
        if rounds < ROUNDS:
            # Whole components, or random blocks of those that are too large.
            groups = staged(grouped(edges), "join-members")
            big = not groups.where(F.col("members") > group).isEmpty()
            rows = labelled(groups.withColumnRenamed("label", "grp").join(sets, "node"), labels)
            made = tree_links(rows.select("grp", block.alias("part"), "node", "label", F.lit(None).cast("int").alias("side"), "set"), percent)
        else:
            # By shingle. Pairs of blocks: (i, j) with i <= j as part i * blocks + j.
            rows = postings(found, labels).withColumnRenamed("shingle", "grp").join(sets, "node")
            pair = F.transform(F.sequence(F.lit(0).cast("bigint"), blocks - 1), lambda j: F.least(block, j) * blocks + F.greatest(block, j))
            spread = rows.select("grp", F.explode(pair).alias("part"), "node", "label", "set", block.alias("own"), blocks.alias("blocks"))
            low, high = F.floor(F.col("part") / F.col("blocks")), F.col("part") % F.col("blocks")
            side = F.when(low == high, None).when(F.col("own") == low, 0).otherwise(1)
            made = tree_links(spread.select("grp", "part", "node", "label", side.cast("int").alias("side"), "set"), percent)
        made = staged(made, "join-links")
        links = made if links is None else links.unionByName(made)
        if rounds >= ROUNDS or not big:
            break
        # Components that were joined whole are done; the others go on with what the links have told.
        found = found.join(groups.where(F.col("members") > group).select("node"), "node", "left_semi")
        labels = staged(components(links), "join-labels")
        rounds += 1
        release(found.sparkSession)
    return links if links is not None else found.sparkSession.createDataFrame([], "a bigint, b bigint")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spark = docs.sparkSession
    told, told_path = staged_at(profiles(texts), "shingle-profiles")
    may = uncommon(told, percent).withColumn("may", F.lit(True))
    rows = staged(told.where("s1 IS NOT NULL").join(may, ["block", "place"], "left").select("doc_id", "n", "s1", "s2", "may"), "join-rows")
    discard(spark, {told_path})
    release(spark)
    # A class for each set; nulls first, so that min() would skip them.
    classes = rows.where("n > 0").groupBy("s1", "s2").agg(F.min_by("doc_id", F.coalesce("doc_id", F.lit(-(2**63)))).alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.max("may").alias("may"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "join-classes")
    few = classes.where("may")
    some = maybe_among(texts, few, ["doc_id"])
    told, told_path = staged_at(repeats_of(some), "shingle-repeats")
    table, common = repeats.table(told, TABLE_BITS), common_shingles(told)
    discard(spark, {told_path})
    found = candidates(some, few, table, common, percent)
    del table, common
    release(spark)
    linked = components(links_of(found, lambda nodes: whole_sets(texts, classes.join(nodes, "node", "left_semi")), percent, group)).select("node", "label")
    met = classes.join(linked, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = met.groupBy("label").agg(F.min_by("doc_id", F.coalesce("doc_id", F.lit(-(2**63)))).alias("component_id"))
    named = met.join(least, "label").select("s1", "s2", "copies", "component_id")
    with_words = join_groups(rows.where("n > 0"), named, ["s1", "s2"], "copies", rows.count()).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return with_words.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
