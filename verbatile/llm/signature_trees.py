"""Set similarity join within a group by signature trees.

A tree's leaves hold up to LEAF sets, similar ones together; a node holds the OR of its sets' token bitmaps, their range of
sizes, and their largest excess (tokens that share a bit). Two sets below a pair of nodes have at most popcount(AND) plus the
smaller excess tokens in common; the traversal of node pairs drops those whose bound, or range of sizes, cannot reach the
similarity, and those whose sets are linked already. What is left is compared exactly. The result is a forest of links, so
that a group of near copies costs about as many comparisons as it has members.
"""

from __future__ import annotations

import math

import numpy as np

LEAF, FAN = 32, 8


class Forest:
    """Labels of sets; every link joins two of them."""

    def __init__(self, labels: np.ndarray):
        self.root = np.unique(labels, return_inverse=True)[1]
        self.members = {int(r): np.flatnonzero(self.root == r) for r in np.unique(self.root)}
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, j: int) -> None:
        a, b = int(self.root[i]), int(self.root[j])
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        self.root[moved] = a
        self.members[a] = np.concatenate([self.members[a], moved])
        self.links.append((i, j))


def enough(a: int, b: int, both: int, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    return 100 * both >= percent * (a + b - both)


class Tree:
    """Bulk-loaded over sets in an order that keeps similar ones together."""

    def __init__(self, sets: list[np.ndarray], rows: np.ndarray, bits: int):
        self.rows, n = rows, len(rows)
        self.sets = [sets[i] for i in rows]
        self.size = np.array([len(s) for s in self.sets], dtype=np.int64)
        marks = np.zeros((n, bits // 8), dtype=np.uint8)
        for i, s in enumerate(self.sets):
            at = np.unique((s % np.uint64(bits)).astype(np.int64))
            np.bitwise_or.at(marks[i], at >> 3, (1 << (at & 7)).astype(np.uint8))
        self.map = marks.view("<u8")
        self.excess = self.size - np.bitwise_count(self.map).sum(axis=1).astype(np.int64)
        # Levels from the leaves up: bounds of rows, bitmaps, least and most tokens, most excess.
        cut = np.append(np.arange(0, n, LEAF), n)
        self.levels = [self._level(self.map, self.size, self.size, self.excess, cut, cut)]
        while len(self.levels[-1][0]) > 2:
            bounds, maps, least, most, excess = self.levels[-1]
            up = np.append(np.arange(0, len(maps), FAN), len(maps))
            self.levels.append(self._level(maps, least, most, excess, up, bounds[up]))

    @staticmethod
    def _level(maps, least, most, excess, cut, bounds):
        at = cut[:-1]
        return bounds, np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.maximum.reduceat(excess, at)

    def children(self, level: int, node: int) -> range:
        return range(node * FAN, min((node + 1) * FAN, len(self.levels[level - 1][1])))


def bitmap_bits(sizes: np.ndarray) -> int:
    return int(np.clip(2 ** math.ceil(math.log2(max(1, 2 * float(np.median(sizes))))), 512, 1 << 14))


def by_likeness(sets: list[np.ndarray]) -> np.ndarray:
    """An order of sorted, hashed sets in which near copies stand together: their least hashes are mostly the same."""
    return np.array(sorted(range(len(sets)), key=lambda i: (tuple(sets[i][:2].tolist()), len(sets[i]))), dtype=np.int64)


def join(sets: list[np.ndarray], labels: np.ndarray, percent: int = 80, other: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join all sets with different labels whose Jaccard similarity is percent / 100 or more.

    sets: sorted distinct uint64 values. other: None for a self-join, or which sets are of the second side; only pairs across
    the sides are compared then.
    """
    forest = Forest(labels)
    bits = bitmap_bits(np.array([len(s) for s in sets] or [1]))
    order = by_likeness(sets)
    if other is None:
        one = two = Tree(sets, order, bits) if len(order) else None
    else:
        left, right = order[~other[order]], order[other[order]]
        if not len(left) or not len(right):
            return []
        one, two = Tree(sets, left, bits), Tree(sets, right, bits)
    if one is None:
        return []
    todo = [(len(one.levels) - 1, a, len(two.levels) - 1, b) for a in range(len(one.levels[-1][1])) for b in range(len(two.levels[-1][1])) if one is not two or a <= b]
    while todo:
        la, a, lb, b = todo.pop()
        ba, ma, na, xa, ea = (x[a] if k else x for k, x in enumerate(one.levels[la]))
        bb, mb, nb, xb, eb = (x[b] if k else x for k, x in enumerate(two.levels[lb]))
        # Sizes: the smaller set must be percent / 100 of the larger; overlap: at least percent / (100 + percent) of both.
        if 100 * xa < percent * nb or 100 * xb < percent * na:
            continue
        if (100 + percent) * (int(np.bitwise_count(ma & mb).sum()) + min(int(ea), int(eb))) < percent * (int(na) + int(nb)):
            continue
        ra, rb = forest.root[one.rows[ba[a] : ba[a + 1]]], forest.root[two.rows[bb[b] : bb[b + 1]]]
        if ra[0] == rb[0] and (ra == ra[0]).all() and (rb == ra[0]).all():
            continue
        if la or lb:
            down_a = [(la - 1, x) for x in one.children(la, a)] if la >= lb and la else [(la, a)]
            down_b = [(lb - 1, y) for y in two.children(lb, b)] if lb >= la and lb else [(lb, b)]
            # Near pairs last on the stack, so first to be joined.
            pairs = [(i, x, j, y) for i, x in down_a for j, y in down_b if one is not two or i != j or x <= y]
            todo += sorted(pairs, key=lambda p: -abs(p[1] - p[3]))
        else:
            _leaves(one, two, slice(ba[a], ba[a + 1]), slice(bb[b], bb[b + 1]), one is two and a == b, forest, percent)
    return forest.links


def _leaves(one: Tree, two: Tree, sa: slice, sb: slice, same: bool, forest: Forest, percent: int) -> None:
    rows_a, rows_b = one.rows[sa], two.rows[sb]
    both = np.bitwise_count(one.map[sa][:, None, :] & two.map[sb][None, :, :]).sum(axis=2).astype(np.int64)
    most = np.minimum(both + np.minimum(one.excess[sa][:, None], two.excess[sb][None, :]), np.minimum(one.size[sa][:, None], two.size[sb][None, :]))
    may = (100 + percent) * most >= percent * (one.size[sa][:, None] + two.size[sb][None, :])
    if same:
        may &= np.triu(np.ones(may.shape, dtype=bool), 1)
    while True:
        may &= forest.root[rows_a][:, None] != forest.root[rows_b][None, :]
        left = np.argwhere(may)
        if not len(left):
            return
        for x, y in left:
            may[x, y] = False
            s, t = one.sets[sa.start + x], two.sets[sb.start + y]
            if enough(len(s), len(t), len(np.intersect1d(s, t, assume_unique=True)), percent):
                forest.join(int(rows_a[x]), int(rows_b[y]))
                break
