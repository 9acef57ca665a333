"""An R-tree over counts of hashed tokens, that finds sets which may be alike enough.

A set's tokens are hashed into groups; the counts per group are a point.  Two
sets share at most the sum over groups of the lesser counts, and no member of a
node shares more with a set than the node's greatest counts allow.  So a search
leaves out whole nodes and loses no set that is alike enough.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_FEWEST_GROUPS, _MOST_GROUPS = 64, 4096
_LEAF, _FANOUT = 32, 8


def least_shared(size: int | np.ndarray, other: int | np.ndarray, percent: int):
    """Tokens that sets of these sizes must share to be ``percent`` alike by Jaccard."""
    return -(-percent * (size + other) // (100 + percent))


def alike(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least ``percent``; empty sets are like none."""
    if not len(one) or not len(two) or 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
        return False
    shared = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * shared >= percent * (len(one) + len(two) - shared)


class CountTree:
    """Points of sorted token sets (64-bit hashes), packed so that like sets lie near each other."""

    def __init__(self, sets: Sequence[np.ndarray], percent: int) -> None:
        self.percent = percent
        sizes = np.array([len(x) for x in sets], np.int64)
        # Bands of sizes that may be alike; within one, sets with the same least hash follow each other.
        band = np.floor(np.log(sizes) / np.log(100 / min(percent, 95)))
        self.order = np.lexsort((np.array([x[0] for x in sets], np.uint64), band))
        self.sets, self.sizes = [sets[i] for i in self.order], sizes[self.order]
        groups = _FEWEST_GROUPS
        while groups < min(2 * int(sizes.max()), _MOST_GROUPS):
            groups *= 2
        self.groups = groups
        counts = [self.point(x) for x in self.sets]
        most = max(int(x.max()) for x in counts)
        kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
        self.points = np.stack([x.astype(kind) for x in counts])
        self.levels = [(self.points, self.sizes, self.sizes)]
        for width in (_LEAF, *[_FANOUT] * 64):
            high, low_size, high_size = self.levels[-1]
            starts = np.arange(0, len(high), width)
            self.levels.append(
                (np.maximum.reduceat(high, starts), np.minimum.reduceat(low_size, starts), np.maximum.reduceat(high_size, starts))
            )
            if len(starts) <= _FANOUT:
                break

    def point(self, tokens: np.ndarray) -> np.ndarray:
        return np.bincount((tokens & np.uint64(self.groups - 1)).astype(np.int64), minlength=self.groups)

    def _fitting(self, depth: int, nodes: np.ndarray, point: np.ndarray, size: int) -> np.ndarray:
        """Those of the nodes of a level whose members may be alike enough."""
        high, low_size, high_size = self.levels[depth]
        low, top = low_size[nodes], high_size[nodes]
        fits = (100 * top >= self.percent * size) & (self.percent * low <= 100 * size)
        nodes, low = nodes[fits], low[fits]
        least = least_shared(size, np.maximum(low, -(-self.percent * size // 100)), self.percent)
        return nodes[np.minimum(high[nodes], point).sum(axis=1, dtype=np.uint32) >= least]

    def leaves(self, point: np.ndarray, size: int, before: int) -> np.ndarray:
        """Leaves that may hold sets alike enough among the first ``before`` places."""
        point = np.minimum(point, np.iinfo(self.points.dtype).max).astype(self.points.dtype)
        width = _LEAF * _FANOUT ** (len(self.levels) - 2)
        nodes = np.arange(min(len(self.levels[-1][0]), -(-before // width)))
        for depth in range(len(self.levels) - 1, 0, -1):
            nodes = self._fitting(depth, nodes, point, size)
            if depth > 1:
                width //= _FANOUT
                nodes = (nodes[:, None] * _FANOUT + np.arange(_FANOUT)).ravel()
                nodes = nodes[(nodes < len(self.levels[depth - 1][0])) & (nodes * width < before)]
        return nodes

    def within(self, leaf: int, point: np.ndarray, size: int, before: int) -> np.ndarray:
        """Places in a leaf, below ``before``, of sets that may be alike enough."""
        point = np.minimum(point, np.iinfo(self.points.dtype).max).astype(self.points.dtype)
        return self._fitting(0, np.arange(leaf * _LEAF, min((leaf + 1) * _LEAF, before)), point, size)


def spanning_links(
    sets: Sequence[np.ndarray], percent: int, others: Sequence[np.ndarray] | None = None
) -> Iterator[tuple[int, int]]:
    """Pairs of places of sets alike enough, that connect all that are: at most one less than there are sets.

    With ``others``, pairs of a set (first) and one of the others (second).  Sets
    that are connected already are not held against each other; every surviving
    pair of the search is verified on its tokens.
    """
    if not len(sets) or others is not None and not len(others):
        return
    tree = CountTree(sets, percent)
    number = len(sets)
    asked = tree.sets if others is None else others
    asked_at = np.arange(len(asked)) if others is None else number + np.arange(len(asked))
    root = np.arange(number + (0 if others is None else len(others)))
    starts = np.arange(0, number, _LEAF)
    low = high = root[:0]

    def connect(one: int, two: int) -> None:
        nonlocal low, high
        root[root == max(one, two)] = min(one, two)
        low, high = np.minimum.reduceat(root[:number], starts), np.maximum.reduceat(root[:number], starts)

    low, high = np.minimum.reduceat(root[:number], starts), np.maximum.reduceat(root[:number], starts)
    for at, tokens in zip(asked_at.tolist(), asked, strict=True):
        before = min(at, number)
        point = tree.points[at] if others is None else tree.point(tokens)
        for leaf in tree.leaves(point, len(tokens), before).tolist():
            if low[leaf] == high[leaf] == root[at]:
                continue
            found = tree.within(leaf, point, len(tokens), before)
            found = found[root[found] != root[at]]
            while len(found):
                other = int(found[0])
                found = found[1:]
                if alike(tree.sets[other], tokens, percent):
                    connect(int(root[at]), int(root[other]))
                    yield int(tree.order[other]), int(tree.order[at]) if others is None else at - number
                    found = found[root[found] != root[at]]
