"""Gray-order hierarchical index over 64-bit fingerprints, in numpy.

Fingerprints in Gray order share most bits with their neighbours. Runs of them
form leaf nodes, runs of nodes form upper nodes up to one root a group; a node
keeps the bits that all fingerprints below it share (a masked pattern).

The search descends pairs of nodes, a bounded number at a time. A pair brings the
differences found so far and the bits they were counted in; only bits that both nodes
share and that no pair above has compared are added. When the sum exceeds the limit,
everything below the pair is pruned. When the bits not compared yet can't lift it above the
limit, everything below is linked without a look (not where pairs have to be
checked by a sketch as well). Pairs whose fingerprints are already in one component
are left out, so dense groups never come to all their pairs.

Many groups are searched at once: a forest has one tree a group, and group sizes of
two and of thousands take the same way.
"""

from __future__ import annotations

import numpy as np

#: Fingerprints under a leaf node, nodes under an upper node, and node pairs opened at a time.
LEAF, FAN, PAIRS = 8, 4, 1 << 13


def gray_ranks(fps: np.ndarray) -> np.ndarray:
    """Places of unsigned fingerprints in the Gray sequence."""
    out = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class Forest:
    """Trees over fingerprints that are sorted by tree and, within one, by Gray rank."""

    def __init__(self, trees: np.ndarray, fps: np.ndarray):
        self.fps = fps
        starts = np.flatnonzero(np.concatenate(([True], trees[1:] != trees[:-1])))
        sizes = np.diff(np.append(starts, len(trees)))
        #: By level, leaf nodes first: first fingerprint of each node (and the end), bits that are one, bits that are shared, first child (and the end).
        self.first: list[np.ndarray] = []
        self.ones: list[np.ndarray] = []
        self.shared: list[np.ndarray] = []
        self.child: list[np.ndarray] = []
        begin, sizes, at = starts, sizes, np.append(np.arange(len(fps)), len(fps))
        ones, some, width = fps, fps, LEAF
        while not self.first or len(self.ones[-1]) > len(starts):
            count = -(-sizes // width)
            # A node takes the next `width` nodes of its tree, the last what is left.
            place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            edge = np.append(np.repeat(begin, count) + place * width, len(ones))
            ones, some = np.bitwise_and.reduceat(ones, edge[:-1]), np.bitwise_or.reduceat(some, edge[:-1])
            at = at[edge]
            self.first.append(at)
            self.ones.append(ones)
            self.shared.append(~(ones ^ some))
            self.child.append(edge)
            begin, sizes, width = np.cumsum(count) - count, count, FAN
        # Leaves in rows of one length; a place without a fingerprint repeats the last.
        first, ends = self.first[0][:-1], self.first[0][1:]
        self.rows = np.minimum(first[:, None] + np.arange(LEAF), ends[:, None] - 1)
        self.filled = np.arange(LEAF) < (ends - first)[:, None]
        self.leaves = fps[self.rows]

    @property
    def top(self) -> int:
        return len(self.ones) - 1


class Search:
    """Links among the fingerprints of a forest: ``run`` gives index pairs that connect whatever is within ``bits``.

    With ``sketches`` (rows of 64-bit words) a pair also needs at least ``agree`` equal sketch bits.
    ``pruned`` counts node pairs cut off at each level.
    """

    def __init__(self, forest: Forest, bits: int, sketches: np.ndarray | None = None, agree: int = 0):
        self.forest, self.bits, self.sketches, self.agree = forest, bits, sketches, agree
        self.label = np.arange(len(forest.fps))
        self.pruned = [0] * len(forest.ones)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self._one: dict[int, np.ndarray] = {}

    def run(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Search below the given pairs of roots; a root with itself stands for all pairs below it."""
        top = self.forest.top
        work = [(top, x, y, *self._compared(top, x, y, np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint64)))]
        while work:
            level, x, y, sums, seen = work.pop()
            if len(x) > PAIRS:
                work.append((level, x[PAIRS:], y[PAIRS:], sums[PAIRS:], seen[PAIRS:]))
                x, y, sums, seen = x[:PAIRS], y[:PAIRS], sums[:PAIRS], seen[:PAIRS]
            near = sums <= self.bits
            self.pruned[level] += int(len(near) - near.sum())
            near &= ~self._joined(level, x, y)
            if self.sketches is None:
                # What is not compared yet can't part them any more.
                whole = near & (np.bitwise_count(~seen) + sums <= self.bits)
                self._link_whole(level, x[whole], y[whole])
                near &= ~whole
            x, y, sums, seen = x[near], y[near], sums[near], seen[near]
            if not len(x):
                continue
            if level == 0:
                self._leaves(x, y)
                continue
            above, x, y = self._below(level, x, y)
            work.append((level - 1, x, y, *self._compared(level - 1, x, y, sums[above], seen[above])))
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in self.found]), np.concatenate([b for _, b in self.found])

    def _compared(self, level: int, x: np.ndarray, y: np.ndarray, sums: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Differences and compared bits of node pairs, given those of the pairs above."""
        both = self.forest.shared[level][x] & self.forest.shared[level][y]
        return sums + np.bitwise_count((self.forest.ones[level][x] ^ self.forest.ones[level][y]) & both & ~seen), seen | both

    def _below(self, level: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs of children, each pair once, with the place of the pair above."""
        child = self.forest.child[level]
        wide, high = child[x + 1] - child[x], child[y + 1] - child[y]
        count = wide * high
        above = np.repeat(np.arange(len(x)), count)
        place = np.arange(len(above)) - np.repeat(np.cumsum(count) - count, count)
        a, b = child[x][above] + place // high[above], child[y][above] + place % high[above]
        kept = (x != y)[above] | (a <= b)
        return above[kept], a[kept], b[kept]

    def _joined(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether all fingerprints below a pair are in one component already."""
        if not self._one:
            for k in range(len(self.forest.ones)):
                first = self.forest.first[k][:-1]
                low, high = np.minimum.reduceat(self.label, first), np.maximum.reduceat(self.label, first)
                self._one[k] = np.where(low == high, low, -1 - np.arange(len(first)))
        one = self._one[level]
        return (one[x] >= 0) & (one[x] == one[y])

    def _link_whole(self, level: int, x: np.ndarray, y: np.ndarray) -> None:
        """Link all fingerprints below each pair."""
        if not len(x):
            return
        first = self.forest.first[level]
        apart = x != y
        # Those below one node are linked in a row; a pair of nodes by one link, for each of both links its own.
        size = first[x[~apart] + 1] - first[x[~apart]] - 1
        row = np.repeat(first[x[~apart]], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        self._join(np.concatenate((first[x[apart]], row)), np.concatenate((first[y[apart]], row + 1)))

    def _leaves(self, x: np.ndarray, y: np.ndarray) -> None:
        """Compare the fingerprints below pairs of leaf nodes."""
        f = self.forest
        distance = np.bitwise_count(f.leaves[x][:, :, None] ^ f.leaves[y][:, None, :])
        p, i, j = np.nonzero(distance <= self.bits)
        real = f.filled[x[p], i] & f.filled[y[p], j]
        p, i, j = p[real], i[real], j[real]
        a, b = f.rows[x[p], i], f.rows[y[p], j]
        real = (self.label[a] != self.label[b]) & ((x[p] != y[p]) | (a < b))
        a, b = a[real], b[real]
        if self.sketches is not None and len(a):
            equal = 64 * self.sketches.shape[1] - np.bitwise_count(self.sketches[a] ^ self.sketches[b]).sum(axis=1, dtype=np.int64)
            # The most similar first: they are the links that stay.
            order = np.argsort(-equal, kind="stable")[: int((equal >= self.agree).sum())]
            a, b = a[order], b[order]
        self._join(a, b)

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join components; links that join nothing are forgotten. Labels are the smallest place of a component."""
        label = self.label
        while len(a):
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            apart = low != high
            if not apart.any():
                return
            a, b, low, high = a[apart], b[apart], low[apart], high[apart]
            upper, at = np.unique(high, return_index=True)
            label[upper] = low[at]
            self.found.append((a[at], b[at]))
            self._one.clear()
            while not np.array_equal(up := label[label], label):
                label[:] = up
