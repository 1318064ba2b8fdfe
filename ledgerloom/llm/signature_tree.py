"""Signature trees over sets: nodes hold OR-combined token bitmaps and size ranges; a dual traversal prunes node pairs.

Of a set x with bitmap b(x), every bit that y lacks stands for at least one token that y lacks, so that
|x and y| <= |x| - bits(b(x) & ~b(y)). For nodes A and B this gives, with slack = max(|x| - bits(b(x))) over a node's sets,
|x and y| <= slack(A) + bits(OR(A) & OR(B)), and the same from B's side. A pair of nodes is dropped when the largest possible overlap
is below what the smallest sizes need, or when their size ranges are too far apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FANOUT = 8


def width_of(n: int) -> int:
    """Bits of the bitmap of a set of n tokens: a power of two, one to two for each token, 64 to 65536."""
    return min(1 << 16, max(64, 1 << int(max(n, 1) - 1).bit_length()))


def bitmap(tokens: np.ndarray, width: int) -> np.ndarray:
    """The bitmap as 64-bit words; a token's bit is its low bits, so that a wider bitmap folds into a narrower one by OR."""
    out = np.zeros(width // 64, dtype=np.uint64)
    at = tokens & np.uint64(width - 1)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, width // 64), axis=0) if bits.size * 64 > width else bits


def needed(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least overlap of sets of a and b tokens with similarity of at least num / den (in whole numbers)."""
    return -(-(num * (a + b)) // (num + den))


class SignatureTree:
    """A tree over sets of one bitmap width, in the order of their sizes. The lowest level holds the sets themselves."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.order = np.lexsort([bits[:, 0], sizes]) if len(sizes) else np.zeros(0, dtype=np.int64)
        sizes, bits = sizes[self.order], bits[self.order]
        self.levels = [(bits, sizes, sizes, sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][0]) > FANOUT:
            bits, low, high, slack = self.levels[-1]
            at = np.arange(0, len(bits), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether some pair of sets under nodes i and j may be similar enough."""
        bits, low, high, slack = self.levels[level]
        near = (den * high[i] >= num * low[j]) & (den * high[j] >= num * low[i])
        at = np.flatnonzero(near)
        common = np.bitwise_count(bits[i[at]] & bits[j[at]]).sum(axis=1, dtype=np.int64)
        most = common + np.minimum(slack[i[at]], slack[j[at]])
        near[at] = most >= needed(low[i[at]], low[j[at]], num, den)
        return near

    def pairs(self, num: int, den: int, joined=None, part: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets (their places in the input) that the bounds can't rule out, some at a time.

        joined(x, y) may say which pairs need no look because they are connected already."""
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        stack = [(top, *np.triu_indices(n, 0 if top else 1))]
        while stack:
            level, i, j = stack.pop()
            if len(i) > part:
                stack += [(level, i[k : k + part], j[k : k + part]) for k in range(0, len(i), part)][::-1]
                continue
            if level == 0 and joined is not None:
                new = ~joined(self.order[i], self.order[j])
                i, j = i[new], j[new]
            ok = self.possible(level, i, j, num, den)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if level == 0:
                yield self.order[i], self.order[j]
                continue
            below = len(self.levels[level - 1][0])
            a = (i[:, None, None] * FANOUT + np.arange(FANOUT)[None, :, None]) + np.zeros((1, 1, FANOUT), dtype=np.int64)
            b = (j[:, None, None] * FANOUT + np.arange(FANOUT)[None, None, :]) + np.zeros((1, FANOUT, 1), dtype=np.int64)
            a, b = a.ravel(), b.ravel()
            ok = (a < below) & (b < below) & ((a < b) if level == 1 else (a <= b))
            stack.append((level - 1, a[ok], b[ok]))


class Links:
    """Union-find over positions."""

    def __init__(self, labels: list):
        first: dict = {}
        self.up = np.array([first.setdefault(x, i) for i, x in enumerate(labels)], dtype=np.int64)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def bands(sizes: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, int]]:
    """(places, width): sets of one bitmap width, with those of wider bitmaps that are near enough in size. Every possible pair is in a band."""
    widths = np.array([width_of(int(n)) for n in sizes])
    for width in np.unique(widths):
        own = widths == width
        yield np.flatnonzero(own | ((widths > width) & (num * sizes <= den * sizes[own].max()))), int(width)


def candidates(sizes: np.ndarray, bits: list[np.ndarray], num: int, den: int, links: Links) -> Iterator[tuple[int, int]]:
    """Pairs of sets that may be similar and aren't connected in links yet; the caller joins those that it accepts."""
    for at, width in bands(sizes, num, den):
        tree = SignatureTree(sizes[at], np.stack([folded(bits[i], width) for i in at]))

        def joined(x, y, at=at):
            roots = links.roots()
            return roots[at[x]] == roots[at[y]]

        for x, y in tree.pairs(num, den, joined):
            for i, j in zip(at[x].tolist(), at[y].tolist(), strict=True):
                if links.find(i) != links.find(j):
                    yield i, j
