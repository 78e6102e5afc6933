"""T-occurrence search by DivideSkip over an in-memory inverted index.

For a query of which a record must share at least T elements, the query's L longest lists are set aside. A record that
shares T elements is on at least T - L of the short lists, which are merged; each record found there is then looked up
by binary search in the long lists.
"""

from __future__ import annotations

import heapq
import math
from itertools import groupby

import numpy as np

#: Weight of a merged list's logarithmic length in the choice of L.
MU = 0.02
#: Other sets' postings up to which short lists are merged with a heap; more are sorted and counted at once, which gives the same counts.
HEAP = 1024
#: Binary searches made at once.
PROBES = 1 << 20


def overlap(a: int, b: int, percent: int) -> int:
    """Least number of common elements of sets of sizes a and b at which 100 * |intersection| >= percent * |union|."""
    return -(-percent * (a + b) // (100 + percent))


def least_size(n: int, percent: int) -> int:
    return -(-percent * n // 100)


class Index:
    """Inverted lists of sets, each sorted and without repetition; sets in ascending order of size."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.at = np.r_[0, np.cumsum(self.sizes)]
        every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(self.n), self.sizes)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]] if len(ranked) else np.empty(0, bool)
        of = np.cumsum(new) - 1
        self.list_of = np.empty(len(every), np.int64)
        self.list_of[order] = of
        self.begin = np.r_[np.flatnonzero(new), len(every)]
        self.postings = owner[order]
        self.keys = of * max(1, self.n) + self.postings

    def search(self, i: int, low: int, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Divide: sets from low up to i that are on enough of the short lists, their counts there, and the long lists."""
        lists = self.list_of[self.at[i] : self.at[i + 1]]
        lengths = self.begin[lists + 1] - self.begin[lists]
        order = np.argsort(lengths, kind="stable")
        skip = min(need - 1, int(need / (MU * math.log2(int(lengths.max()) + 1) + 1)))
        short, long_ = lists[order[: len(lists) - skip]], lists[order[len(lists) - skip :]]
        short = short[lengths[order[: len(lists) - skip]] > 1]  # the others hold this set alone
        begin = np.searchsorted(self.keys, short * self.n + low)
        count = np.searchsorted(self.keys, short * self.n + i) - begin
        begin, count = begin[count > 0], count[count > 0]
        total = int(count.sum())
        if total <= HEAP:
            runs = [self.postings[b : b + c].tolist() for b, c in zip(begin.tolist(), count.tolist(), strict=True)]
            found = [(k, sum(1 for _ in g)) for k, g in groupby(heapq.merge(*runs))]
            ids, counts = np.array([k for k, _ in found], np.int64), np.array([c for _, c in found], np.int64)
        else:
            place = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(total)
            ids, counts = np.unique(self.postings[place], return_counts=True)
        keep = counts >= need - skip
        return ids[keep], counts[keep], long_

    def probe(self, ids: np.ndarray, long_: np.ndarray) -> np.ndarray:
        """Skip: on how many of the long lists each id is."""
        hit = np.zeros(len(ids), np.int64)
        if not len(long_):
            return hit
        step = max(1, PROBES // len(long_))
        for k in range(0, len(ids), step):
            wanted = (long_[:, None] * self.n + ids[None, k : k + step]).ravel()
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit[k : k + step] = (self.keys[at] == wanted).reshape(len(long_), -1).sum(0)
        return hit


def forest(sets: list[np.ndarray], percent: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets that join all that are linked, directly or through others: a spanning forest, as pairs of places in ``sets``.

    With ``sides``, only links between different sides are looked for. A set is compared with those of its own tree no
    more, so a large group of near copies costs little more than its size.
    """
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    index = Index([sets[k] for k in order])
    tree = np.arange(index.n)
    members: dict[int, list[int]] = {}
    side = None if sides is None else np.asarray(sides)[order]
    out: list[tuple[int, int]] = []
    for i in range(index.n):
        n = int(index.sizes[i])
        if not n:
            continue
        low = int(np.searchsorted(index.sizes, least_size(n, percent)))
        if low >= i:
            continue
        need = overlap(n, int(index.sizes[low]), percent)
        ids, counts, long_ = index.search(i, low, need)
        keep = tree[ids] != tree[i]
        if side is not None:
            keep &= side[ids] != side[i]
        ids, counts = ids[keep], counts[keep]
        if not len(ids):
            continue
        shared = counts + index.probe(ids, long_)
        for j in ids[(100 + percent) * shared >= percent * (n + index.sizes[ids])]:
            a, b = int(tree[i]), int(tree[j])
            if a != b:
                first, second = members.pop(a, [a]), members.pop(b, [b])
                if len(first) < len(second):  # the smaller tree takes the other's name
                    a, first, second = b, second, first
                tree[second] = a
                first += second
                members[a] = first
                out.append((order[i], order[int(j)]))
    return out
