"""Sums of a window relative to a level, by merge-sort trees.

A tree over a bucket has, for every power of two up to the window, the values of its aligned runs in sorted
order with their cumulated sums.  A window is made of at most two runs of each size, and in each a binary
search gives number and sum of the values below a level: O(log^2 w) per row for all rows at once in numpy.
Cumulated sums never cross a run, so a huge value counts only in windows that hold it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Parts:
    """Number and sum of all known values of each window, of those below its level and of those up to it."""

    n: np.ndarray
    total: np.ndarray
    n_below: np.ndarray
    below: np.ndarray
    n_upto: np.ndarray
    upto: np.ndarray

    def areas(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the distances of the values above, and of those below, the level."""
        with np.errstate(invalid="ignore", over="ignore"):
            return (self.total - self.upto) - level * (self.n - self.n_upto), level * self.n_below - self.below


class Tree:
    """Merge-sort tree of an array in which NaN is unknown, for windows of at most ``longest`` rows."""

    def __init__(self, x: np.ndarray, longest: int):
        self.size = 1 << max(0, int(len(x) - 1).bit_length())
        known = ~np.isnan(x)
        self.sorted = np.unique(x[known])
        rank = np.full(self.size, len(self.sorted), np.int64)  # unknown values come last
        rank[: len(x)][known] = np.searchsorted(self.sorted, x[known])
        value = np.zeros(self.size)
        value[: len(x)][known] = x[known]
        count = np.zeros(self.size)
        count[: len(x)] = known
        self.ranks, self.sums, self.counts, self.width = [], [], [], len(self.sorted) + 1
        length = 1
        while True:
            shape = (self.size // length, length)
            order = np.argsort(rank.reshape(shape), axis=1, kind="stable")
            runs = np.arange(shape[0])[:, None]
            # a sum is read at the end of a prefix of a run
            sums = np.zeros((shape[0], length + 1))
            with np.errstate(invalid="ignore", over="ignore"):
                sums[:, 1:] = np.cumsum(np.take_along_axis(value.reshape(shape), order, axis=1), axis=1)
            self.ranks.append((np.take_along_axis(rank.reshape(shape), order, axis=1) + runs * self.width).ravel())
            self.sums.append(sums)
            self.counts.append(count.reshape(shape).sum(axis=1))
            if length >= longest or length == self.size:
                break
            length *= 2

    def parts(self, first: np.ndarray, end: np.ndarray, level: np.ndarray) -> Parts:
        """Of the windows [first, end) and their levels; an unknown level has nothing below it."""
        low = np.searchsorted(self.sorted, level, "left")
        high = np.searchsorted(self.sorted, level, "right")
        out = [np.zeros(len(level)) for _ in range(6)]
        a, b = first.copy(), np.maximum(end, first)
        for k, (ranks, sums, counts) in enumerate(zip(self.ranks, self.sums, self.counts)):
            last = k == len(self.ranks) - 1
            while True:
                open_ = a < b
                left = open_ & ((a & 1 == 1) if not last else True)
                self._add(out, np.flatnonzero(left), a, k, ranks, sums, counts, low, high)
                a = a + left
                right = (a < b) & (b & 1 == 1) if not last else np.zeros(len(a), bool)
                self._add(out, np.flatnonzero(right), b - 1, k, ranks, sums, counts, low, high)
                b = b - right
                if not last or not (a < b).any():
                    break
            a, b = a >> 1, b >> 1
        return Parts(*out)

    def _add(self, out, rows, run, k, ranks, sums, counts, low, high) -> None:
        if not len(rows):
            return
        run = run[rows]
        start = run << k
        with np.errstate(invalid="ignore", over="ignore"):
            out[0][rows] += counts[run]
            out[1][rows] += sums[run, -1]
            for j, bound in ((2, low), (4, high)):
                upto = np.searchsorted(ranks, bound[rows] + run * self.width, "left") - start
                out[j][rows] += upto
                out[j + 1][rows] += sums[run, upto]


def window(n: int, w: int, future: bool) -> tuple[np.ndarray, np.ndarray]:
    """Windows [first, end) of all rows: the last ``w`` rows or the next ``w``, this row included."""
    at = np.arange(n)
    return (at, np.minimum(at + w, n)) if future else (np.maximum(at - w + 1, 0), at + 1)
