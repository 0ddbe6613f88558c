"""Ordering boxes by cutting pages along gaps: all pages of a batch at once, level by level, on groups that still split.

A row carries the dense number of its group; groups are numbered in reading order, and a level replaces a group by its parts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1]


def divided(page: np.ndarray, level: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int | None = None) -> np.ndarray:
    """Groups after all levels.  ``level(rows, groups of these rows)`` gives each row its part, from 0, or -1 if its group stays whole; groups that
    stay whole are not looked at again."""
    group, rows, depth = dense(page), np.arange(len(page)), 0
    while len(rows) and (most is None or depth < most):
        part = level(rows, dense(group[rows]))
        rows, part = rows[part >= 0], part[part >= 0]
        if len(rows):
            own = np.zeros(len(page), np.int64)
            own[rows] = part
            group = dense(group * (own.max() + 1) + own)
        depth += 1
    return group


def _reach(group: np.ndarray, low: np.ndarray, high: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by (group, low, tie), and how far the rows before each reach in its group (NaN for the first)."""
    order = np.lexsort((tie, low, group))
    g = group[order]
    value, rank = np.unique(high[order], return_inverse=True)
    far = np.maximum.accumulate(g * len(value) + rank)  # a later group's numbers are all larger
    before = np.concatenate([[-1], far[:-1]])
    first = np.concatenate([[True], g[1:] != g[:-1]])
    return order, np.where(first, np.nan, value[before % len(value)])


def islands(group: np.ndarray, low: np.ndarray, high: np.ndarray, tie: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's island along one axis, from 0, and the number of islands in its group; an island begins at ``slack`` before the reach or later."""
    order, reach = _reach(group, low, high, tie)
    fresh = np.isnan(reach) | (low[order] >= reach - slack)
    g, number = group[order], np.cumsum(fresh) - 1
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    size = np.diff(np.append(start, len(g)))
    out, many = np.empty(len(g), np.int64), np.empty(len(g), np.int64)
    out[order] = number - np.repeat(number[start], size)
    many[order] = np.repeat(number[start + size - 1] - number[start] + 1, size)
    return out, many


class Sums:
    """Aggregates over groups, told at each of their rows."""

    def __init__(self, group: np.ndarray):
        self.group, self.order = group, np.argsort(group, kind="stable")
        g = group[self.order]
        self.start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))

    def _each(self, how, x: np.ndarray) -> np.ndarray:
        return how.reduceat(x[self.order], self.start)[self.group]

    def max(self, x: np.ndarray) -> np.ndarray:
        return self._each(np.maximum, x)

    def min(self, x: np.ndarray) -> np.ndarray:
        return self._each(np.minimum, x)

    def count(self, x: np.ndarray) -> np.ndarray:
        return self._each(np.add, x.astype(np.int64))

    def extent(self, low: np.ndarray, high: np.ndarray, where: np.ndarray) -> np.ndarray:
        return self.max(np.where(where, high, -np.inf)) - self.min(np.where(where, low, np.inf))


def widest(group: np.ndarray, sums: Sums, low: np.ndarray, high: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A group's widest gap along one axis, 0 for none, and the middle of the first such gap."""
    order, reach = _reach(group, low, high, tie)
    wide, middle = np.zeros(len(low)), np.full(len(low), np.inf)
    wide[order] = np.nan_to_num(np.maximum(low[order] - reach, 0))
    gap = sums.max(wide)
    middle[order] = np.where((wide[order] > 0) & (wide[order] == gap[order]), (reach + low[order]) / 2, np.inf)
    return gap, sums.min(middle)


def banded(group: np.ndarray, y0: np.ndarray, y1: np.ndarray, tie: np.ndarray, share: float) -> np.ndarray:
    """Bands of groups, numbered over all: by top edge, a row joins the band while its centre is nearer than ``share`` of the larger height to the centre
    of the band's first row."""
    order = np.lexsort((tie, y0, group))
    centre, height = ((y0 + y1) / 2)[order].tolist(), (y1 - y0)[order].tolist()
    number, last, out = -1, None, np.empty(len(order), np.int64)
    for at, (g, c, h) in enumerate(zip(group[order].tolist(), centre, height)):
        if g != last or abs(c - first[0]) >= max(h, first[1]) * share:
            number, last, first = number + 1, g, (c, h)
        out[order[at]] = number
    return out
