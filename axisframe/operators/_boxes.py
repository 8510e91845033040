"""Nearest points inside a task: a balanced tree of bounding boxes, searched for many places at once."""

from __future__ import annotations

import numpy as np

#: Places searched together, and pairs of a place and a box beyond which they are halved.
BATCH, MOST_PAIRS = 2048, 1 << 21
#: A rounding's breadth, so that no box goes whose point is as near.
BREADTH = 1 + 1e-12


def norm(gaps: np.ndarray) -> np.ndarray:
    """Root of the squares' sum over the last axis, added in order of the dimensions."""
    out = gaps[..., 0] * gaps[..., 0]
    for i in range(1, gaps.shape[-1]):
        out = out + gaps[..., i] * gaps[..., i]
    return np.sqrt(out)


def to_box(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return norm(np.maximum(np.maximum(low - at, at - high), 0.0))


class Tree:
    """Halves of the points along the widest side, down to leaves of at most ``leaf`` points."""

    def __init__(self, points: np.ndarray, leaf: int):
        n = len(points)
        self.depth = max(0, int(np.ceil(np.log2(max(1.0, n / leaf)))))
        order, self.low, self.high, self.split = np.arange(n), [], [], []
        for level in range(self.depth + 1):
            ends = (np.arange((1 << level) + 1) * n) >> level
            at = points[order]
            self.low.append(np.minimum.reduceat(at, ends[:-1]))
            self.high.append(np.maximum.reduceat(at, ends[:-1]))
            if level < self.depth:
                part, dim = np.repeat(np.arange(1 << level), np.diff(ends)), (self.high[-1] - self.low[-1]).argmax(1)
                along = at[np.arange(n), dim[part]]
                sort = np.lexsort((along, part))
                order = order[sort]
                middle = ((np.arange(1 << level) * 2 + 1) * n) >> (level + 1)
                self.split.append((dim, along[sort][middle]))
        self.ends, self.order, self.points = ends, order, points[order]

    def part_of(self, at: np.ndarray) -> np.ndarray:
        """The leaf whose side of all splits a place is on."""
        node = np.zeros(len(at), np.int64)
        for dim, value in self.split:
            node = 2 * node + (at[np.arange(len(at)), dim[node]] >= value[node])
        return node

    def _closer(self, at: np.ndarray, who: np.ndarray, leaf: np.ndarray, best: np.ndarray, rank: np.ndarray) -> None:
        size = self.ends[leaf + 1] - self.ends[leaf]
        who = np.repeat(who, size)
        place = np.arange(len(who)) - np.repeat(np.cumsum(size) - size - self.ends[leaf], size)
        apart = norm(at[who] - self.points[place])
        near = np.flatnonzero(apart <= best[who])
        who, apart, own = who[near], apart[near], self.order[place[near]]
        sort = np.lexsort((own, apart, who))
        who, apart, own = who[sort], apart[sort], own[sort]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else sort
        who, apart, own = who[first], apart[first], own[first]
        won = (apart < best[who]) | (own < rank[who])
        best[who[won]], rank[who[won]] = apart[won], own[won]

    def nearest(self, at: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance and number of each place's nearest point no farther than its bound, the smaller number of equals; len(points) where none is."""
        best, rank = bound.copy(), np.full(len(at), len(self.order))
        todo = [(a, min(a + BATCH, len(at))) for a in range(0, len(at), BATCH)]
        while todo:
            a, b = todo.pop()
            here, d, r = at[a:b], best[a:b], rank[a:b]
            node = np.zeros(b - a, np.int64)
            for low, high in zip(self.low[1:], self.high[1:], strict=True):
                left, right = 2 * node, 2 * node + 1
                node = np.where(to_box(here, low[right], high[right]) < to_box(here, low[left], high[left]), right, left)
            self._closer(here, np.arange(b - a), node, d, r)  # a first point, so that most boxes are too far
            who, node = np.arange(b - a), np.zeros(b - a, np.int64)
            near = to_box(here, self.low[0][node], self.high[0][node])
            for low, high in zip(self.low[1:], self.high[1:], strict=True):
                who, node = np.repeat(who, 2), np.repeat(2 * node, 2)
                node[1::2] += 1
                near = to_box(here[who], low[node], high[node])
                keep = near <= d[who] * BREADTH
                who, node, near = who[keep], node[keep], near[keep]
                if len(who) > MOST_PAIRS and b - a > 1:
                    break
            else:
                sort = np.lexsort((near, who))
                who, node, near = who[sort], node[sort], near[sort]
                first = np.r_[True, who[1:] != who[:-1]] if len(who) else np.zeros(0, bool)
                self._closer(here, who[first], node[first], d, r)
                rest = ~first & (near <= d[who] * BREADTH)
                self._closer(here, who[rest], node[rest], d, r)
                continue
            todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
        return best, rank
