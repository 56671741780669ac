"""Dual-tree search over two in-memory point sets, breadth first and vectorised.

Each set is sorted along a Z curve and cut into 2**depth runs; the bounding boxes of
the runs and of their pairwise unions form a binary tree.  Pairs of nodes descend
together: pairs farther apart than the radius are dropped, pairs that lie wholly
within it are accepted without looking at their points, the rest is split, and only
undecided leaves compare points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 8
#: Point pairs handled at once.
BATCH = 2_000_000


def _spread(v: np.ndarray) -> np.ndarray:
    v = v & np.uint64(0xFFFFFFFF)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


class Tree:
    """Points in Z order with the boxes of every level; level k has 2**k nodes."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int, origin: tuple[float, float], unit: float):
        key = _spread(((x - origin[0]) / unit).astype(np.uint64)) | (_spread(((y - origin[1]) / unit).astype(np.uint64)) << np.uint64(1))
        self.order = np.argsort(key, kind="stable")
        self.x, self.y = x[self.order], y[self.order]
        n = len(x)
        self.cuts = (np.arange(2**depth + 1, dtype=np.int64) * n) >> depth
        full = self.cuts[1:] > self.cuts[:-1]
        box = np.empty((2**depth, 4))
        box[:] = (np.inf, np.inf, -np.inf, -np.inf)
        if n:
            at = self.cuts[:-1][full]
            box[full] = np.stack([np.minimum.reduceat(self.x, at), np.minimum.reduceat(self.y, at), np.maximum.reduceat(self.x, at), np.maximum.reduceat(self.y, at)], 1)
        self.boxes = [box]
        while len(self.boxes[0]) > 1:
            b = self.boxes[0]
            self.boxes.insert(0, np.concatenate([np.minimum(b[::2, :2], b[1::2, :2]), np.maximum(b[::2, 2:], b[1::2, 2:])], 1))
        self.depth = depth

    def runs(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = self.depth - level
        return self.cuts[nodes << step], self.cuts[(nodes + 1) << step]


def _expand(a0, a1, b0, b1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with a0 <= i < a1 and b0 <= j < b1 of each run pair, in batches."""
    width = b1 - b0
    # one row per (run pair, i): a run pair of any size is cut into rows first
    rows = np.repeat(np.arange(len(a0)), a1 - a0)
    i_all = np.arange(len(rows)) - np.repeat(np.cumsum(a1 - a0) - (a1 - a0), a1 - a0) + a0[rows]
    ends = np.cumsum(width[rows])
    start = 0
    while start < len(rows):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + BATCH, "right")))
        r = rows[start:stop]
        w = width[r]
        i = np.repeat(i_all[start:stop], w)
        j = np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(b0[r], w)
        yield i, j
        start = stop


def _descend(a: Tree, b: Tree, same: bool, radius: float) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(sure, a0, a1, b0, b1): runs of points accepted wholesale, then undecided leaves."""
    i = j = np.zeros(1, np.int64)
    for level in range(a.depth + 1):
        p, q = a.boxes[level][i], b.boxes[level][j]
        with np.errstate(invalid="ignore"):
            gap = np.maximum(0, np.maximum(p[:, :2] - q[:, 2:], q[:, :2] - p[:, 2:]))
            far = np.maximum(p[:, 2:] - q[:, :2], q[:, 2:] - p[:, :2])
            near = (gap**2).sum(1) <= radius**2
            # a hair under the radius, so that no rounding of the squares accepts a pair too many
            sure = near & ((far**2).sum(1) <= radius**2 * (1 - 1e-12)) & (far > -np.inf).all(1)
        if sure.any():
            yield True, *a.runs(level, i[sure]), *b.runs(level, j[sure])
        open_ = near & ~sure
        i, j = i[open_], j[open_]
        if level < a.depth and len(i):
            i, j = np.repeat(i * 2, 4) + np.tile([0, 0, 1, 1], len(i)), np.repeat(j * 2, 4) + np.tile([0, 1, 0, 1], len(j))
            if same:
                keep = i <= j
                i, j = i[keep], j[keep]
        if not len(i):
            return
    yield False, *a.runs(a.depth, i), *b.runs(b.depth, j)


def _trees(xa, ya, xb, yb) -> tuple[Tree, Tree]:
    same = xb is None
    origin = (xa.min(), ya.min()) if same else (min(xa.min(), xb.min()), min(ya.min(), yb.min()))
    top = max(xa.max() - origin[0], ya.max() - origin[1], *(() if same else (xb.max() - origin[0], yb.max() - origin[1])))
    unit = max(top / 2**31, 1e-9)
    n = max(len(xa), 0 if same else len(xb))
    depth = max(0, int(np.ceil(np.log2(max(1, n) / LEAF))))
    a = Tree(xa, ya, depth, origin, unit)
    return a, a if same else Tree(xb, yb, depth, origin, unit)


def pairs(xa, ya, radius: float, xb=None, yb=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at most ``radius`` apart: within one set (each pair once), or across two."""
    if not len(xa) or (xb is not None and not len(xb)):
        return
    a, b = _trees(xa, ya, xb, yb)
    same = xb is None
    for sure, a0, a1, b0, b1 in _descend(a, b, same, radius):
        for i, j in _expand(a0, a1, b0, b1):
            keep = i < j if same else None
            if not sure:
                near = (a.x[i] - b.x[j]) ** 2 + (a.y[i] - b.y[j]) ** 2 <= radius**2
                keep = near if keep is None else keep & near
            if keep is not None:
                i, j = i[keep], j[keep]
            if len(i):
                yield a.order[i], b.order[j]


def links(x, y, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join the same points as :func:`pairs` does, without all pairs of dense spots.

    Two runs accepted wholesale are linked by a star each way instead of by all pairs.
    """
    if not len(x):
        return
    t, _ = _trees(x, y, None, None)
    for sure, a0, a1, b0, b1 in _descend(t, t, True, radius):
        if sure:
            for i, j in (*_expand(a0, a0 + 1, b0, b1), *_expand(a0, a1, b0, b0 + 1)):
                yield t.order[i], t.order[j]
        else:
            for i, j in _expand(a0, a1, b0, b1):
                keep = (i < j) & ((t.x[i] - t.x[j]) ** 2 + (t.y[i] - t.y[j]) ** 2 <= radius**2)
                yield t.order[i[keep]], t.order[j[keep]]


def components(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index of each index's component, by hooking and pointer jumping."""
    root = np.arange(n)
    for i, j in found:
        while len(i):
            i, j = root[i], root[j]
            open_ = i != j
            i, j = np.maximum(i, j)[open_], np.minimum(i, j)[open_]
            np.minimum.at(root, i, j)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root
