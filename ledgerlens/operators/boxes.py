"""Exact nearest point within one task: a tree of boxes, searched for many queries at a time."""

from __future__ import annotations

import numpy as np

LEAF = 32  # points of a leaf
BEAM = 4  # leaves that give a query its first bound
PAIRS = 100_000  # pairs of query and box, or of query and leaf, that are looked at together


class BoxTree:
    """Points halved along their widest side, level by level, until leaves hold ``LEAF`` of them. Each
    node keeps the box around its points, so that work follows the points near a query and not all
    points, also where the query lies far from all of them."""

    def __init__(self, points: np.ndarray) -> None:
        n, width = points.shape
        self.points = points
        self.depth = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF)))) if n else 0
        order = np.arange(n)
        cuts = np.array([0, n])
        self.least, self.most = [], []
        for level in range(self.depth + 1):
            held = points[order]
            least = np.minimum.reduceat(held, cuts[:-1], axis=0)
            most = np.maximum.reduceat(held, cuts[:-1], axis=0)
            self.least.append(least)
            self.most.append(most)
            if level == self.depth:
                break
            wide = (most - least).argmax(axis=1)
            middle = (cuts[:-1] + cuts[1:]) // 2
            for a, m, b, d in zip(cuts[:-1].tolist(), middle.tolist(), cuts[1:].tolist(), wide.tolist()):
                order[a:b] = order[a:b][np.argpartition(held[a:b, d], m - a)]
            cuts = np.insert(cuts, np.arange(1, len(cuts)), middle)
        size = int(np.diff(cuts).max())
        # leaves of equal size: the last point of a shorter one is repeated
        at = np.minimum(cuts[:-1, None] + np.arange(size), cuts[1:, None] - 1)
        self.member = order[at]
        self.size = np.diff(cuts)
        self.sides = [np.ascontiguousarray(points[:, d][self.member]) for d in range(width)]

    def _gap(self, q: np.ndarray, level: int, node: np.ndarray) -> np.ndarray:
        """Squared distances of queries to boxes, pair by pair."""
        off = np.maximum(self.least[level][node] - q, q - self.most[level][node])
        np.maximum(off, 0, out=off)
        return np.einsum("ij,ij->i", off, off)

    def _leaf(self, q: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the points of a leaf, one row for each pair."""
        out = np.zeros((len(q), self.member.shape[1]))
        for d, side in enumerate(self.sides):
            gap = side[leaf]
            gap -= q[:, d, None]
            gap *= gap
            out += gap
        return out

    def nearest(self, q: np.ndarray, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position or -1, squared distance, points compared) of the nearest point of each query; the
        first position wins a tie. With ``bound`` a point beyond that squared distance need not be found."""
        where, dist, seen = np.full(len(q), -1), np.full(len(q), np.inf), np.zeros(len(q), np.int64)
        step = max(1, PAIRS // (4 * BEAM))
        for i in range(0, len(q), step):
            part = slice(i, i + step)
            where[part], dist[part], seen[part] = self._some(q[part], None if bound is None else bound[part])
        return where, dist, seen

    def _down(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of query and leaf: the ``BEAM`` leaves to which the nearest boxes lead."""
        row, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        for level in range(1, self.depth + 1):
            row, node = np.repeat(row, 2), (2 * node[:, None] + [0, 1]).ravel()
            gap = self._gap(q[row], level, node)
            order = np.lexsort((gap, row))
            row, node = row[order], node[order]
            start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            rank = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
            row, node = row[rank < BEAM], node[rank < BEAM]
        return row, node

    def _some(self, q: np.ndarray, bound: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = len(q)
        where, dist, seen = np.full(m, -1), np.full(m, np.inf), np.zeros(m, np.int64)
        reach = np.full(m, np.inf) if bound is None else bound.copy()
        # distances are taken in another order of addition until the end
        slack = 1e-10 * (1 + np.square(q).sum(axis=1) + np.square(np.maximum(np.abs(self.least[0]), np.abs(self.most[0]))).sum())
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def compare(row: np.ndarray, leaf: np.ndarray) -> None:
            for at in range(0, len(row), PAIRS // 4):
                r, x = row[at : at + PAIRS // 4], leaf[at : at + PAIRS // 4]
                d = self._leaf(q[r], x)
                np.minimum.at(reach, r, d.min(axis=1))
                a, b = np.nonzero(d <= (reach + slack)[r, None])
                found.append((r[a], self.member[x[a], b]))
                np.add.at(seen, r, self.size[x])

        rows = np.arange(m)
        first = np.empty(0, np.int64)
        if bound is None:
            row, node = self._down(q)
            compare(row, node)
            first = row << 40 | node
        # all others within the bound; a part of the pairs at a time, so that they stay few
        open_ = [(0, rows, np.zeros(m, np.int64))]
        while open_:
            level, row, node = open_.pop()
            gap = self._gap(q[row], level, node)
            near = gap <= (reach + slack)[row]
            row, node, gap = row[near], node[near], gap[near]
            if not len(row):
                continue
            if level == self.depth:
                new = ~np.isin(row << 40 | node, first, assume_unique=True)
                row, node, gap = row[new], node[new], gap[new]
                order = np.lexsort((gap, row))
                row, node, gap = row[order], node[order], gap[order]
                done, size = 0, 1
                start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
                rank = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
                while done <= rank.max(initial=-1):
                    # the nearest leaves first, as they may draw the bound in
                    now = (rank >= done) & (rank < done + size) & (gap <= (reach + slack)[row])
                    compare(row[now], node[now])
                    done, size = done + size, size * 2
                continue
            row, node = np.repeat(row, 2), (2 * node[:, None] + [0, 1]).ravel()
            for at in range(0, len(row), PAIRS):
                open_.append((level + 1, row[at : at + PAIRS], node[at : at + PAIRS]))
        if not found:
            return where, dist, seen
        row, at = (np.concatenate(x) for x in zip(*found))
        far = np.square(q[row] - self.points[at]).sum(axis=1)
        order = np.lexsort((at, far, row))
        pick = order[np.unique(row[order], return_index=True)[1]]
        where[row[pick]], dist[row[pick]] = at[pick], far[pick]
        return where, dist, seen
