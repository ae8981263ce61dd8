"""Nearest of many unit vectors by inner product, with triangle-inequality bounds."""

from __future__ import annotations

import numpy as np

LEAF = 64
DIGITS = 12


class BallTree:
    """Unit vectors in nested balls; no product of a ball's members with a unit vector u exceeds u . centre + radius."""

    def __init__(self, ids: list, vectors: np.ndarray):
        order = np.argsort(np.array(ids), kind="stable")
        self.ids = np.array(ids)[order]
        self.vectors = vectors[order]
        self.nodes: list[tuple[np.ndarray, float, np.ndarray | None, tuple[int, int]]] = []
        self.root = self._grown(np.arange(len(ids)))

    def _grown(self, members: np.ndarray) -> int:
        """A node over the members (positions, ascending); splits go to the nearer of two that are far apart."""
        waiting, place = [(members, -1, 0)], len(self.nodes)
        while waiting:
            mine, mother, side = waiting.pop()
            x = self.vectors[mine]
            centre = x.mean(axis=0)
            far = np.linalg.norm(x - centre, axis=1)
            here = len(self.nodes)
            if mother >= 0:
                c, r, m, children = self.nodes[mother]
                self.nodes[mother] = c, r, m, (children[0] if side else here, here if side else children[1])
            a = x[far.argmax()]
            b = x[np.linalg.norm(x - a, axis=1).argmax()]
            nearer = np.linalg.norm(x - a, axis=1) < np.linalg.norm(x - b, axis=1)
            if len(mine) <= LEAF or nearer.all() or not nearer.any():
                self.nodes.append((centre, float(far.max()), mine, (-1, -1)))
                continue
            self.nodes.append((centre, float(far.max()), None, (-1, -1)))
            waiting += [(mine[nearer], here, 0), (mine[~nearer], here, 1)]
        return place

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of the vector with the greatest product with each point (ties: least id), and the product."""
        length = np.linalg.norm(points, axis=1)
        unit = points / np.where(length > 0, length, 1)[:, None]
        best, who = np.full(len(points), -np.inf), np.zeros(len(points), np.int64)
        waiting = [(self.root, np.arange(len(points)))]
        while waiting:
            node, rows = waiting.pop()
            centre, radius, members, children = self.nodes[node]
            rows = rows[unit[rows] @ centre + radius >= best[rows] - 10.0**-DIGITS]
            if not len(rows):
                continue
            if members is None:
                gap = [float((unit[rows] @ self.nodes[c][0]).mean()) for c in children]
                for c in np.argsort(gap):  # the likelier one is looked into first
                    waiting.append((children[c], rows))
                continue
            dots = np.round(unit[rows] @ self.vectors[members].T, DIGITS)
            at = dots.argmax(axis=1)
            value, place = dots[np.arange(len(rows)), at], members[at]
            better = (value > best[rows]) | ((value == best[rows]) & (place < who[rows]))
            best[rows[better]], who[rows[better]] = value[better], place[better]
        return who, (points * self.vectors[who]).sum(axis=1)
