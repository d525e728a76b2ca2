"""A tree of cells over unit vectors, with covering radii that bound the similarity of a question to whatever a cell holds."""

from __future__ import annotations

import numpy as np

SLACK = 1e-9


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _means(sample: np.ndarray, count: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Unit centres of a sample by alternating nearest centres and means; far seeds first, so that small clusters get one."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(sample)))]
    closest = sample @ sample[chosen[0]]
    while len(chosen) < count:
        far = 1.0 - closest
        if far.max() <= SLACK:
            break  # no more different vectors
        chosen.append(int(rng.choice(len(sample), p=np.maximum(far, 0) / np.maximum(far, 0).sum())))
        closest = np.maximum(closest, sample @ sample[chosen[-1]])
    centres = sample[chosen]
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > SLACK, sums / np.maximum(length, SLACK), centres)
    return centres


class CellTree:
    """Two levels: nodes, and cells below them. ``place`` may be asked at once; bounds need ``cover`` first."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.centres = _means(sample, max(1, min(cells, len(sample))))
        self.nodes = _means(self.centres, max(1, int(np.sqrt(len(self.centres)))))
        self.parent = (self.centres @ self.nodes.T).argmax(axis=1)
        self.rows = np.zeros(len(self.centres), np.int64)
        self.radius, self.node_radius = np.full(len(self.centres), -1.0), np.full(len(self.nodes), -1.0)

    def place(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each vector, the angles to its centre and to its node's. Not always the nearest cell: radii cover what is placed."""
        node = (units @ self.nodes.T).argmax(axis=1) if len(units) else np.zeros(0, np.int64)
        cell, angle, high = np.zeros(len(units), np.int64), np.zeros(len(units)), np.zeros(len(units))
        for n in np.unique(node):
            own, below = np.flatnonzero(node == n), np.flatnonzero(self.parent == n)
            if not len(below):  # a node that lost its cells to others
                below = np.arange(len(self.centres))
            cosines = units[own] @ self.centres[below].T
            best = cosines.argmax(axis=1)
            cell[own], angle[own] = below[best], _angles(cosines[np.arange(len(own)), best])
        high = _angles((units * self.nodes[self.parent[cell]]).sum(axis=1))
        return cell, angle, high

    def cover(self, cell: int, rows: int, angle: float, high: float) -> None:
        """What a cell holds: how many vectors, and their largest angles to its centre and its node's."""
        self.rows[cell], self.radius[cell] = rows, angle
        node = self.parent[cell]
        self.node_radius[node] = max(self.node_radius[node], high)

    def starts(self) -> np.ndarray:
        """Where each cell's vectors begin when all are laid in a row, cells of a node side by side."""
        order = np.argsort(self.parent, kind="stable")
        starts = np.zeros(len(order), np.int64)
        starts[order] = np.cumsum(self.rows[order]) - self.rows[order]
        return starts

    @staticmethod
    def _bound(cosines: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """The greatest similarity within a radius of the centres; below -1 where a cell is empty."""
        return np.where(radius < 0, -2.0, np.cos(np.maximum(0.0, _angles(cosines) - radius - SLACK)))

    def nearest_filled(self, units: np.ndarray) -> np.ndarray:
        """The filled cell with the nearest centre."""
        cosines = np.where(self.rows > 0, units @ self.centres.T, -2.0)
        return cosines.argmax(axis=1)

    def visits(self, units: np.ndarray, floors: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(vector, cell) pairs that can hold a similarity of at least the vector's floor; ``among`` marks the cells in question."""
        wanted = self.rows > 0 if among is None else (self.rows > 0) & among
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        may = self._bound(units @ self.nodes.T, self.node_radius) >= floors[:, None] - SLACK
        for n in range(len(self.nodes)):
            own, below = np.flatnonzero(may[:, n]), np.flatnonzero((self.parent == n) & wanted)
            if len(own) and len(below):
                q, c = np.nonzero(self._bound(units[own] @ self.centres[below].T, self.radius[below]) >= floors[own][:, None] - SLACK)
                pairs.append((own[q], below[c]))
        return tuple(np.concatenate(x) for x in zip(*pairs))
