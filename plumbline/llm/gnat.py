"""A multiway tree of split points over whole-number vectors, with distance ranges between siblings.

Every row of a node goes to its nearest split point (the space is cut by the
hyperplanes between them).  A split point stores, for each sibling's subtree,
the smallest and largest distance from itself to a row there.  A query with a
window of wanted distances drops a subtree when, by any split point, all its
rows must lie inside or outside the window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FANOUT = 16
SLACK = 1e-9  # relative, for roots of exact squares


def squares(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances: whole numbers, exact below 2^53."""
    return (rows * rows).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2.0 * (rows @ points.T)


@dataclass
class Gnat:
    """``points[n]``: split points of node n; ``children[n]``: node number per point, or -1 - leaf; node 0 is the root."""

    points: list[np.ndarray]
    children: list[list[int]]
    leaves: int
    # squared distances [child, point] per node, squared lengths and label bits per child; filled by ``learn``
    near: list[np.ndarray] | None = None
    far: list[np.ndarray] | None = None
    short: list[np.ndarray] | None = None
    long: list[np.ndarray] | None = None
    bits: list[np.ndarray] | None = None

    @classmethod
    def fit(cls, sample: np.ndarray, leaf_rows: int, fanout: int = FANOUT) -> Gnat:
        """Split points from a sample; a leaf holds at most ``leaf_rows`` of it, or rows that are all equal."""
        points, children, leaves = [], [], 0
        todo = [(np.arange(len(sample)), -1, -1)]
        while todo:
            rows, parent, child = todo.pop()
            chosen, away = [], np.full(len(rows), np.inf)
            wanted = min(fanout, len(rows), 1 - -len(rows) // leaf_rows)  # no more than the leaves it takes, and one
            while len(chosen) < max(2, wanted) and (not chosen or away.max() > 0) and len(rows):
                chosen.append(int(np.argmax(away)) if chosen else 0)
                away = np.minimum(away, squares(sample[rows], sample[rows[chosen[-1:]]])[:, 0])
            if parent >= 0 and len(chosen) < 2:
                children[parent][child] = -1 - leaves
                leaves += 1
                continue
            at = len(points)
            if parent >= 0:
                children[parent][child] = at
            spots = sample[rows[chosen]] if chosen else np.zeros((1, sample.shape[1]))
            points.append(spots)
            children.append([0] * len(spots))
            own = np.argmin(squares(sample[rows], spots), axis=1) if len(rows) else np.zeros(0, int)
            for j in range(len(spots)):
                part = rows[own == j]
                if len(part) > leaf_rows and len(part) < len(rows):
                    todo.append((part, at, j))
                else:
                    children[at][j] = -1 - leaves
                    leaves += 1
        return cls(points, children, leaves)

    def place(self, rows: np.ndarray, visit=None) -> np.ndarray:
        """Leaf of each row; ``visit(node, child, places, squared distances to the node's points)`` sees each step."""
        leaf = np.zeros(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, some = todo.pop()
            away = squares(rows[some], self.points[node])
            own = np.argmin(away, axis=1) if len(some) else np.zeros(0, int)
            for j, child in enumerate(self.children[node]):
                pick = own == j
                if not pick.any():
                    continue
                if visit:
                    visit(node, j, some[pick], away[pick])
                if child < 0:
                    leaf[some[pick]] = -1 - child
                else:
                    todo.append((child, some[pick]))
        return leaf

    def slots(self) -> np.ndarray:
        """First slot of each node: a slot for every (child, point) pair, then one for each child."""
        return np.concatenate([[0], np.cumsum([len(p) * (len(p) + 1) for p in self.points])])

    def learn(self, low: np.ndarray, high: np.ndarray, bits: np.ndarray) -> None:
        """Take over the ranges of all rows, by slot (children without rows: low above high)."""
        self.near, self.far, self.short, self.long, self.bits = [], [], [], [], []
        for first, p in zip(self.slots(), self.points):
            m, pairs = len(p), len(p) * len(p)
            self.near.append(low[first: first + pairs].reshape(m, m))
            self.far.append(high[first: first + pairs].reshape(m, m))
            self.short.append(low[first + pairs: first + pairs + m])
            self.long.append(high[first + pairs: first + pairs + m])
            self.bits.append(bits[first + pairs: first + pairs + m])

    def reach(self, rows: np.ndarray, least: np.ndarray, most: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """[row, leaf]: whether the leaf may hold a row whose inner product lies in one of the row's windows.

        ``least``/``most``: [row, window], NaN for no window; ``bits``: label bits of which a leaf must share one.
        """
        out = np.zeros((len(rows), self.leaves), bool)
        own = (rows * rows).sum(axis=1)
        todo = [(0, np.arange(len(rows)), np.zeros(len(rows)), np.full(len(rows), np.inf))]
        while todo:
            node, some, inner, outer = todo.pop()
            away = np.sqrt(np.maximum(squares(rows[some], self.points[node]), 0))
            near, far = np.sqrt(np.maximum(self.near[node], 0)), np.sqrt(np.maximum(self.far[node], 0))
            for j, child in enumerate(self.children[node]):
                if self.short[node][j] > self.long[node][j]:
                    continue
                close = np.maximum(inner, np.maximum(near[j] - away, away - far[j]).max(axis=1))
                wide = np.minimum(outer, (away + far[j]).min(axis=1))
                # a window of inner products is an annulus of distances around the row, as wide as the lengths differ
                hole = own[some, None] + self.short[node][j] - 2.0 * most[some]
                rim = own[some, None] + self.long[node][j] - 2.0 * least[some]
                low, high = close * (1 - SLACK) - SLACK, wide * (1 + SLACK) + SLACK
                meets = ((high ** 2 + 1)[:, None] >= hole) & ((np.maximum(low, 0) ** 2 - 1)[:, None] <= rim)
                pick = np.flatnonzero(meets.any(axis=1) & ((bits[some] & self.bits[node][j]) != 0))
                if not len(pick):
                    continue
                if child < 0:
                    out[some[pick], -1 - child] = True
                else:
                    todo.append((child, some[pick], close[pick], wide[pick]))
        return out
