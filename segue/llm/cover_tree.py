"""A cover tree over vectors that an added component brings to one norm.

With the component ``sqrt(M ** 2 - |x| ** 2)`` all candidates lie on a sphere of radius M, and a query
keeps its inner products with them (its own added component is 0). A node is a centre and a covering
radius: the largest distance from the centre to any vector below it. On the sphere that radius is an
angle, so a query's inner products with all vectors below a node lie between those of the two ends of
a cone around the centre. A node's children are a net of its vectors by farthest-first picks (the
centre is a child's centre again): each has a covering radius smaller than its parent's by ``SHRINK``.

A search descends best first, for a block of asks at a time. An ask has a window of scores; it skips
nodes whose cone lies outside its window or below its k-th best score so far, and the vectors of a
leaf are verified by exact integer products.
"""

from __future__ import annotations

import heapq

import numpy as np

LEAF, SHRINK = 128, 0.9


def cone(products: np.ndarray, query_norms: np.ndarray, norm: float, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(highest, lowest) inner products within covering radii (rows) of centres whose products with the
    queries (columns) are given, a rounding margin wider."""
    scale = query_norms[None, :] * norm
    angle = np.arccos(np.clip(np.divide(products, scale, out=np.zeros_like(products), where=scale > 0), -1, 1))
    spread = 2 * np.arcsin(np.clip(radii / (2 * norm), 0, 1))[:, None] if norm > 0 else np.zeros((len(radii), 1))
    margin = 1e-7 * scale + 1e-6
    return scale * np.cos(np.maximum(angle - spread, 0)) + margin, scale * np.cos(np.minimum(angle + spread, np.pi)) - margin


def raised(x: np.ndarray, norm: float) -> np.ndarray:
    """The vectors with their added component."""
    rest = np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))
    return np.hstack([x, rest[:, None]])


def net(points: np.ndarray, first: int, reach: float, most: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Farthest-first picks, from ``first`` until all points lie within ``reach`` of one or there are
    ``most``: the picks, each point's nearest pick, and its distance."""
    distance = np.sqrt(((points - points[first]) ** 2).sum(axis=1))
    picks, owner = [first], np.zeros(len(points), dtype=np.int64)
    while len(picks) < most:
        far = int(distance.argmax())
        if distance[far] <= reach or distance[far] == 0:
            break
        other = np.sqrt(((points - points[far]) ** 2).sum(axis=1))
        closer = other < distance
        owner[closer], distance[closer] = len(picks), other[closer]
        picks.append(far)
    return picks, owner, distance


class CoverTree:
    """The index of one shard. ``x``: integer vectors; ``ids`` and ``labels`` of the same rows."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = LEAF, shrink: float = SHRINK):
        floats = x.astype(np.float64)
        self.norm = float(np.sqrt((floats * floats).sum(axis=1).max()))
        points = raised(floats, self.norm)
        order = np.arange(len(x))
        root = int(np.abs(points - points.mean(axis=0)).sum(axis=1).argmin())
        self.centre, self.radius = [root], [float(np.sqrt(((points - points[root]) ** 2).sum(axis=1)).max())]
        self.span, self.children = [(0, len(x))], []
        node = 0
        while node < len(self.centre):
            a, z = self.span[node]
            self.children.append((0, 0))
            if z - a > leaf and self.radius[node] > 0:
                rows = order[a:z]
                start = int(np.flatnonzero(rows == self.centre[node])[0])
                picks, owner, distance = net(points[rows], start, shrink * self.radius[node], max(2, (z - a) // 16))
                by_owner = np.argsort(owner, kind="stable")
                ends = np.cumsum(np.bincount(owner, minlength=len(picks)))
                self.children[node] = (len(self.centre), len(self.centre) + len(picks))
                for k, pick in enumerate(picks):
                    self.centre.append(int(rows[pick]))
                    self.radius.append(float(distance[owner == k].max()))
                    self.span.append((a + int(ends[k - 1]) if k else a, a + int(ends[k])))
                order[a:z] = rows[by_owner]
            node += 1
        self.radius = np.array(self.radius) * (1 + 1e-9)
        self.centres = floats[self.centre]
        self.x, self.ids, self.labels = x[order], ids[order], labels[order]
        self.largest = int(np.abs(x).max()) if x.size else 0

    def top(
        self, asks: np.ndarray, own: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, k: int, same: bool
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ask, id, score) of the k best rows of each ask with a score from ``low`` to ``high``, ties to smaller
        ids, among rows with the ask's label (``same``) or another one and not its own; rows worse than
        ``least`` may be left out. Scores are exact up to 2 ** 63."""
        exact = self.x.shape[1] * self.largest * int(np.abs(asks).max(initial=0)) < 1 << 53
        kind = np.float64 if exact else np.longdouble
        queries, floats = asks.astype(kind), asks.astype(np.float64)
        norms = np.sqrt((floats * floats).sum(axis=1))
        low, high = low.astype(kind), high.astype(kind)
        bar = np.maximum(low, least.astype(kind))  # an ask's k-th best so far
        scores = np.full((len(asks), k), -np.inf, dtype=kind)
        ids = np.full((len(asks), k), np.iinfo(np.int64).max)

        def bounds(a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
            return cone(self.centres[a:z] @ floats.T, norms, self.norm, self.radius[a:z])

        top, bottom = bounds(0, 1)
        open_nodes = [(-np.inf, 0, top[0], bottom[0])]
        self.verified = 0
        while open_nodes:
            _, node, top, bottom = heapq.heappop(open_nodes)
            need = np.flatnonzero((top >= bar) & (bottom <= high))
            if not len(need):
                continue
            a, z = self.children[node]
            if a < z:
                tops, bottoms = bounds(a, z)
                tops, bottoms = np.minimum(tops, top), np.maximum(bottoms, bottom)
                best = tops[:, need].max(axis=1)
                for i in range(z - a):
                    heapq.heappush(open_nodes, (-float(best[i]), a + i, tops[i], bottoms[i]))
                continue
            a, z = self.span[node]
            self.verified += len(need) * (z - a)
            found = queries[need] @ self.x[a:z].astype(kind).T
            fits = (found >= bar[need, None]) & (found <= high[need, None]) & (self.ids[None, a:z] != own[need, None])
            fits &= (self.labels[None, a:z] == labels[need, None]) == same
            some = np.flatnonzero(fits.any(axis=1))
            if not len(some):
                continue
            at = need[some]
            both = np.hstack([scores[at], np.where(fits[some], found[some], -np.inf)])
            both_ids = np.hstack([ids[at], np.broadcast_to(self.ids[a:z], (len(some), z - a))])
            by_id = np.argsort(both_ids, axis=1, kind="stable")
            both, both_ids = np.take_along_axis(both, by_id, axis=1), np.take_along_axis(both_ids, by_id, axis=1)
            best = np.argsort(-both, axis=1, kind="stable")[:, :k]
            scores[at], ids[at] = np.take_along_axis(both, best, axis=1), np.take_along_axis(both_ids, best, axis=1)
            bar[at] = np.maximum(bar[at], scores[at, k - 1])
        ask, place = np.nonzero(scores > -np.inf)
        return ask, ids[ask, place], scores[ask, place].astype(np.int64)
