"""Approximate nearest neighbours by collision counting over query-centred windows.

Every vector is projected on ``PROJECTIONS`` Gaussian directions, and each direction's values are a
sorted array. A query opens a window around its own value on each array and widens all of them by
virtual rehashing: at radius R the half-width is ``WINDOW * R``. A vector whose value lies in the
windows of at least ``needed`` directions is verified by its exact distance. The search of a shard
ends when k verified vectors lie within R, or all its vectors are verified.

A vector within distance R falls into one window with probability ``2 * Phi(WINDOW) - 1`` at least,
independently for each direction; ``needed`` lies under the binomial mean by ``MARGIN`` standard
deviations, so a true neighbour is missed with a probability of at most about 5 in 100, most far less.
There is no cap on candidates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.llm.vectors import BLOCK_ROWS, SHARD_ROWS, search

PROJECTIONS, WINDOW, MARGIN, GROWTH, SEED, TOGETHER = 96, 1.35, 1.65, 1.25, 20_259, 64


def needed_collisions(projections: int, window: float = WINDOW, margin: float = MARGIN) -> int:
    p = math.erf(window / math.sqrt(2))
    return max(1, math.floor(projections * p - margin * math.sqrt(projections * p * (1 - p))))


class SortedProjections:
    """The index of one shard: for each direction, its values in order and whose they are."""

    def __init__(self, vectors: np.ndarray, projections: int, seed: int):
        self.vectors = vectors
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], projections))
        values = (vectors @ self.directions).T
        self.order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(values, self.order, axis=1)
        spread = float(values.std())
        self.first_radius = spread / 32 if spread > 0 else 1.0

    def bounds(self, centres: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """For each query and direction, the stretch of the sorted array within ``half``."""
        low, high = np.empty(centres.shape, np.int64), np.empty(centres.shape, np.int64)
        for j, row in enumerate(self.values):
            low[:, j] = np.searchsorted(row, centres[:, j] - half, side="left")
            high[:, j] = np.searchsorted(row, centres[:, j] + half, side="right")
        return low, high

    def nearest(self, queries: np.ndarray, own: np.ndarray, k: int, needed: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, the places and distances of the k nearest found; ``own``: its own place, or -1."""
        n, m = len(self.vectors), len(self.order)
        centres = queries @ self.directions
        counts = np.zeros((len(queries), n), dtype=np.uint16)
        places = [np.empty(0, np.int64)] * len(queries)
        distances = [np.empty(0)] * len(queries)
        verified = np.zeros((len(queries), n), dtype=bool)
        active, radius = np.arange(len(queries)), self.first_radius
        low = high = None
        while len(active):
            wide = self.bounds(centres[active], WINDOW * radius)
            if low is None:
                low, high = wide[0].copy(), wide[0].copy()
            left = []
            for i, q in enumerate(active.tolist()):
                (a, b), (c, d) = (wide[0][i].tolist(), low[q].tolist()), (high[q].tolist(), wide[1][i].tolist())
                new = [self.order[j, a[j] : b[j]] for j in range(m) if a[j] < b[j]]
                new += [self.order[j, c[j] : d[j]] for j in range(m) if c[j] < d[j]]
                if new:
                    counts[q] += np.bincount(np.concatenate(new), minlength=n).astype(np.uint16)
                    fresh = np.flatnonzero((counts[q] >= needed) & ~verified[q])
                    verified[q, fresh] = True
                    fresh = fresh[fresh != own[q]]
                    if len(fresh):
                        exact = np.sqrt(((self.vectors[fresh] - queries[q]) ** 2).sum(axis=1))
                        places[q], distances[q] = np.concatenate((places[q], fresh)), np.concatenate((distances[q], exact))
                low[q], high[q] = wide[0][i], wide[1][i]
                if np.count_nonzero(distances[q] <= radius) < k and not verified[q].all():
                    left.append(q)
            active, radius = np.array(left, dtype=np.int64), radius * GROWTH
        best = [np.lexsort((p, d))[:k] for p, d in zip(places, distances)]
        return [(p[b], d[b]) for p, d, b in zip(places, distances, best)]


def nearest_vectors(
    vectors: DataFrame, is_query: Column, k: int = 10, projections: int = PROJECTIONS, seed: int = SEED,
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found by Euclidean distance in double
    precision, ties to the smaller vec_id. Zero vectors take no part either."""
    needed = needed_collisions(projections)

    def find(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray) -> pa.Table:
        index = SortedProjections(rows, projections, seed)
        places = np.searchsorted(ids, query_ids)
        own = np.where((places < len(ids)) & (ids[np.minimum(places, len(ids) - 1)] == query_ids), places, -1)
        found = []
        for at in range(0, len(queries), TOGETHER):
            found += index.nearest(queries[at : at + TOGETHER], own[at : at + TOGETHER], k, needed)
        columns = [np.repeat(query_ids, [len(p) for p, _ in found]), ids[np.concatenate([p for p, _ in found])], np.concatenate([d for _, d in found])]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    nonzero = vectors.where(F.exists(F.col("embedding"), lambda x: x != 0))
    return search(nonzero, is_query, find, k, "double", F.col("score").asc(), shard_rows, block_rows)
