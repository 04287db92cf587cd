"""Exact top-k by inner product over a bit-sliced index.

A shard keeps each attribute (component) as bit slices: bitmap b of an attribute has a 1 for every
row whose value, counted from the attribute's least, has bit b. A query's score is a sum of
attributes times constants, so its bit slices come from bitmap arithmetic alone: a constant's set
bits shift an attribute's slices, negative constants take the complement, and carry-save adders turn
all bitmaps of one weight into one of that weight and carries for the next. The top rows are then
selected from the most significant slice downward; the rows that tie at the boundary are taken in
order of vec_id, exactly as many as are missing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.llm.vectors import BLOCK_ROWS, SHARD_ROWS, search

_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def ones(bitmap: np.ndarray) -> int:
    return int(_ONES[bitmap.view(np.uint16)].sum(dtype=np.int64))


class BitSlices:
    """The index of one shard: ``slices[a, b]`` is bitmap b of attribute a, 64 rows to a word."""

    def __init__(self, values: np.ndarray):
        self.rows, attributes = values.shape
        words = -(-self.rows // 64)
        self.least = values.min(axis=0)
        shifted = (values - self.least).astype(np.uint64)
        self.bits = max(1, int(shifted.max()).bit_length())
        padded = np.zeros((words * 64, attributes), dtype=np.uint64)
        padded[: self.rows] = shifted
        self.slices = np.empty((attributes, self.bits, words), dtype=np.uint64)
        for b in range(self.bits):
            on = ((padded >> np.uint64(b)) & np.uint64(1)).astype(bool)
            self.slices[:, b] = np.packbits(np.ascontiguousarray(on.T), axis=1, bitorder="little").view(np.uint64)
        self.all = np.zeros(words * 64, dtype=bool)
        self.all[: self.rows] = True
        self.all = np.packbits(self.all, bitorder="little").view(np.uint64)

    def weighted_sum(self, constants: list[int]) -> tuple[list[np.ndarray], int]:
        """Slices, least significant first, of the rows' weighted sums, and what to add to them."""
        top = (1 << self.bits) - 1
        levels: dict[int, list[tuple[int, int]]] = {}
        flip = np.zeros(len(constants), dtype=bool)
        base = 0
        for a, c in enumerate(constants):
            base += c * (int(self.least[a]) + (top if c < 0 else 0))  # c * x = |c| * (top - x) + c * top
            flip[a] = c < 0
            for s in range(abs(c).bit_length()):
                if abs(c) >> s & 1:
                    for b in range(self.bits):
                        levels.setdefault(s + b, []).append((a, b))
        out, carried, weight = [], np.empty((0, len(self.all)), np.uint64), 0
        last = max(levels, default=-1)
        while weight <= last or len(carried):
            own = levels.get(weight, [])
            if own:
                at = np.array(own)
                maps = self.slices[at[:, 0], at[:, 1]]
                maps[flip[at[:, 0]]] ^= self.all
                maps = np.concatenate((maps, carried))
            else:
                maps = carried
            carries = []
            while len(maps) > 1:
                if len(maps) == 2:
                    a, b = maps[:1], maps[1:]
                    carries.append(a & b)
                    maps = a ^ b
                else:
                    third = len(maps) // 3
                    a, b, c = maps[:third], maps[third : 2 * third], maps[2 * third : 3 * third]
                    half = a ^ b
                    carries.append((a & b) | (half & c))
                    maps = np.concatenate((half ^ c, maps[3 * third :]))
            out.append(maps[0] if len(maps) else np.zeros_like(self.all))
            carried = np.concatenate(carries) if carries else np.empty((0, len(self.all)), np.uint64)
            weight += 1
        return out, base

    def top(self, constants: list[int], k: int, own: int) -> tuple[np.ndarray, list[int]]:
        """Places and scores of the k best rows, without row ``own`` (-1: none)."""
        slices, base = self.weighted_sum(constants)
        sure, tied = np.zeros_like(self.all), self.all.copy()
        if own >= 0:
            tied[own >> 6] ^= np.uint64(1 << (own & 63))
        have = 0  # ones of ``sure``
        for s in reversed(slices):
            high = tied & s
            n = ones(high)
            if have + n > k:
                tied = high
            else:
                sure, tied, have = sure | high, tied & ~s, have + n
                if have == k:
                    break
        places = self._places(sure)
        if have < k:
            places = np.concatenate((places, self._places(tied)[: k - have]))
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        bits = [((s[word] >> bit) & np.uint64(1)).astype(bool).tolist() for s in slices]
        scores = [base + sum(1 << w for w, b in enumerate(bits) if b[i]) for i in range(len(places))]
        return places, scores

    @staticmethod
    def _places(bitmap: np.ndarray) -> np.ndarray:
        word = np.flatnonzero(bitmap)
        on = np.unpackbits(bitmap[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(on)
        return word[row] * 64 + bit


def top_products(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products of the vectors
    floor(scale * x), ties to the smaller vec_id. Products are exact as long as they fit a long."""

    def find(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray) -> pa.Table:
        index = BitSlices(np.floor(scale * rows).astype(np.int64))
        places = np.searchsorted(ids, query_ids)
        own = np.where((places < len(ids)) & (ids[np.minimum(places, len(ids) - 1)] == query_ids), places, -1)
        found = [index.top(c, k, o) for c, o in zip(np.floor(scale * queries).astype(np.int64).tolist(), own.tolist())]
        columns = [
            pa.array(np.repeat(query_ids, [len(p) for p, _ in found])), pa.array(ids[np.concatenate([p for p, _ in found])]),
            pa.array([s for _, scores in found for s in scores], pa.int64()),
        ]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    return search(vectors, is_query, find, k, "long", F.col("score").desc(), shard_rows, block_rows)
