"""Hard negatives by descents of cover trees.

The upper level of the tree is a net of at most ``MOST_CELLS`` centres, taken from a bounded sample
(``SAMPLE`` rows a cell). Every row goes to its nearest centre's cell, whose covering radius is then
measured over all its rows. Cells of more than ``SHARD_ROWS`` rows are dealt into shards by a hash of
the id, so neither a dense cell nor copies of one vector make a large task; a shard's cover tree is the
lower part of the tree.

An ask (an anchor and a window of scores) first goes to the cell whose cone of inner products reaches
highest. The k-th best score found there is then its bar, and it goes to those other cells alone whose
cones reach the bar and the window. Rows and asks of a shard come to its task as one sorted stream,
rows first: the tree is built once, asks are answered in blocks, and only one shard's rows are held.

Positives are the best rows of the anchor's label; the window of a positive is stated in hundredths of
its score. Each of the two is one search over all rows.

Defined results: rows whose vec_id, label or vector is NULL, whose vector is empty or holds NULL or
non-finite components, take no part; of several rows with one vec_id the one with the least vector (then
label) does; vectors of another length than the anchor's are no candidates. An anchor without a row of
its label, and a positive without a row in its window, give no rows; a negative positive score has no
window. Scores are exact up to 2 ** 63. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue.llm.cover_tree import CoverTree, cone, net, raised
from segue.llm.shared import lean
from segue.session import materialise

SHARD_ROWS, MOST_CELLS, SAMPLE, TOGETHER = 8192, 1024, 8, 128
LOWEST, HIGHEST = -(1 << 62), 1 << 62
STREAM = "shard int, kind int, id long, label long, x array<long>, ask long, low long, high long, least long"
FOUND = "id long, ask long, found_id long, score long"


def labelled(vectors: DataFrame, label: Column, scale: float) -> DataFrame:
    """(id, label, x, dim): one valid row a vec_id, its vector as integers."""
    v = F.col("embedding").cast("array<double>")
    valid = F.forall(v, lambda c: F.coalesce(F.abs(c * scale) < float(1 << 62), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.when(valid & (F.size(v) > 0), v).alias("v"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = rows.groupBy("id").agg(F.min(F.struct("v", "label")).alias("r"))
    rows = rows.select("id", "r.label", F.transform("r.v", lambda c: F.floor(c * scale).cast("long")).alias("x"))
    return rows.withColumn("dim", F.size("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, vectors) for each length in a batch."""
    lengths = np.asarray(batch.column(column).value_lengths())
    for dim in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == dim)
        yield dim, places, matrix(batch.column(column).take(pa.array(places)))


class Cells:
    """The upper level: for each length of vectors, its centres, their covering radii and their shards."""

    def __init__(self, rows: DataFrame, shard_rows: int):
        squares = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
        per_length = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(squares).alias("m")).collect()
        wanted = {r.dim: min(MOST_CELLS, -(-r.n // shard_rows)) for r in per_length}
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * min(4 * MOST_CELLS, sum(wanted.values()))).select("x").collect() if wanted else []
        self.norm, self.centres = {r.dim: float(np.sqrt(r.m)) * (1 + 1e-9) for r in per_length}, {}
        for dim, cells in wanted.items():
            x = np.array([r.x for r in sample if len(r.x) == dim], dtype=np.float64).reshape(-1, dim)
            x = x if len(x) else np.zeros((1, dim))  # any centre covers its cell
            points = raised(x, self.norm[dim])
            self.centres[dim] = points[net(points, 0, 0.0, cells)[0]]
        self.radius: dict[int, np.ndarray] = {}
        self.shards: dict[tuple[int, int], tuple[int, int]] = {}

    def assign(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their cell and their distance from its centre."""
        centres, norm = self.centres, self.norm

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
                for dim, places, x in _by_length(batch, "x"):
                    points = raised(x.astype(np.float64), norm[dim])
                    cell[places] = (points @ centres[dim].T).argmax(axis=1)  # all have one norm
                    distance[places] = np.sqrt(((points - centres[dim][cell[places]]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(distance)], [*batch.schema.names, "cell", "distance"])

        return rows.mapInArrow(lean(nearest), "id long, label long, x array<long>, dim int, cell int, distance double")

    def measure(self, rows: DataFrame, shard_rows: int) -> DataFrame:
        """Radii and shards of all cells; ``rows`` with the shard they belong to."""
        sizes = rows.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("distance").alias("r")).collect()  # a row a cell
        self.radius = {dim: np.full(len(c), -1.0) for dim, c in self.centres.items()}
        first = 0
        for r in sorted(sizes, key=lambda r: (r.dim, r.cell)):
            self.radius[r.dim][r.cell] = r.r * (1 + 1e-9) + 1e-9
            pieces = -(-r.n // shard_rows)
            self.shards[r.dim, r.cell] = (first, pieces)
            first += pieces
        table = [(*key, *value) for key, value in self.shards.items()]
        table = rows.sparkSession.createDataFrame(table, "dim int, cell int, first int, pieces int")
        piece = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
        return rows.join(F.broadcast(table), ["dim", "cell"]).select((F.col("first") + piece).alias("shard"), "id", "label", "x")

    def route(self, asks: DataFrame, best: bool) -> DataFrame:
        """Each ask once for each shard it goes to: of the cell that reaches highest, or of all others that
        reach its bar and its window."""
        centres, norm, radius, shards = self.centres, self.norm, self.radius, self.shards

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                low, high, least = (np.asarray(batch.column(c), dtype=np.float64) for c in ("low", "high", "least"))
                bar = np.maximum(low, least)
                places, to = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
                for dim, at, x in _by_length(batch, "x"):
                    if dim not in centres:
                        continue
                    x = x.astype(np.float64)
                    top, bottom = cone(centres[dim][:, :-1] @ x.T, np.sqrt((x * x).sum(axis=1)), norm[dim], np.maximum(radius[dim], 0))
                    top[radius[dim] < 0] = -np.inf  # cells without rows
                    highest = top.argmax(axis=0)
                    reached = np.zeros(top.shape, bool)
                    if not best:
                        reached = (top >= bar[at]) & (bottom <= high[at]) & (radius[dim] >= 0)[:, None]
                    reached[highest, np.arange(len(at))] = best
                    for cell in np.flatnonzero(reached.any(axis=1)).tolist():
                        first, pieces = shards[dim, cell]
                        who = at[np.flatnonzero(reached[cell])]
                        places.append(np.repeat(who, pieces))
                        to.append(np.tile(np.arange(first, first + pieces, dtype=np.int32), len(who)))
                yield batch.take(pa.array(np.concatenate(places))).append_column("shard", pa.array(np.concatenate(to)))

        fields = "id long, label long, x array<long>, ask long, low long, high long, least long, shard int"
        return asks.select("id", "label", "x", "ask", "low", "high", "least").mapInArrow(lean(send), fields)


def _answers(k: int, same: bool, together: int):
    """Streams of one shard after another, rows before asks, to each ask's best rows of the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, tree = None, [], None
        for batch in batches:
            keys = np.asarray(batch.column("shard"), dtype=np.int64) * 2 + np.asarray(batch.column("kind"), dtype=np.int64)
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if a == z:
                    continue
                some = batch.slice(a, z - a)
                if keys[a] >> 1 != shard:
                    shard, rows, tree = keys[a] >> 1, [], None
                if not keys[a] & 1:
                    rows.append(some)
                    continue
                if rows:
                    table = pa.Table.from_batches(rows).combine_chunks()
                    parts = [np.asarray(table.column(c), dtype=np.int64) for c in ("id", "label")]
                    tree, rows = CoverTree(matrix(table.column("x").combine_chunks()), *parts), []
                if tree is None:  # no row of the cell fell into this shard
                    continue
                for at in range(0, some.num_rows, together):
                    asks = some.slice(at, together)
                    own, labels, ask, low, high, least = (np.asarray(asks.column(c), dtype=np.int64) for c in ("id", "label", "ask", "low", "high", "least"))
                    place, ids, scores = tree.top(matrix(asks.column("x")), own, labels, low, high, least, k, same)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (own[place], ask[place], ids, scores)], ["id", "ask", "found_id", "score"])

    return run


def best_in_windows(cells: Cells, rows: DataFrame, asks: DataFrame, k: int, same: bool, together: int = TOGETHER) -> DataFrame:
    """(id, ask, rank, found_id, score): of all ``rows`` (shard, id, label, x), the k best of each ask (id,
    label, x, ask, low, high) by score, then id, with a score within the window."""
    none = [F.lit(None).cast("long").alias(c) for c in ("ask", "low", "high", "least")]
    data = rows.select("shard", F.lit(0).alias("kind"), "id", "label", "x", *none)

    def search(some: DataFrame, best: bool) -> DataFrame:
        routed = cells.route(some, best).select("shard", F.lit(1).alias("kind"), "id", "label", "x", "ask", "low", "high", "least")
        stream = data.unionByName(routed).repartition("shard").sortWithinPartitions("shard", "kind", "id", "ask")
        return stream.mapInArrow(lean(_answers(k, same, together)), FOUND)

    order = Window.partitionBy("id", "ask").orderBy(F.desc("score"), "found_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    asks = asks.withColumn("least", F.lit(LOWEST))
    found = materialise(ranked(search(asks, True)), "found")
    if len(cells.shards) > 1:
        bars = found.where(F.col("rank") == k).select("id", "ask", F.col("score").alias("bar"))
        raised_asks = asks.join(bars, ["id", "ask"], "left").withColumn("least", F.coalesce("bar", "least"))
        found = materialise(ranked(found.drop("rank").unionByName(search(raised_asks, False))), "found")
    return found


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, scale: float = 256.0, positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each
    of its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels whose
    score is from ``low`` to ``high`` hundredths of the positive's. ``is_anchor`` is a condition on vec_id."""
    rows = labelled(vectors, F.col("label") if label is None else label, scale)
    rows = materialise(rows, "labelled")
    cells = Cells(rows, shard_rows)
    rows = cells.measure(materialise(cells.assign(rows), "cells"), shard_rows)
    rows = materialise(rows, "shards")
    anchors = rows.withColumn("vec_id", F.col("id")).where(is_anchor).select("id", "label", "x")
    asks = anchors.withColumns({"ask": F.lit(0).cast("long"), "low": F.lit(LOWEST), "high": F.lit(HIGHEST)})
    best = best_in_windows(cells, rows, asks, positives, True)
    best = best.select("id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # one ask for each different score of an anchor's positives; floors of hundredths, without rounding
    windows = best.select("id", F.col("positive_score").alias("ask")).distinct()
    part = lambda n: F.expr(f"CAST(floor(CAST(ask AS decimal(28,0)) * {n} / 100) AS bigint)")
    windows = windows.withColumns({"low": -part(-low), "high": part(high)}).where("low <= high")
    hard = best_in_windows(cells, rows, anchors.join(windows, "id"), negatives, False)
    hard = hard.select("id", F.col("ask").alias("positive_score"), "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = best.join(hard, ["id", "positive_score"])
    return out.select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
