"""Searches of a stated query set against all vectors, in blocks.

All vectors are dealt into shards by a hash of their id, the queries into blocks; a shard and a block
meet as one co-group, which finds the block's best rows of that shard by the operator's method. The
best of a query over all shards are picked by a window over at most k rows a shard. A shard holds
about ``SHARD_ROWS`` vectors and a block about ``BLOCK_ROWS`` queries whatever the table's size, so
the largest group is bounded; a shard's vectors are sent once for each block of queries.

Defined results: one row a vec_id takes part (of several, the one with the least vector); vectors
NULL, empty, or holding NULL or non-finite components, and rows without vec_id, take no part; vectors
of other lengths than the query's are no candidates; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, BLOCK_ROWS = 16_384, 1024


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim): one valid row a vec_id, with double components."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & (F.size(v) > 0) & finite
    )
    return valid.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1)


def search(
    vectors: DataFrame, is_query: Column, find: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.Table],
    k: int, score: str, best_first: Column, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``find(ids, vectors, query ids, query vectors)`` gives (query_id, vec_id, score) for the best k
    rows of one shard, by ascending ids. ``score`` is its type."""
    rows = usable(vectors)
    n, asked = rows.select(F.count("*"), F.count(F.when(is_query, 1))).first()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(asked / block_rows))
    # both sides' keys must be of one type: Spark deals rows out by a hash that differs between types
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select("vec_id", "v", "dim", shard.alias("shard"), every(blocks).alias("block"))
    asks = rows.where(is_query).select("vec_id", "v", "dim", every(shards).alias("shard"), block.alias("block"))

    def both(some: pa.Table, queries: pa.Table) -> pa.Table:
        if not some.num_rows or not queries.num_rows:
            kind = pa.float64() if score == "double" else pa.int64()
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], kind)})
        some, queries = some.sort_by("vec_id"), queries.sort_by("vec_id")
        ids = [np.asarray(t.column("vec_id"), dtype=np.int64) for t in (some, queries)]
        return find(ids[0], matrix(some.column("v")), ids[1], matrix(queries.column("v")))

    keys = ["dim", "shard", "block"]
    found = data.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(both, f"query_id long, vec_id long, score {score}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(best_first, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
