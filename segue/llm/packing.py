"""Best-fit decreasing packing of token sequences into sequences of a fixed length.

Pieces of one length are interchangeable, so what best-fit decreasing does depends only on how many
pieces there are of each length: at most ``capacity`` numbers, whatever the corpus. The plan is made
from these numbers, all pieces of a length at once: a segment tree over the remaining capacities
gives the tightest open bin in logarithmic time, and the bins of that capacity take the pieces in
order. It is the same packing as the one made document by document. Spark numbers the pieces of
each length and joins them to the plan.

Defined results: NULL text is the empty text; an empty text is one piece, the end id; repeated rows
are packed each; NULL doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segue.llm.bytebpe import encoder
from segue.llm.shared import lean, strings
from segue.session import materialise

ROWS = 4096  # pieces handed on at a time
RUN = "length int, lo long, hi long, first_sequence long, in_each int, offset int"


class Capacities:
    """A segment tree over capacities 0..n: which have open bins, and the least one that fits."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, capacity: int, is_open: bool) -> None:
        node = capacity + self.size
        self.any[node] = is_open
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        node = least + self.size
        if self.any[node]:
            return least
        while node > 1:  # up to the first right sibling that has something, then down its left edge
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self.size:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.size


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """The plan: pieces ``lo`` to ``hi`` (without) of a length go to the sequences from ``first_sequence``
    on, ``in_each`` of them after one another from ``offset``.

    A bin that took a piece and still has room for another is the tightest for it, so a bin takes
    ``remaining // length`` pieces before the next one is touched.
    """
    plan, open_bins, tree, new = [], defaultdict(list), Capacities(capacity), 0

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            open_bins[remaining].append((first, n))
            tree.set(remaining, True)

    for length in sorted(counts, reverse=True):
        lo, total = 0, counts[length]
        while lo < total:
            room = tree.tightest(length)
            if room is None:
                room, first, bins = capacity, new, -(-(total - lo) // (capacity // length))
                new += bins
            else:
                first, bins = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
            each = room // length
            used = min(bins, -(-(total - lo) // each))
            hi = min(total, lo + used * each)
            plan.append((length, lo, hi, first, each, capacity - room))
            last = hi - lo - (used - 1) * each
            put(room - each * length, first, used - (last < each))
            if last < each:
                put(room - last * length, first + used - 1, 1)
            put(room, first + used, bins - used)
            lo = hi
    return plan


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """Each document's ids and the end id, cut from its end into pieces of ``capacity`` ids, so only the
    first may be shorter. ``task`` and ``nth``: the piece's number among those of its length there."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, tokens = TaskContext.get().partitionId(), Counter(), encoder(vocabulary)
        end = np.array([end_id], dtype="<u4")
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"]
        kept = len(names) - (not keep_ids)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * kept
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names[:kept])

        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokens.encode(strings(batch.column("text")))):
                ids = np.concatenate((ids, end))
                first = len(ids) % capacity or capacity
                for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    data = ids[start:stop].tobytes()
                    length = stop - start
                    rows.append((doc_id, piece, start, length, zlib.crc32(data), task, seen[length], data)[:kept])
                    seen[length] += 1
                if len(rows) >= ROWS:
                    yield made(rows)
                    rows = []
            yield made(rows)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids binary" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(lean(cut), schema)


def pack_documents(
    docs: DataFrame, capacity: int = 1024, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, keep_ids: bool = False
) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with
    ``keep_ids`` its ids (little-endian, 32 bits): sorted by offset they are the sequence."""
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, vocabulary, capacity, end_id, keep_ids), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(best_fit_decreasing(counts, capacity), RUN)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = per_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    spans = per_task.join(plan, "length").where("lo < base + n AND hi > base")
    met = pieces.join(spans, ["task", "length"]).where("base + nth >= lo AND base + nth < hi")
    nth = F.expr("base + nth - lo")
    return met.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.expr("(base + nth - lo) div in_each")).alias("sequence_id"),
        (F.col("offset") + nth % F.col("in_each") * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if keep_ids else []),
    )
