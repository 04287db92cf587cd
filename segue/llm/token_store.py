"""Token ids in files that give any token without decoding a block (directly addressable codes).

A stored segment holds the ids of consecutive documents. An id is cut into 8-bit chunks, the lowest
first: level 0 has the first chunk of every id, level 1 the second chunk of the ids that need one,
and so on. Beside a level's chunks lies a bitmap that says which of its ids go on, with a directory
of its ones before each 512 bits; an id's place on the next level is its rank there.

Segments are rows of Parquet files, written and read by Spark, so they can lie in any store.

Defined results: NULL text is the empty text; an empty text is its end id alone; a NULL doc_id comes
first; rows with one doc_id follow each other by a hash of their text; repeated rows are kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segue.llm.bytebpe import encoder
from segue.llm.shared import lean, strings

SEGMENT_TOKENS = 1 << 18
BLOCK_BITS = 512
MOST_PARTS = 1 << 20  # rows of the broadcast table of parts: 16 MB
SEGMENT = "part int, segment int, local_start long, n_tokens long, doc_ids array<long>, lengths array<long>, codes binary"
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def pack_ids(ids: np.ndarray) -> bytes:
    """Unsigned 32-bit ids as levels: for each, its length, directory, bitmap and chunks."""
    out = [b""]
    rest = np.asarray(ids, dtype=np.uint32)
    while len(rest):
        goes_on = rest > 255
        bitmap = np.packbits(goes_on, bitorder="little")
        blocks = np.add.reduceat(_ONES[bitmap], np.arange(0, len(bitmap), BLOCK_BITS // 8), dtype=np.uint32)
        directory = np.concatenate(([0], np.cumsum(blocks)[:-1])).astype("<u4")
        out += [struct.pack("<Q", len(rest)), directory.tobytes(), bitmap.tobytes(), rest.astype(np.uint8).tobytes()]
        rest = rest[goes_on] >> 8
    out[0] = struct.pack("<4sB", b"SGDA", (len(out) - 1) // 4)
    return b"".join(out)


class PackedIds:
    """A read-only view of packed ids: one by rank, or all."""

    def __init__(self, data: bytes):
        magic, levels = struct.unpack_from("<4sB", data)
        if magic != b"SGDA":
            raise ValueError("not a segment of packed ids")
        self.levels, at = [], 5
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            parts = []
            for kind, size in (("<u4", -(-n // BLOCK_BITS)), ("u1", -(-n // 8)), ("u1", n)):
                parts.append(np.frombuffer(data, dtype=kind, count=size, offset=at))
                at += parts[-1].nbytes
            self.levels.append(parts)

    def __len__(self) -> int:
        return len(self.levels[0][2]) if self.levels else 0

    def __getitem__(self, i: int) -> int:
        """Id ``i``: one chunk a level, and at most 64 bytes of bitmap to count."""
        value = 0
        for level, (directory, bitmap, chunks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK_BITS
            before = int(_ONES[bitmap[block * (BLOCK_BITS // 8) : i >> 3]].sum())
            i = int(directory[block]) + before + int(_ONES[bitmap[i >> 3] & ((1 << (i & 7)) - 1)])
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level from the last, as unsigned 32-bit integers."""
        values = np.empty(0, dtype=np.uint32)
        for _, bitmap, chunks in reversed(self.levels):
            upper, values = values, chunks.astype(np.uint32)
            values[np.unpackbits(bitmap, count=len(chunks), bitorder="little").view(bool)] |= upper << 8
        return values


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, segment_tokens: int = SEGMENT_TOKENS
) -> None:
    """Encode whole texts and write them to ``path`` in ascending doc_id order.

    Rows are dealt out by ranges of (doc_id, hash of the text, row), so neither a long run of ids nor
    one repeated id or row meets in one task, and each task writes its stretch of the order.
    """
    order = ["doc_id", "_tie", "_row"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"), F.monotonically_increasing_id().alias("_row"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        runs: list[np.ndarray] = []
        held = 0
        tokens = encoder(vocabulary)
        end = np.array([end_id], dtype=np.uint32)

        def segment() -> pa.RecordBatch:
            values = [[part], [number], [start], [held], [doc_ids], [[len(r) + 1 for r in runs]]]
            codes = pack_ids(np.concatenate([x for r in runs for x in (r, end)]))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "segment", "local_start", "n_tokens", "doc_ids", "lengths", "codes"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip([*values, [codes]], kinds)], names)

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokens.encode(strings(batch.column("text")))):
                doc_ids.append(doc_id)
                runs.append(ids)
                held += len(ids) + 1
                if held >= segment_tokens:
                    yield segment()
                    number, start, held, doc_ids, runs = number + 1, start + held, 0, [], []
        if runs:
            yield segment()

    ordered.select("doc_id", "text").mapInArrow(lean(encode), SEGMENT).write.parquet(path)


def stored_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``: the ids of all documents before them. Only one row for each
    writing task is summed up across tasks, and sent to the segments, so their codes are not moved."""
    segments = spark.read.schema(SEGMENT).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if segments.select("part").distinct().count() <= MOST_PARTS:
        parts = F.broadcast(parts)
    return segments.join(parts, "part").withColumn("start", F.col("_before") + F.col("local_start")).drop("_before")


def stored_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """What the files hold: doc_id, start, n_tokens, ids_crc32, and the ids (little-endian, 32 bits)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids = batch.column("doc_ids")[row].values
                lengths = np.asarray(batch.column("lengths")[row].values, dtype=np.int64)
                ids = PackedIds(batch.column("codes")[row].as_py()).all().astype("<u4")
                ends = np.cumsum(lengths)
                data = memoryview(ids).cast("B")
                pieces = [data[4 * a : 4 * z] for a, z in zip((ends - lengths).tolist(), ends.tolist())]
                columns = {
                    "doc_id": doc_ids, "start": pa.array(batch.column("start")[row].as_py() + ends - lengths),
                    "n_tokens": pa.array(lengths), "ids_crc32": pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([bytes(p) for p in pieces], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return stored_segments(spark, path).select("doc_ids", "lengths", "codes", "start").mapInArrow(lean(decode), schema)


def tokens_at(spark: SparkSession, path: str, positions: DataFrame, cell: int = SEGMENT_TOKENS) -> DataFrame:
    """(position, token) for a table of ``position`` values over the whole store, repeated ones included;
    places outside it, and NULL, give no row. Positions meet their segment through cells of the number line."""
    segments = stored_segments(spark, path).where("n_tokens > 0")
    cells = F.sequence(F.expr(f"start div {cell}"), F.expr(f"(start + n_tokens - 1) div {cell}"))
    wanted = positions.select(F.col("position").cast("long").alias("position")).where("position IS NOT NULL")
    wanted = wanted.groupBy("position").agg(F.count("*").alias("times")).withColumn("_cell", F.expr(f"position div {cell}"))
    # a cell has as many different positions as ids at most, and its segment's codes are read once for all
    wanted = wanted.groupBy("_cell").agg(F.collect_list("position").alias("positions"), F.collect_list("times").alias("times"))
    met = wanted.join(segments.withColumn("_cell", F.explode(cells)), "_cell")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at, times = (np.asarray(batch.column(c)[row].values, dtype=np.int64) for c in ("positions", "times"))
                start = batch.column("start")[row].as_py()
                inside = (at >= start) & (at < start + batch.column("n_tokens")[row].as_py())
                at, times = at[inside], times[inside]
                codes = PackedIds(batch.column("codes")[row].as_py()) if len(at) else []
                token = np.array([codes[p] for p in (at - start).tolist()], dtype=np.int64)
                yield pa.RecordBatch.from_pydict({"position": pa.array(np.repeat(at, times)), "token": pa.array(np.repeat(token, times))})

    return met.select("positions", "times", "start", "n_tokens", "codes").mapInArrow(lean(pick), "position long, token long")
