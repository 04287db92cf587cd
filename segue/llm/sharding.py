"""Shards of near equal size by sampled splitters.

Records are ordered by a key (``doc_id``; of equal ids by a checksum of the text and the row's
number). A sample draws keys in proportion to their size, its quantiles become splitters, and the
splitters cut the order into ranges. Ranges are measured exactly, and overfull ones are cut again by
the quantiles of a denser sample of their own, until no range can be cut further. Each range is then
one window: its running sums, on top of the sums of the ranges before it, give every record's place
in the whole order. A shard takes the records whose middle lies in its part of the total, so shards
are stretches of the order, and a shard's size differs from the mean by one record at most (half a
record at either border).

The number of ranges grows with the rows (``range_rows`` a range); splitters and one row of sums a
range are what reaches the driver, ``samples`` sampled keys a range at a time. A repeated id, or
copies of one record, may hold any share of the rows: the row's number lets splitters fall between
them.

Defined results: a NULL text has the overhead as its size and the empty text's checksum; a NULL
doc_id comes first; equal ids follow each other by checksum; repeated rows are kept, each with a slot
of its own; fewer records than shards leave shards empty; an empty table gives no rows; other columns
are ignored unless ``carry`` asks for them, then they come as the fields of one column ``record``,
so no name can clash.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue.session import materialise

RANGE_ROWS, SAMPLES, RANGES_A_SHARD, SEED = 1 << 18, 16, 8, 20_261
KEY = ["k1", "k2", "k3"]
LAWS = ("bytes", "rows")


def _range_of(splitters: list[tuple[int, int, int]]) -> Column:
    """The number of splitters at or before a row's key."""
    firsts = np.array([s[0] for s in splitters], dtype=np.int64)

    @F.pandas_udf("int")
    def place(k1: pd.Series, k2: pd.Series, k3: pd.Series) -> pd.Series:
        first = k1.to_numpy(dtype=np.int64)
        low, high = np.searchsorted(firsts, first, "left"), np.searchsorted(firsts, first, "right")
        tied = np.flatnonzero(low < high)  # the later parts of the key matter to ids that are splitters
        if len(tied):
            keys = zip(first[tied].tolist(), k2.to_numpy()[tied].tolist(), k3.to_numpy()[tied].tolist())
            low[tied] = [bisect_right(splitters, key, a, z) for key, a, z in zip(keys, low[tied].tolist(), high[tied].tolist())]
        return pd.Series(low.astype(np.int32))

    return place(*KEY)


def _quantiles(keys: list[tuple], draws: list[int], pieces: int) -> list[tuple]:
    """The keys at which sorted, weighted samples pass each ``pieces``-th part."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    passed = np.cumsum([draws[i] for i in order])
    at = np.searchsorted(passed, passed[-1] * np.arange(1, pieces) / pieces, side="left") if len(order) else []
    return sorted({keys[order[i]] for i in at})


def splitters_of(rows: DataFrame, n: int, total: int, ranges: int, samples: int) -> tuple[list[tuple], dict[int, tuple[int, int]]]:
    """Splitters, and for each range its (weight, rows). A range's fill is the mean of its shares of the
    weight and of the rows, so neither many small records nor few large ones make a long task."""
    share = F.col("weight") / F.lit(2.0 * total) + F.lit(0.5 / n)
    chance = F.pmod(F.xxhash64(F.lit(SEED), *KEY), F.lit(1 << 40)) / float(1 << 40)
    splitters: list[tuple] = []
    closed: set[tuple] = set()
    rate, wide = float(samples * ranges), None
    while True:
        placed = rows.withColumn("range", _range_of(splitters) if splitters else F.lit(0))
        if splitters:
            sums = placed.groupBy("range").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
            sizes = {r["range"]: (int(r.w), r.n) for r in sums}
            below = lambda i: splitters[i - 1] if i else ()
            fill = {i: (w / total + k / n) / 2 * ranges for i, (w, k) in sizes.items()}
            wide = [i for i, x in fill.items() if x > 2 and sizes[i][1] > 1 and below(i) not in closed]
            if not wide:
                return splitters, sizes
            placed = placed.where(F.col("range").isin(wide))
            rate *= 4
        drawn = placed.select("range", *KEY, F.floor(share * rate + chance).alias("draws")).where("draws > 0").collect()
        by_range: dict[int, list] = {}
        for r in drawn:
            by_range.setdefault(r["range"], []).append(r)
        found: set[tuple] = set()
        for i in wide or [0]:
            some = by_range.get(i, [])
            pieces = ranges if wide is None else int(np.ceil(2 * fill[i]))
            new = set(_quantiles([(r.k1, r.k2, r.k3) for r in some], [r.draws for r in some], pieces)) - set(splitters)
            if wide and not new:
                closed.add(below(i))  # one record larger than a range, and a few beside it
            found |= new
        if wide is None and not found:
            return [], {0: (total, n)}
        splitters = sorted({*splitters, *found})


def shard_documents(
    docs: DataFrame, shards: int = 24, law: str = "bytes", overhead: int = 8, carry: bool = False,
    range_rows: int = RANGE_ROWS, samples: int = SAMPLES,
) -> DataFrame:
    """One row for each document: doc_id, size (UTF-8 bytes and ``overhead``), text_crc32, law, shard
    (0 to ``shards`` - 1), slot (its place in the shard, gapless from 0), grown_shard (NULL: only a law of
    keys has one), and ``record`` if asked to ``carry`` the documents along.

    ``law`` says what shards are near equal in: ``bytes``, or ``rows`` (counts at most one apart).
    """
    if law not in LAWS:
        raise ValueError(f"the law is one of {', '.join(LAWS)}")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = (F.octet_length(text) + overhead).cast("long")
    record = [F.struct(*docs.columns).alias("record")] if carry else []
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), *record)
    made = made.withColumn("k3", F.monotonically_increasing_id())  # written, so it is the same to all that read it
    rows = materialise(made, "records")
    rows = rows.withColumns(
        {"k1": F.coalesce("doc_id", F.lit(-(1 << 63))), "k2": F.col("text_crc32"), "weight": F.col("size") if law == "bytes" else F.lit(1).cast("long")}
    )
    n, total = rows.agg(F.count("*"), F.sum(F.col("weight").cast("decimal(38,0)"))).first()
    total = int(total or 0)
    splitters, sizes = [], {}
    if n:
        ranges = min(n, max(RANGES_A_SHARD * shards, -(-n // range_rows)))
        splitters, sizes = splitters_of(rows, n, total, ranges, samples)
    sums, weight, count = [], 0, 0
    for i in sorted(sizes):
        sums.append((i, weight, count))
        weight, count = weight + sizes[i][0], count + sizes[i][1]
    before = docs.sparkSession.createDataFrame(sums, "range int, _weight long, _rows long")  # one row a range
    placed = rows.withColumn("range", _range_of(splitters) if splitters else F.lit(0)).join(F.broadcast(before), "range")
    window = Window.partitionBy("range").orderBy(*KEY)
    sofar = F.col("_weight") + F.sum("weight").over(window.rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight")
    placed = placed.withColumn("_sofar", sofar).withColumn("_rank", F.col("_rows") + F.row_number().over(window) - 1)
    part = f"(2 * cast(_sofar AS decimal(28,0)) + weight) * cast({shards} AS decimal(9,0)) div cast({2 * max(total, 1)} AS decimal(28,0))"
    placed = placed.withColumn("shard", F.expr(part).cast("int"))
    firsts = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row a shard
    placed = placed.join(F.broadcast(firsts), "shard")
    columns = ["doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("_rank") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")]
    return placed.select(*columns, *(["record"] if carry else []))


def write_shards(docs: DataFrame, path: str, shards: int = 24, law: str = "bytes", **options) -> None:
    """Whole documents as Parquet folders ``shard=N``, in slot order: a folder may have several files, and
    their rows follow each other in the files' order."""
    placed = shard_documents(docs, shards, law, carry=True, **options).select("shard", "slot", "size", "record")
    placed = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    placed.write.partitionBy("shard").parquet(path)
