"""Beat grids: compress, expand, segment, convert.

What starts a section depends on the section before (`segue.plans.sections`); a track of any length is
cut into chunks that several tasks walk.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.functions.grid import beat_ms
from segue.plans.ordered import CHUNK, around, cut, running, uncut
from segue.plans.sections import first_break, sections_of

TOLERANCE_MS = 2.0
FEW = 8  # rows that are looked at one by one before arrays are


# --- F1: drop markers the last kept one predicts ---------------------------------------
def _kept_markers(entry, columns, base, before, last):
    """An open section is the last kept marker: position, bpm, beat."""
    position, bpm, beat = columns
    n, at, out, kept = len(position), 0, [], entry
    rows = list(zip(*[c.tolist() for c in columns]))

    def predicted(a: int, z: int) -> np.ndarray:
        length = 60000.0 / kept[1]
        beats = (position[a:z] - kept[0]) / length
        near = np.rint(beats)
        on_grid = np.abs(beats - near) * length <= TOLERANCE_MS
        return on_grid & (np.abs(bpm[a:z] - kept[1]) <= 0.01) & (beat[a:z] == np.mod(kept[2] - 1 + near, 4) + 1)

    def near_one(row: tuple[float, float, float]) -> bool:
        """As `predicted`, of one row: most markers end after a few, for which arrays take longer."""
        length = 60000.0 / kept[1]
        beats = (row[0] - kept[0]) / length if length else float("nan")
        if not math.isfinite(beats):
            return False
        near = round(beats)
        return abs(beats - near) * length <= TOLERANCE_MS and abs(row[1] - kept[1]) <= 0.01 and row[2] == (kept[2] - 1 + near) % 4 + 1

    while True:
        if kept:
            few = min(n, at + FEW)
            while at < few and near_one(rows[at]):
                at += 1
            at = first_break(predicted, at, n) if at == few else at
        if at == n:
            return out, kept
        kept = list(rows[at])
        out.append(kept)
        at += 1


def _predicted(columns, rows, firsts):
    position, bpm, beat = columns
    length = 60000.0 / bpm[firsts]
    beats = (position[rows] - position[firsts]) / length
    near = np.rint(beats)
    on_grid = np.abs(beats - near) * length <= TOLERANCE_MS
    return on_grid & (np.abs(bpm[rows] - bpm[firsts]) <= 0.01) & (beat[rows] == np.mod(beat[firsts] - 1 + near, 4) + 1)


def _first_rows(columns, starts, firsts, stops):
    return [c[firsts] for c in columns]


def simplify(tempo: DataFrame, keys: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    columns = ["position_ms", "bpm", "beat"]
    kept = sections_of(tempo.where("bpm > 0"), keys, "position_ms", columns, _kept_markers, (_predicted, _first_rows, 0), 3, columns[1:], chunk)
    types = {f.name: f.dataType for f in tempo.schema.fields}
    return kept.select(*keys, *[F.col(f"v{i}").cast(types[c]).alias(c) for i, c in enumerate(columns)])


# --- F2, F3: a grid as beats -----------------------------------------------------------------
def expand(tempo: DataFrame, keys: Sequence[str], end_ms: str) -> DataFrame:
    """Every beat from the track start to ``end_ms`` (a column): ``position_ms, beat`` (F2)."""
    rows = around(tempo, keys, "position_ms", ["position_ms"], ["bpm", "beat"])
    length = beat_ms(F.col("bpm"))
    at = F.col("position_ms")
    first = F.col("prev").isNull()
    back = F.when(first & (at >= 0), F.floor(at / length)).otherwise(0)
    stop = F.coalesce(F.col("next.position_ms") - length / 2, F.col(end_ms))
    rows = rows.withColumn("_start", at - back * length).withColumn(
        "_beat", F.pmod(F.col("beat") - 1 - back, F.lit(4))
    )
    n = F.ceil((stop - F.col("_start")) / length)
    return _beats(rows, keys, n, length)


def _beats(rows: DataFrame, keys: Sequence[str], n: Column, length: Column) -> DataFrame:
    return (
        rows.withColumn("_n", n.cast("int")).where("_n > 0")
        .withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .select(
            *keys, (F.col("_start") + F.col("_k") * length).alias("position_ms"),
            (F.pmod(F.col("_beat") + F.col("_k"), F.lit(4)) + 1).cast("int").alias("beat"), "bpm",
        )
    )


def expand_for_device(tempo: DataFrame, keys: Sequence[str], duration_ms: str) -> DataFrame:
    """Beats as the device stores them: ``beat, tempo`` (bpm x 100) and whole ``ms``."""
    rows = around(tempo, keys, "position_ms", ["position_ms"], ["bpm", "beat"]).where("bpm > 0")
    length = beat_ms(F.col("bpm"))
    at = F.col("position_ms")
    back = F.when(F.col("prev").isNull(), F.floor(at / length)).otherwise(0)
    number = F.least(F.greatest("beat", F.lit(1)), F.lit(4))
    rows = rows.withColumn("_start", at - back * length).withColumn(
        "_beat", F.pmod(number - 1 - back, F.lit(4))
    )
    start = F.col("_start")
    inner = F.greatest(F.lit(1), F.rint((F.col("next.position_ms") - start) / length).cast("bigint"))
    last = F.greatest(F.lit(0), F.ceil((F.col(duration_ms) - start) / length))
    n = F.when(F.col("next").isNotNull(), inner).otherwise(last)
    return _beats(rows, keys, n, length).select(
        *keys, "beat", F.rint(F.col("bpm") * 100).cast("int").alias("tempo"),
        F.rint("position_ms").cast("bigint").alias("ms"),
    )


# --- F4: beats -> constant-tempo sections --------------------------------------------------------
def _constant_tempo(tolerance_ms: float):
    def walk(entry, columns, base, before, last):
        """An open section: its first beat's number and position, and its first interval."""
        beats = columns[0] if before is None else np.concatenate((before, columns[0]))
        base -= before is not None
        gaps = np.diff(beats)
        n, at, out, section = len(gaps), 0, [], entry
        starts, units = beats.tolist(), gaps.tolist()
        while at < n:
            if section:
                few = min(n, at + FEW)
                while at < few and abs(units[at] - section[2]) <= tolerance_ms:
                    at += 1
                if at == few:
                    at = first_break(lambda a, z: np.abs(gaps[a:z] - section[2]) <= tolerance_ms, at, n)
                if at == n:
                    break
                out.append([section[0], section[1], base + at - section[0], starts[at] - section[1]])
            section = [float(base + at), starts[at], units[at]]
            at += 1
        if last and section:
            out.append([section[0], section[1], base + len(beats) - 1 - section[0], beats[-1] - section[1]])
        return out, section

    return walk


def _steady_gaps(tolerance_ms: float):
    def fits(columns, rows, firsts):
        beats = columns[0]
        return np.abs((beats[rows + 1] - beats[rows]) - (beats[firsts + 1] - beats[firsts])) <= tolerance_ms

    def numbers(columns, starts, firsts, stops):
        beats = columns[0]
        return [(firsts - starts).astype(float), beats[firsts], (stops - firsts).astype(float), beats[stops] - beats[firsts]]

    return fits, numbers, 1


def sections(
    beats: DataFrame, keys: Sequence[str], position: str = "position_ms", first_beat: int = 1,
    tolerance_ms: float = TOLERANCE_MS, chunk: int = CHUNK,
) -> DataFrame:
    """``position_ms, bpm, beat`` per section.

    The unit is the interval between two beats.  A section takes intervals while they
    differ from its *first* by at most the tolerance.
    """
    found = sections_of(beats, keys, position, [position], _constant_tempo(tolerance_ms), _steady_gaps(tolerance_ms), 4, (), chunk)
    return found.select(
        *keys, F.col("v1").alias("position_ms"), F.try_divide(F.lit(60000.0) * F.col("v2"), F.col("v3")).alias("bpm"),
        (F.pmod(F.col("v0").cast("bigint") + (first_beat - 1), F.lit(4)) + 1).cast("int").alias("beat"),
    ).where("bpm IS NOT NULL")  # fmt: skip  (beats at one position have no tempo)


# --- F5: per-beat rows -> sections --------------------------------------------------------------
def _steady_rows(entry, columns, base, before, last):
    """An open section is its first row: its number, ms, bpm, beat."""
    ms, bpm, beat = columns
    n, at, out, first = len(ms), 0, [], entry

    def expected(a: int, z: int) -> np.ndarray:
        since = np.arange(base + a, base + z) - first[0]
        return (np.abs(first[2] - bpm[a:z]) < 0.001) & (np.abs(ms[a:z] - (first[1] + since * 60000.0 / first[2])) <= TOLERANCE_MS)

    while True:
        at = first_break(expected, at, n) if first else at
        if at == n:
            return out, first
        first = [float(base + at), float(ms[at]), float(bpm[at]), float(beat[at])]
        out.append(first[1:])
        at += 1


def _as_expected(columns, rows, firsts):
    ms, bpm, _ = columns
    own = bpm[firsts]
    return (np.abs(own - bpm[rows]) < 0.001) & (np.abs(ms[rows] - (ms[firsts] + (rows - firsts) * 60000.0 / own)) <= TOLERANCE_MS)


def compress(beats: DataFrame, keys: Sequence[str], order: str = "i", chunk: int = CHUNK) -> DataFrame:
    """Device beat rows ``(order, beat, tempo, ms)`` to tempo markers."""
    rows = beats.where("tempo > 0").withColumn("bpm", F.col("tempo") / F.lit(100.0))
    found = sections_of(rows, keys, order, ["ms", "bpm", "beat"], _steady_rows, (_as_expected, _first_rows, 0), 3, ["ms", "bpm", "beat"], chunk)
    beat = F.when(F.col("v2") == 0, 1).otherwise(F.col("v2")).cast("int")
    return found.select(*keys, F.col("v0").alias("position_ms"), F.col("v1").alias("bpm"), beat.alias("beat"))


# --- F6, F7: Serato grids ---------------------------------------------------------------------------
def from_serato(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(i, position_s, bpm, beats_to_next)`` to tempo; the bpm of all but the last marker
    comes from the beats up to the next one."""
    rows = around(grid, keys, "i", ["position_s"])
    at = F.col("position_s") * F.lit(1000.0)
    to = F.col("next.position_s") * F.lit(1000.0)
    spread = F.when(
        (to != 0) & (to > at) & (F.col("beats_to_next") != 0),
        F.col("beats_to_next") * F.lit(60000.0) / (to - at),
    )
    return rows.select(
        *keys, at.alias("position_ms"), F.coalesce("bpm", spread).alias("bpm"), F.lit(1).alias("beat")
    ).where("bpm > 0")


def to_serato(tempo: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tempo to ``(position_s, bpm, beats_to_next)``: the first marker moves to a downbeat,
    markers not after the last kept one are dropped, only the last carries a bpm."""
    ties = ["bpm", "beat"]
    rows = cut(tempo.where("bpm > 0"), keys, "position_ms", ties)
    rows = around(rows, keys, "position_ms", ["position_ms"], ties)
    length = beat_ms(F.col("bpm"))
    down = F.col("position_ms") - F.pmod(F.col("beat") - 1, F.lit(4)) * length
    down = F.when(down < 0, down + 4 * length).otherwise(down)
    first = F.col("prev").isNull()
    rows = rows.withColumn("_at", F.when(first, down).otherwise(F.col("position_ms"))).drop("prev", "next")
    rows = running(rows, keys, "position_ms", F.col("_at"), "max", "_top", ties, inclusive=False)
    # kept markers rise, so their order is still that of the stored position
    rows = uncut(around(rows.where("_top IS NULL OR _at > _top"), keys, "position_ms", ["_at"], ties))
    to = F.col("next._at")
    return rows.select(
        *keys, (F.col("_at") / F.lit(1000.0)).alias("position_s"),
        F.when(to.isNull(), F.col("bpm")).alias("bpm"),
        F.greatest(
            F.lit(1), F.rint((to - F.col("_at")) * F.col("bpm") / F.lit(60000.0)).cast("int")
        ).alias("_b"), to.alias("_to"),
    ).select(
        *keys, "position_s", "bpm", F.when(F.col("_to").isNotNull(), F.col("_b")).alias("beats_to_next")
    )
