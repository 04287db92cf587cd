"""Grid scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def beat_ms(bpm: Column) -> Column:
    return F.lit(60000.0) / bpm


def first_downbeat_ms(position_ms: Column, bpm: Column, beat: Column) -> Column:
    """First downbeat at or after the track start on the marker's grid."""
    length = beat_ms(bpm)
    return F.pmod(position_ms - F.pmod(beat - 1, F.lit(4)) * length, length * 4)


def beat_frames_to_ms(frames: Column, rate: Column, offset_ms: Column) -> Column:
    """``array<struct<frame,enabled>>`` -> sorted positions of the usable beats."""
    usable = F.filter(frames, lambda f: f["enabled"] & (f["frame"] >= 0))
    return F.array_sort(
        F.transform(usable, lambda f: f["frame"] * F.lit(1000.0) / rate + offset_ms)
    )
