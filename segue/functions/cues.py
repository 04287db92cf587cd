"""Cue scalars (S21-S24): type codes, slots, units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mixxx cue types, Rekordbox mark types, hot cue kind codes (4 is unused).
MIXXX_HOT, MIXXX_MAIN, MIXXX_LOOP, MIXXX_INTRO, MIXXX_OUTRO = 1, 2, 4, 6, 7
MARK_TYPES = {"cue": 0, "fade_in": 1, "fade_out": 2, "main": 3, "loop": 4}
HOT_CUE_KINDS = {1: 0, 2: 1, 3: 2, 5: 3, 6: 4, 7: 5, 8: 6, 9: 7}
MAX_MIXXX_SLOTS = 36
DEFAULT_RATE = 44100


def role_of_mark(code: Column) -> Column:
    out = F.lit("cue")
    for role, value in MARK_TYPES.items():
        out = F.when(code == value, F.lit(role)).otherwise(out)
    return out


def mark_of_role(role: Column) -> Column:
    """Only loops and fades have their own mark type when written."""
    out = F.lit(MARK_TYPES["cue"])
    for name in ("loop", "fade_in", "fade_out"):
        out = F.when(role == name, F.lit(MARK_TYPES[name])).otherwise(out)
    return out


def role_of_mixxx(code: Column) -> Column:
    return (
        F.when(code == MIXXX_HOT, "cue")
        .when(code == MIXXX_LOOP, "loop")
        .when(code == MIXXX_MAIN, "main")
        .when(code == MIXXX_INTRO, "intro")
        .when(code == MIXXX_OUTRO, "outro")
    )


def slot_of_kind(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in HOT_CUE_KINDS.items() for x in kv])
    return F.try_element_at(table, kind.cast("int"))


def samples_per_ms(rate: Column) -> Column:
    """Mixxx counts samples of stereo output."""
    return rate * 2 / F.lit(1000.0)


def spot(role: Column, position_ms: Column) -> tuple[Column, Column]:
    """What counts as the same place: loop or not, and the 5 ms bin."""
    return (role == "loop"), F.rint(position_ms / 5).cast("bigint")


def loop_beats(start_ms: Column, end_ms: Column, bpm: Column) -> Column:
    """Whole beats a loop spans, or NULL when it is not within 0.02 of a whole number."""
    beats = (end_ms - start_ms) * bpm / F.lit(60000.0)
    return F.when(
        (end_ms > start_ms) & (bpm > 0) & (F.rint(beats) >= 1)
        & (F.abs(beats - F.rint(beats)) < 0.02),
        F.rint(beats).cast("int"),
    )


def default_mark_name(name: Column, role: Column) -> Column:
    """Unnamed intro and outro marks get their role as a name."""
    return F.when((name == "") & role.isin("intro", "outro"), F.initcap(role)).otherwise(name)


def epoch_date(seconds: Column) -> Column:
    return F.when(
        seconds != 0, F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))
    )


def mixxx_cue(cue_type, hotcue, position, length, colour, label, rate, offset_ms) -> Column:
    """One landed Mixxx cue row -> struct(role, position_ms, end_ms, slot, name, colour),
    NULL when the row marks nothing (S22, S23, C3)."""
    per_ms = samples_per_ms(rate)
    start = F.when(position >= 0, position / per_ms + offset_ms)
    span = F.greatest(F.lit(0.0), F.coalesce(length, F.lit(0)) / per_ms)
    text = F.regexp_replace(F.coalesce(label, F.lit("")), "\\x00+$", "")
    role = role_of_mixxx(cue_type)
    ranged = role.isin("intro", "outro")
    end_only = ranged & start.isNull() & (span > 0)
    valid = (
        (role.isin("cue", "main") & start.isNotNull())
        | ((role == "loop") & start.isNotNull() & (span > 0))
        | (ranged & (start.isNotNull() | (span > 0)))
    )
    return F.when(
        valid,
        F.struct(
            role.alias("role"),
            F.when(end_only, span + offset_ms).otherwise(start).alias("position_ms"),
            F.when((role == "loop") | (ranged & (span > 0) & start.isNotNull()), start + span)
            .alias("end_ms"),
            F.when(role.isin("cue", "loop") & (hotcue >= 0), hotcue.cast("int")).alias("slot"),
            F.when(end_only & (text == ""), F.concat(F.initcap(role), F.lit(" end")))
            .otherwise(text)
            .alias("name"),
            F.when(role.isin("cue", "loop"), colour.cast("bigint").bitwiseAND(F.lit(0xFFFFFF)).cast("int"))
            .alias("colour"),
        ),
    )


def playlists_kind(attribute: Column) -> Column:
    """Rekordbox list kinds: 0 list, 1 folder, 4 smart, anything else internal."""
    return (
        F.when(attribute == 0, "list").when(attribute == 1, "folder").when(attribute == 4, "smart")
        .otherwise("internal")
    )
