"""Colour palettes and conversions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: palettes of the target programs, in their own order ---------------
# Track colours Rekordbox recognises, ids 1-8.
REKORDBOX_TRACK = (0xFF007F, 0xFF0000, 0xFFA500, 0xFFFF00, 0x00FF00, 0x25FDE9, 0x0000FF, 0x660099)
# Rekordbox's hot cue picker, ids 1-16, and its default cue colour.
REKORDBOX_CUE = (
    0xDE44CF, 0xB432FF, 0xAA42FF, 0x6473FF, 0x305AFF, 0x50B4FF, 0x00E0FF, 0x1FA382,
    0x10B176, 0x28E214, 0xA5E116, 0xB4BE04, 0xC3AF04, 0xE0641B, 0xE62828, 0xFF127B,
)
REKORDBOX_DEFAULT_CUE = 0x28E214
# Serato stores a cue colour from the first list and shows the second at the same index.
SERATO_STORED = (
    0xCC0000, 0xCC4400, 0xCC8800, 0xCCCC00, 0x88CC00, 0x44CC00, 0x00CC00, 0x00CC44, 0x00CC88,
    0x00CCCC, 0x0088CC, 0x0044CC, 0x0000CC, 0x4400CC, 0x8800CC, 0xCC00CC, 0xCC0088, 0xCC0044,
)
SERATO_SHOWN = (
    0xC02626, 0xDB4E27, 0xF8821A, 0xFAC313, 0x4EB648, 0x006838, 0x1FAD26, 0x8DC63F, 0x2B3673,
    0x1DBEBD, 0x0F88CA, 0x16308B, 0x173BA2, 0x5C3F97, 0x6823B6, 0xCE359E, 0xDC1D49, 0xC71136,
)
SERATO_DEFAULT_CUE_INDEX = (0, 2, 12, 3, 6, 15, 9, 14)  # hot cues 1-8
SERATO_LOOP = 0x27AAE1
SERATO_NONE = 0xFFFFFF
SERATO_TRACK = (
    0x333333, 0x555555, 0x993399, 0x993377, 0x993355, 0x993333, 0x995533, 0x997733, 0x999933,
    0x779933, 0x559933, 0x339933, 0x339955, 0x339977, 0x339999, 0x337799, 0x335599, 0x333399,
    0x553399, 0x773399,
)
MIXXX_CUE = (0xC50A08, 0x32BE44, 0x42D4F4, 0xF8D200, 0x0044FF, 0xAF00CC, 0xFCA6D7, 0xF2F2FF)
# --------------------------------------------------------------------------------------


def red(colour: Column) -> Column:
    return F.shiftright(colour, 16).bitwiseAND(F.lit(255))


def green(colour: Column) -> Column:
    return F.shiftright(colour, 8).bitwiseAND(F.lit(255))


def blue(colour: Column) -> Column:
    return colour.bitwiseAND(F.lit(255))


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def hex_rgb(colour: Column) -> Column:
    return F.lpad(F.hex(colour.cast("bigint")), 6, "0")


def _palette(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def nearest_index(colour: Column, palette: Sequence[int]) -> Column:
    """0-based index of the closest entry (weights 2/4/3 on squared RGB); first wins ties."""
    r, g, b = red(colour), green(colour), blue(colour)
    distances = F.transform(
        _palette(palette),
        lambda c, i: F.struct(
            (
                (r - red(c)) * (r - red(c)) * 2
                + (g - green(c)) * (g - green(c)) * 4
                + (b - blue(c)) * (b - blue(c)) * 3
            ).alias("d"),
            i.alias("i"),
        ),
    )
    return F.when(colour.isNotNull(), F.array_min(distances)["i"])


def nearest(colour: Column, palette: Sequence[int]) -> Column:
    return F.get(_palette(palette), nearest_index(colour, palette))


def palette_entry(palette: Sequence[int], one_based: Column) -> Column:
    return F.when(
        one_based.between(1, len(palette)), F.get(_palette(palette), one_based.cast("int") - 1)
    )


def rekordbox_track_colour(colour: Column) -> Column:
    return F.when(colour.between(0, 0xFFFFFF), nearest(colour, REKORDBOX_TRACK))


def rekordbox_track_colour_id(colour: Column) -> Column:
    return F.when(
        colour.between(0, 0xFFFFFF), nearest_index(colour, REKORDBOX_TRACK) + 1
    ).otherwise(F.lit(0))


def serato_cue_shown(stored: Column) -> Column:
    position = F.array_position(_palette(SERATO_STORED), stored)
    return (
        F.when(stored == SERATO_NONE, F.lit(None).cast("int"))
        .when(position > 0, F.get(_palette(SERATO_SHOWN), position.cast("int") - 1))
        .otherwise(stored)
    )


def serato_cue_stored(colour: Column, slot: Column) -> Column:
    default = F.get(
        _palette([SERATO_STORED[i] for i in SERATO_DEFAULT_CUE_INDEX]),
        F.pmod(slot, F.lit(len(SERATO_DEFAULT_CUE_INDEX))).cast("int"),
    )
    return F.when(colour.isNull(), default).otherwise(
        F.get(_palette(SERATO_STORED), nearest_index(colour, SERATO_SHOWN))
    )


def serato_track_shown(stored: Column) -> Column:
    return (
        F.when(stored == SERATO_NONE, F.lit(None).cast("int"))
        .when(stored == 0x999999, F.lit(0x090909))
        .when(stored == 0, F.lit(0x333333))
        .when(stored < 0x666666, stored + 0x99999A)
        .otherwise(stored - 0x666666)
    )


def serato_track_stored(colour: Column) -> Column:
    shown = nearest(colour, SERATO_TRACK)
    return (
        F.when(colour.isNull(), F.lit(SERATO_NONE))
        .when(shown == 0x333333, F.lit(0))
        .when(shown < 0x99999A, shown + 0x666666)
        .otherwise(shown - 0x99999A)
    )


def mixxx_default_cue(slot: Column) -> Column:
    return F.get(_palette(MIXXX_CUE), F.pmod(slot, F.lit(8)).cast("int"))
