"""The neutral tables.  Empty text is ``''``; 0 and NULL both mean "missing" when merging."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "struct<tonic:int,minor:boolean>"

LIBRARIES = "library_id string, source string, format string"
TRACKS = (
    "library_id string, track_id string, ordinal bigint, location string, title string, "
    "artist string, album string, album_artist string, genre string, composer string, "
    "grouping string, comment string, label string, remixer string, year string, "
    "track_number int, duration_s double, sample_rate int, bitrate int, file_size bigint, "
    f"bpm double, bpm_locked boolean, key {KEY}, rating int, colour int, play_count int, "
    "date_added date, extra map<string,string>"
)
CUES = (
    "library_id string, track_id string, ordinal bigint, role string, position_ms double, "
    "end_ms double, slot int, name string, colour int, locked boolean"
)
TEMPO = (
    "library_id string, track_id string, position_ms double, bpm double, beat int"
)
PLAYLIST_NODES = (
    "library_id string, node_id string, parent_id string, seq bigint, name string, "
    "is_folder boolean, is_crate boolean, path array<string>"
)
PLAYLIST_ENTRIES = "library_id string, node_id string, position bigint, track_id string"
QUALITY_ISSUES = "library_id string, rule string, entity_id string, detail string"
PATH_RULES = "rule_set string, ordinal int, old string, new string"
FILE_INVENTORY = "root string, rel_path string, length bigint"
AUDIO_FACTS = (
    "location string, header_case string, codec string, sample_rate int, priming bigint, "
    "timescale int, duration_s double, bitrate int, channels int, file_size bigint"
)
SIGNAL_SAMPLES = (
    "track_id string, frame bigint, full double, white double, low double, mid double, high double"
)

TEXT_FIELDS = (
    "title", "artist", "album", "album_artist", "genre", "composer", "grouping", "comment",
    "label", "remixer", "year",
)
VALUE_FIELDS = ("track_number", "bpm", "key", "colour", "date_added")
ROLES = ("cue", "loop", "main", "intro", "outro", "fade_in", "fade_out")


def struct_type(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def conform(df, ddl: str):
    """Select and cast ``df`` to the neutral table ``ddl``; missing columns become NULL."""
    from pyspark.sql import functions as F

    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in struct_type(ddl).fields
        ]
    )
