"""Landed device export tables to the neutral model (A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.functions import colours as K
from segue.functions import keys as KEY
from segue.functions.numbers import lenient_date
from segue.model import Library
from segue.operators.playlists import known_entries, tree_paths
from segue.operators.select import name_lookup
from segue.schema import CUES, TEMPO, TRACKS, conform


def read_device(
    t: dict[str, DataFrame], root: str, cues: DataFrame | None = None, tempo: DataFrame | None = None
) -> tuple[Library, DataFrame]:
    """(library, issues).  ``content`` with id columns and the ``artist, album, genre, label, key`` names;
    ``playlist(id, seq, name, is_folder, parent)``, ``playlist_content``.  Ids without a
    name give ''; cues and grids come from the analysis files."""
    c = F.col
    base = root.rstrip("/")
    dim = lambda n: t[n]
    rows = name_lookup(
        t["content"],
        {
            "artist": (dim("artist"), "name", "artist_id"), "album": (dim("album"), "name", "album_id"),
            "genre": (dim("genre"), "name", "genre_id"), "label": (dim("label"), "name", "label_id"),
            "key_text": (dim("key"), "name", "key_id"), "remixer": (dim("artist"), "name", "remixer_id"),
            "composer": (dim("artist"), "name", "composer_id"),
        },
    )
    track_id = lambda col: F.concat(F.lit("rbusb:"), col.cast("string"))
    zero = lambda n: F.coalesce(c(n).cast("int"), F.lit(0))
    tracks = rows.select(
        "library_id", track_id(c("id")).alias("track_id"), c("id").cast("bigint").alias("ordinal"),
        F.concat(F.lit(base), "file_path").alias("location"), "title", "artist", "album", "genre", "composer", "label",
        "remixer", F.lit("").alias("album_artist"), F.lit("").alias("grouping"), "comment",
        F.coalesce(F.nullif(c("year").cast("string"), F.lit("0")), F.lit("")).alias("year"),
        F.nullif(zero("track_number"), F.lit(0)).alias("track_number"), c("duration").cast("double").alias("duration_s"),
        zero("sample_rate").alias("sample_rate"), zero("bitrate").alias("bitrate"), "file_size",
        (zero("tempo") / F.lit(100.0)).alias("bpm"), F.lit(False).alias("bpm_locked"), KEY.parse_key(c("key_text")).alias("key"),
        F.least(F.lit(5), zero("rating")).alias("rating"), K.palette_entry(K.REKORDBOX_TRACK, zero("color_id")).alias("colour"),
        zero("play_count").alias("play_count"), lenient_date(c("date_added")).alias("date_added"),
    )
    tracks = conform(tracks, TRACKS)
    nodes, issues = tree_paths(
        t["playlist"].select(
            "library_id", c("id").cast("string").alias("node_id"), c("parent").cast("string").alias("parent_id"),
            c("seq").cast("bigint").alias("seq"), "name", "is_folder", F.lit(False).alias("is_crate"),
        )
    )
    entries = known_entries(
        t["playlist_content"].select(
            "library_id", c("playlist_id").cast("string").alias("node_id"), c("seq").cast("bigint").alias("position"),
            track_id(c("content_id")).alias("track_id"),
        ),
        tracks,
    )
    spark = tracks.sparkSession
    library = Library(
        tracks, cues if cues is not None else spark.createDataFrame([], CUES),
        tempo if tempo is not None else spark.createDataFrame([], TEMPO), nodes, entries,
    )
    return library, issues
