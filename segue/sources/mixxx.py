"""Landed Mixxx tables to the neutral model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.functions import cues as Q
from segue.functions import grid as G
from segue.functions import keys as KEY
from segue.functions.numbers import digits_only, lenient_date
from segue.model import Library
from segue.operators.grids import sections, simplify
from segue.operators.offsets import with_offsets
from segue.operators.playlists import crate_members, known_entries
from segue.operators.reports import visible
from segue.schema import TRACKS, conform

LIB_TRACK = ["library_id", "track_id"]


def read_mixxx(
    t: dict[str, DataFrame], facts: DataFrame, decoder: str = "MAD", hidden: bool = False
) -> tuple[Library, DataFrame]:
    """(library, quality issues).  Every landed table carries ``library_id``; beats come as
    ``beat_maps(track_id, frames)`` and ``beat_grids(track_id, bpm, frame)``.

    Crate members are numbered by (artist, title, track id): see `crate_members`.
    """
    c = F.col
    text = lambda n: F.coalesce(c(n), F.lit("")).alias(n)
    loc = t["track_locations"].select(
        "library_id", c("id").alias("location_id"), c("location").alias("path"), c("filesize").alias("file_size")
    )
    rows = visible(t["library"], ["mixxx_deleted"]).withColumnRenamed("location", "location_id").join(
        loc, ["library_id", "location_id"]
    )
    rate = F.coalesce(F.nullif(c("samplerate").cast("int"), F.lit(0)), F.lit(Q.DEFAULT_RATE))
    tracks = rows.select(
        "library_id", F.concat(F.lit("mixxx:"), c("id").cast("string")).alias("track_id"),
        c("id").cast("bigint").alias("ordinal"), c("path").alias("location"),
        *[text(n) for n in ("title", "artist", "album", "album_artist", "genre", "composer", "grouping", "comment", "year")],
        digits_only(F.coalesce(c("tracknumber").cast("string"), F.lit(""))).alias("track_number"),
        F.coalesce(c("duration").cast("double"), F.lit(0.0)).alias("duration_s"), rate.alias("sample_rate"),
        F.coalesce("bitrate", F.lit(0)).alias("bitrate"), F.coalesce("file_size", F.lit(0)).alias("file_size"),
        F.coalesce(c("bpm").cast("double"), F.lit(0.0)).alias("bpm"), (F.coalesce(c("bpm_lock").cast("int"), F.lit(0)) != 0).alias("bpm_locked"),
        F.coalesce(KEY.key_from_chromatic_id(c("key_id")), KEY.parse_key(c("key"))).alias("key"),
        F.coalesce("rating", F.lit(0)).alias("rating"),
        c("color").cast("bigint").bitwiseAND(F.lit(0xFFFFFF)).alias("colour"),
        F.coalesce("timesplayed", F.lit(0)).alias("play_count"),
        lenient_date(c("datetime_added").cast("string")).alias("date_added"),
    )
    tracks = with_offsets(conform(tracks, TRACKS), facts, decoder)
    timing = tracks.select(*LIB_TRACK, "sample_rate", "mixxx_ms")
    track_id = F.concat(F.lit("mixxx:"), c("track_id").cast("string"))

    cues = t["cues"].withColumn("track_id", track_id).join(timing, LIB_TRACK)
    cue = Q.mixxx_cue(
        c("type"), c("hotcue"), c("position"), c("length"), c("color"), c("label"),
        c("sample_rate"), c("mixxx_ms"),
    )
    cues = cues.select(*LIB_TRACK, c("id").cast("bigint").alias("ordinal"), cue.alias("q")).where(
        "q IS NOT NULL"
    ).select(*LIB_TRACK, "ordinal", "q.*", F.lit(False).alias("locked"))

    maps = t["beat_maps"].withColumn("track_id", track_id).join(timing, LIB_TRACK)
    beats = maps.select(
        *LIB_TRACK,
        F.explode(G.beat_frames_to_ms(c("frames"), c("sample_rate"), c("mixxx_ms"))).alias("position_ms"),
    )
    grids = t["beat_grids"].where("bpm > 0").withColumn("track_id", track_id).join(timing, LIB_TRACK)
    constant = grids.select(
        *LIB_TRACK, (c("frame") * F.lit(1000.0) / c("sample_rate") + c("mixxx_ms")).alias("position_ms"),
        "bpm", F.lit(1).alias("beat"),
    )
    tempo = simplify(sections(beats, LIB_TRACK).unionByName(constant), LIB_TRACK)

    lists = t["playlists"] if hidden else visible(t["playlists"], ["hidden"])
    nodes = lists.select(
        "library_id", F.concat(F.lit("p:"), c("id").cast("string")).alias("node_id"),
        F.lit(None).cast("string").alias("parent_id"), c("position").cast("bigint").alias("seq"), "name",
        F.lit(False).alias("is_folder"), F.lit(False).alias("is_crate"), F.array("name").alias("path"),
    ).unionByName(
        t["crates"].select(
            "library_id", F.concat(F.lit("c:"), c("id").cast("string")).alias("node_id"),
            F.lit("crates").alias("parent_id"), F.lit(None).cast("bigint").alias("seq"), "name",
            F.lit(False).alias("is_folder"), F.lit(True).alias("is_crate"),
            F.array(F.lit("Crates"), "name").alias("path"),
        )
    )
    listed = t["playlist_tracks"].select(
        "library_id", F.concat(F.lit("p:"), c("playlist_id").cast("string")).alias("node_id"),
        c("position").cast("bigint").alias("position"), track_id.alias("track_id"),
    )
    shown = listed.join(nodes.select("library_id", "node_id"), ["library_id", "node_id"], "left_semi")
    entries = known_entries(shown, tracks)
    members = t["crate_tracks"].select(
        "library_id", F.concat(F.lit("c:"), c("crate_id").cast("string")).alias("node_id"),
        track_id.alias("track_id"),
    )
    crated = crate_members(members, tracks)
    issues = tracks.where("issue IS NOT NULL").select(
        "library_id", F.lit("decoder offset unknown").alias("rule"), c("track_id").alias("entity_id"), c("issue").alias("detail")
    )
    return Library(
        tracks.drop("mixxx_ms", "serato_ms", "issue"), cues, tempo, nodes,
        entries.unionByName(crated.select(*entries.columns)),
    ), issues
