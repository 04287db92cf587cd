"""Target-shaped tables and plans."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.functions import colours as K
from segue.functions import keys as KEY
from segue.functions import locations as L
from segue.functions.cues import samples_per_ms
from segue.functions.grid import first_downbeat_ms
from segue.functions.numbers import clamp_stars, half_even
from segue.functions.text import extension, file_name, name_without_extension, with_fat_safe
from segue.operators.grids import expand, simplify
from segue.operators.playlists import crate_file_name, write_lists
from segue.plans.ordered import ranked
from segue.sources.binary import TEXT_TAGS

LIB_TRACK = ["library_id", "track_id"]


def _empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


# --- Mixxx ------------------------------------------------------------------------------
def mixxx_tracks(tracks: DataFrame, notation: str = "musical") -> DataFrame:
    """Rows of the ``library`` and ``track_locations`` tables (K3).  ``sample_rate`` and
    ``duration_s`` are expected measured or defaulted."""
    c = F.col
    key = KEY.format_key(c("key"), notation)
    folder = F.regexp_replace("location", r"[/\\][^/\\]*$", "")
    return tracks.select(
        *LIB_TRACK, "location", file_name(c("location")).alias("filename"),
        F.when(folder.isin("", c("location")), "/").otherwise(folder).alias("directory"), "file_size",
        "artist", "title", "album", "album_artist", "year", "genre",
        F.when(c("track_number") != 0, c("track_number").cast("string")).otherwise("").alias("tracknumber"),
        "comment", "composer", "grouping", c("duration_s").alias("duration"), "bitrate",
        c("sample_rate").alias("samplerate"), "bpm", c("bpm_locked").cast("int").alias("bpm_lock"),
        extension(c("location")).alias("filetype"), c("play_count").alias("timesplayed"),
        (c("play_count") > 0).cast("int").alias("played"), "rating", key.alias("key"),
        F.coalesce(KEY.chromatic_id(c("key")), F.lit(0)).alias("key_id"), c("colour").alias("color"),
        F.when(c("date_added").isNotNull(), F.concat(c("date_added").cast("string"), F.lit("T00:00:00.000Z")))
        .alias("datetime_added"),
    )


def mixxx_grid_columns(tracks: DataFrame, tempo: DataFrame) -> DataFrame:
    """``channels, bpm, beats_version`` of the ``library`` rows (K3): two channels where none are known,
    the first marker's bpm where the track has none, and which kind of beats `mixxx_beats` gives it."""
    grid = simplify(tempo, LIB_TRACK).groupBy(*LIB_TRACK).agg(
        F.count("*").alias("_n"), F.min_by("bpm", F.struct("position_ms", "bpm")).alias("_bpm")
    )
    channels = F.nullif("channels", F.lit(0)) if "channels" in tracks.columns else F.lit(None).cast("int")
    version = F.when(F.col("_n") == 1, "BeatGrid-2.0").when(F.col("_n") > 1, "BeatMap-1.0")
    return tracks.join(grid, LIB_TRACK, "left").select(
        *LIB_TRACK, F.coalesce(channels, F.lit(2)).cast("int").alias("channels"),
        F.coalesce(F.nullif("bpm", F.lit(0.0)), "_bpm", F.lit(0.0)).alias("bpm"), version.alias("beats_version"),
    )


def mixxx_lists(
    nodes: DataFrame, entries: DataFrame, ids: DataFrame, target: dict[str, DataFrame], replace: bool = True, as_crates: bool = False,
    only: Collection[str] = ("playlists", "playlist_tracks", "crates", "crate_tracks"),
) -> dict[str, DataFrame]:
    """Rows of ``Playlists``, ``PlaylistTracks``, ``crates`` and ``crate_tracks`` after a library's lists were
    written (K3, M10).  ``nodes`` carry ``path`` and ``ordinal``; the target has no folders, so the path is in
    the name.  ``target`` holds its four tables: ``playlists(library_id, id, name, position, hidden)``,
    ``playlist_tracks`` and ``crate_tracks(library_id, list_id, track_id[, position])``, ``crates(library_id,
    id, name)``.  ``only`` names the tables that are read: playlists and crates are placed apart."""
    parents = F.when(F.size("path") > 1, F.slice("path", F.lit(1), F.size("path") - 1)).otherwise(F.array().cast("array<string>"))
    crate = F.col("is_crate") | F.lit(as_crates)
    lists = nodes.where(~F.col("is_folder")).select(
        "library_id", "node_id", "ordinal", L.flat_playlist_name(parents, F.element_at("path", -1), F.col("is_crate")).alias("name"), crate.alias("_crate")
    )
    crates = target["crates"].withColumns({"position": F.lit(0).cast("bigint"), "hidden": F.lit(False)})
    out = {}
    if {"playlists", "playlist_tracks"} & {*only}:
        out["playlists"], out["playlist_tracks"] = write_lists(
            lists.where("NOT _crate").drop("_crate"), entries, ids, target["playlists"], target["playlist_tracks"], replace
        )
    if {"crates", "crate_tracks"} & {*only}:
        crates, out["crate_tracks"] = write_lists(
            lists.where("_crate").drop("_crate"), entries, ids, crates, target["crate_tracks"], replace, once=True
        )
        out["crates"] = crates.drop("position", "hidden")
    return {name: out[name] for name in only}


def mixxx_cues(slots: DataFrame, tracks: DataFrame) -> DataFrame:
    """Slot rows to stored samples: whole stereo frames, never before the start (K3).
    ``tracks(library_id, track_id, sample_rate, mixxx_ms)``."""
    rows = slots.join(tracks.select(*LIB_TRACK, "sample_rate", "mixxx_ms"), LIB_TRACK)
    per_ms = samples_per_ms(F.col("sample_rate"))
    start = half_even((F.col("position_ms") - F.col("mixxx_ms")) * per_ms / 2) * 2
    return rows.select(
        *LIB_TRACK, F.col("kind").alias("type"), F.greatest(F.lit(0), start).alias("position"),
        (half_even(F.col("length_ms") * per_ms / 2) * 2).alias("length"), "hotcue",
        F.col("name").alias("label"), F.col("colour").alias("color"),
    )


def mixxx_beats(tempo: DataFrame, tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(constant grids as bpm and first downbeat frame, other grids as beat frames) (K3).
    A grid with several sections and no known duration ends ten minutes after its last
    marker."""
    grid = simplify(tempo, LIB_TRACK)
    info = tracks.select(*LIB_TRACK, "sample_rate", "mixxx_ms", "duration_s")
    shape = grid.groupBy(*LIB_TRACK).agg(
        F.count(F.lit(1)).alias("_n"), F.max("position_ms").alias("_last")
    )
    rows = grid.join(shape.join(info, LIB_TRACK), LIB_TRACK).withColumn(
        "position_ms", F.col("position_ms") - F.col("mixxx_ms")
    )
    frame = lambda ms: half_even(ms * F.col("sample_rate") / 1000)
    constant = rows.where("_n = 1").select(
        *LIB_TRACK, "bpm",
        frame(first_downbeat_ms(F.col("position_ms"), F.col("bpm"), F.col("beat"))).alias("frame"),
    )
    end = F.when(F.col("duration_s") > 0, F.col("duration_s") * 1000).otherwise(
        F.col("_last") - F.col("mixxx_ms") + 600_000
    )
    several = rows.where("_n > 1").withColumn("_end", end)
    beats = expand(several, LIB_TRACK, "_end").join(info, LIB_TRACK)
    return constant, beats.select(*LIB_TRACK, frame(F.col("position_ms")).alias("frame"))


# --- Serato ------------------------------------------------------------------------------------
def serato_fields(tracks: DataFrame, root: str = "/", notation: str = "musical") -> DataFrame:
    """One row per field: ``tag, value``; empty texts are left out (K4)."""
    c = F.col
    epoch = (F.unix_date("date_added").cast("bigint") * 86400).cast("string")
    flag = F.when(c("bpm_locked"), "1").otherwise("0")
    pairs = [("ttyp", extension(c("location"))), ("pfil", L.to_root_relative(c("location"), F.lit(root)))]
    pairs += [(tag, F.nullif(_empty(c(col)), F.lit(""))) for tag, col in TEXT_TAGS.items() if col in tracks.columns]
    pairs += [
        ("tbpm", F.when(c("bpm") != 0, F.format_string("%.2f", c("bpm")))),
        ("tkey", F.nullif(KEY.format_key(c("key"), notation), F.lit(""))),
        ("tadd", epoch), ("uadd", epoch),
        ("ulbl", F.when(c("colour").isNotNull(), K.serato_track_stored(c("colour")).cast("string"))),
        ("bmis", F.lit("0")), ("bbgl", flag),
    ]
    item = F.array(*[F.struct(F.lit(t).alias("tag"), v.alias("value")) for t, v in pairs])
    return (
        tracks.select(*LIB_TRACK, F.posexplode(item).alias("at", "f"))
        .select(*LIB_TRACK, "at", "f.tag", "f.value").where("value IS NOT NULL")
    )


def serato_crates(nodes: DataFrame, entries: DataFrame, tracks: DataFrame, root: str = "/") -> DataFrame:
    """Crate rows: file name, position, root-relative path (K4)."""
    paths = tracks.select(*LIB_TRACK, L.to_root_relative(F.col("location"), F.lit(root)).alias("ptrk"))
    lists = nodes.where(~F.col("is_folder")).select(
        "library_id", "node_id", crate_file_name(F.col("path")).alias("crate")
    )
    return (
        entries.join(lists, ["library_id", "node_id"]).join(paths, LIB_TRACK)
        .select("library_id", "crate", "position", "ptrk")
    )


# --- device ----------------------------------------------------------------------------------------
TRANSCODE_MS = 26.0  # fixed value: the MP3 encoder's delay


def place_on_device(
    tracks: DataFrame, root: str, copy_missing: bool = True, can_transcode: bool = True, inventory: DataFrame | None = None
) -> DataFrame:
    """Where each track goes on a device at ``root`` and how (K6): ``action`` is one of
    'in place', 'copy', 'transcode', 'skip', 'unplayable'; ``device_path`` the result,
    ``shift_ms`` what its cues and grid are due for the encoder's delay.

    ``local`` is the track's file on this machine, NULL when not found, ``local_size`` its bytes (the
    catalogue's ``file_size`` where there is no such column).  ``inventory(device_path, length)``: what the
    device holds.  A copy of the same size, or a transcode of any size, that is there already is in
    place, so a second run plans nothing again.
    """
    c = F.col
    base = root.rstrip("/")
    or_unknown = lambda col, text: F.when(_empty(c(col)) != "", c(col)).otherwise(text)
    unplayable = L.is_unplayable(c("_ext"))
    # one step per name: a column used by several others is computed once
    rows = tracks.withColumn("_ext", extension(c("location"))).withColumn(
        "_bare", file_name(c("local"))
    )
    # a leading dot belongs to the name, not to an extension
    rows = rows.withColumn("_suffix", F.lower(F.regexp_extract("_bare", r"[^.](\.[^.]*)$", 1)))
    rows = rows.withColumn(
        "_stem", F.substring("_bare", F.lit(1), F.length("_bare") - F.length("_suffix"))
    ).withColumn("_a", or_unknown("artist", "Unknown Artist")).withColumn(
        "_b", or_unknown("album", "Unknown Album")
    )
    rows = with_fat_safe(rows, {"_stem": 100, "_a": 80, "_b": 80})
    rows = rows.withColumn(
        "action",
        F.when(unplayable & (c("local").isNull() | F.lit(not can_transcode)), "unplayable")
        .when(unplayable, "transcode")
        .when(c("local").isNull(), "skip")
        .when(F.startswith(c("local"), F.lit(base + "/")), "in place")
        .when(F.lit(copy_missing), "copy")
        .otherwise("skip"),
    )
    target = F.concat(
        F.lit("/Contents/"), "_a", F.lit("/"), "_b", F.lit("/"), "_stem",
        F.when(c("action") == "transcode", ".mp3").otherwise(c("_suffix")),
    )
    path = F.when(c("action").isin("transcode", "copy"), target).when(
        c("action") == "in place", F.substring(c("local"), F.lit(len(base) + 1), F.length("local"))
    )
    rows = rows.withColumn("device_path", path).drop("_ext", "_bare", "_suffix", "_stem", "_a", "_b")
    rows = rows.withColumn("shift_ms", F.when(c("action") == "transcode", TRANSCODE_MS).otherwise(0.0))
    if inventory is None:
        return rows
    there = inventory.groupBy("device_path").agg(F.max("length").alias("_length"))
    size = c("local_size") if "local_size" in rows.columns else c("file_size")
    have = ((c("action") == "copy") & (c("_length") == size)) | ((c("action") == "transcode") & c("_length").isNotNull())
    rows = rows.join(there, "device_path", "left")
    action = F.when(F.coalesce(have, F.lit(False)), "in place").otherwise(c("action"))
    return rows.withColumn("action", action).select(*[n for n in rows.columns if n != "_length"])


def device_tracks(placed: DataFrame, notation: str = "musical", today: Column | None = None) -> DataFrame:
    """Fact rows for tracks that got a place, numbered from 1 in track order (K5).  Optional columns
    ``sample_depth`` and ``codec`` come from measured facts; a track without a date was added ``today``,
    and all are analysed then.  ``analysis_path`` numbers the files of one analysis folder in track order."""
    c = F.col
    today = (F.current_date() if today is None else today).cast("string")
    given = lambda name, other: F.coalesce(name, F.lit(other)) if name in placed.columns else F.lit(other)
    used = ranked(
        placed.where("action IN ('in place', 'copy', 'transcode')"), ["library_id"], "ordinal", "id",
        ["track_id"],
    )
    head = F.substring("year", 1, 4)
    stem = name_without_extension(c("device_path"))
    used = used.withColumn("folder", L.analysis_folder(c("device_path")))
    used = ranked(used, ["library_id", "folder"], "id", "_number")
    return used.select(
        *LIB_TRACK, "ordinal", "id",
        F.when(c("title") != "", c("title")).otherwise(stem).alias("title"),
        c("device_path").alias("file_path"), file_name(c("device_path")).alias("filename"),
        "artist", "album", "genre", "label", "remixer", "composer",
        KEY.format_key(c("key"), notation).alias("key_name"),
        half_even(c("bpm") * 100).cast("int").alias("tempo"),
        F.coalesce("track_number", F.lit(0)).alias("track_number"), "play_count",
        F.when(head.rlike(r"^\d+$"), head.try_cast("int")).otherwise(0).alias("year"),
        K.rekordbox_track_colour_id(c("colour")).alias("color_id"), clamp_stars(c("rating")).alias("rating"),
        "comment", "folder",
        F.concat("folder", F.lit("/ANLZ"), F.lpad(F.hex(c("_number") - 1), 4, "0"), F.lit(".DAT")).alias("analysis_path"),
        half_even(F.coalesce("duration_s", F.lit(0.0))).cast("int").alias("duration"),
        F.coalesce(F.nullif("sample_rate", F.lit(0)), F.lit(44100)).alias("sample_rate"), given("sample_depth", 16).alias("sample_depth"),
        "bitrate", "file_size", L.file_type_code(extension(c("device_path")), given("codec", "")).alias("file_type"),
        F.coalesce(c("date_added").cast("string"), today).alias("date_added"), today.alias("analyze_date"),
    )


def device_playlist_nodes(tree: DataFrame) -> DataFrame:
    """Playlist rows of a device (K5): ``id`` from 1 in the order of a walk through the tree, ``parent`` (0 at
    the top), ``seq`` among its siblings from 0.  ``tree`` as `playlists.tree_paths` makes it."""
    known = ranked(tree, ["library_id"], "sort_key", "id", ["node_id"])
    above = known.select("library_id", F.col("node_id").alias("parent_id"), F.col("id").alias("_parent"))
    rows = known.join(above, ["library_id", "parent_id"], "left").withColumn("parent", F.coalesce("_parent", F.lit(0)).cast("bigint"))
    rows = ranked(rows, ["library_id", "parent"], "id", "_seq")
    return rows.select("library_id", "node_id", "id", "parent", (F.col("_seq") - 1).alias("seq"), "name", "is_folder")


def device_entries(entries: DataFrame, device: DataFrame) -> DataFrame:
    """Playlist entries by device id, renumbered without the tracks left out (K5)."""
    rows = entries.join(device.select(*LIB_TRACK, F.col("id").alias("content_id")), LIB_TRACK)
    out = ranked(rows, ["library_id", "node_id"], "position", "seq", ["content_id"])
    return out.select("library_id", "node_id", "content_id", "seq")


def reusable_analysis(wanted: DataFrame, analyses: DataFrame) -> DataFrame:
    """The analysis to reuse per track (J16): the one at the target place if it describes
    the same audio, else the source library's own.

    ``wanted(library_id, track_id, target_file, device_path, source_file)``;
    ``analyses(file, describes)`` lists complete analyses.
    """
    one = analyses.groupBy("file").agg(F.min("describes").alias("describes"))
    at_target = one.select(F.col("file").alias("target_file"), F.col("describes").alias("_d"))
    at_source = one.select(F.col("file").alias("source_file"), F.lit(True).alias("_s"))
    rows = wanted.join(at_target, "target_file", "left").join(at_source, "source_file", "left")
    own = F.when(F.col("_d") == F.col("device_path"), F.col("target_file"))
    return rows.withColumn(
        "reuse", F.coalesce(own, F.when(F.col("_s"), F.col("source_file")))
    ).drop("_d", "_s")


# --- upsert ---------------------------------------------------------------------------------------------
def existing_by_location(
    incoming: DataFrame, existing: DataFrame, ignore_case: bool = False
) -> DataFrame:
    """``existing_id`` per incoming track, NULL for new ones (J13).  Of several existing
    rows at one location the first is updated, or the last where case is ignored."""
    key = F.lower(F.translate("location", "\\", "/")) if ignore_case else F.col("location")
    pick = F.max_by if ignore_case else F.min_by
    known = existing.groupBy("library_id", key.alias("_key")).agg(
        pick("id", F.col("id")).alias("existing_id")
    )
    return (
        incoming.withColumn("_key", key).join(known, ["library_id", "_key"], "left").drop("_key")
    )


def upsert(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], fields: Sequence[str],
    overwrite: bool = True,
) -> DataFrame:
    """Update listed fields of existing rows and insert new ones; other fields and rows stay
    (M9).  ``action`` tells updated, kept and added rows apart."""
    keys = list(keys)
    new = incoming.select(*keys, *[F.col(f).alias(f"_n_{f}") for f in fields], F.lit(True).alias("_in"))
    old = existing.withColumn("_old", F.lit(True))
    rows = old.join(new, keys, "full")
    both = F.col("_old").isNotNull() & F.col("_in").isNotNull()
    take = F.col("_old").isNull() | (both & F.lit(overwrite))
    cols = [
        F.when(take, F.col(f"_n_{f}")).otherwise(F.col(f)).alias(f) if f in fields else F.col(f)
        for f in existing.columns
    ]
    action = (
        F.when(F.col("_old").isNull(), "added").when(both & F.lit(overwrite), "updated").otherwise("kept")
    )
    return rows.select(*cols, action.alias("action"))


def replaced_children(existing: DataFrame, incoming: DataFrame, touched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child rows (cues) of touched parents are replaced as a whole."""
    return existing.join(touched.select(*keys).distinct(), list(keys), "left_anti").unionByName(incoming)
