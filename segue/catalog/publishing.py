"""Target tables, placement plans, upserts, undo, documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from segue import standins as S
from segue.catalog.registry import query
from segue.catalog.scalars import milli, sql_milli
from segue.catalog.sql import view, with_views
from segue.functions import keys as KEY
from segue.operators import offsets as O
from segue.operators import playlists as P
from segue.operators import reports as R
from segue.operators import slots as X
from segue.operators import targets as T
from segue.operators import undo as U
from segue.session import record_written, shared_folder
from segue.sinks import neutral
from segue.sinks import rekordbox_xml as D

c = F.col


def full_tracks(spark, sf):
    """Tracks with every neutral column."""
    n, size = c("n"), c("p_size")
    ext = F.when(n % 6 == 0, ".ogg").when(n % 6 == 1, ".flac").otherwise(".mp3")
    return S.tracks_a(spark, sf).select(
        "library_id", "track_id", "ordinal", "n", "p_size",
        F.concat(F.lit("/lib/"), "artist", F.lit("/"), "title", F.lit(" "), n.cast("string"), ext).alias("location"),
        F.when(n % 9 == 0, "").otherwise(c("title")).alias("title"), "artist",
        F.when(n % 4 == 0, "").otherwise(F.concat(c("genre"), F.lit(": best?"))).alias("album"),
        F.lit("").alias("album_artist"), "genre", F.lit("").alias("composer"), F.lit("").alias("grouping"),
        F.when(n % 5 == 0, "a & b <c>").otherwise("").alias("comment"), F.lit("").alias("label"),
        F.when(n % 3 == 0, c("artist")).otherwise("").alias("remixer"),
        F.when(n % 2 == 0, (size + 1970).cast("string")).otherwise("").alias("year"),
        F.when(n % 3 == 1, size).alias("track_number"), (size * 1.0 + 60).alias("duration_s"),
        F.when(n % 2 == 0, 48000).otherwise(44100).alias("sample_rate"), (size * 8).alias("bitrate"),
        "file_size", "bpm", (n % 2 == 0).alias("bpm_locked"),
        F.when(n % 7 != 0, KEY.make_key((n % 12).cast("int"), n % 2 == 0)).alias("key"),
        (n % 7).cast("int").alias("rating"),
        F.when(n % 3 != 0, ((n * 7919) % 16777216)).cast("int").alias("colour"),
        (n % 4).cast("int").alias("play_count"),
        F.when(n % 2 == 1, F.date_add(F.lit("2020-01-01").cast("date"), size)).alias("date_added"),
        F.when(n % 2 == 0, 26.0).otherwise(0.0).alias("mixxx_ms"),
    )


view(
    "full_tracks",
    """SELECT 'A' AS library_id, track_id, ordinal, n, p_size, '/lib/' || artist || '/' || title || ' ' || n || CASE n % 6 WHEN 0 THEN '.ogg' WHEN 1 THEN '.flac' ELSE '.mp3' END AS location,
       title || ' ' || n AS stem, CASE WHEN n % 9 = 0 THEN '' ELSE title END AS title, artist, CASE WHEN n % 4 = 0 THEN '' ELSE genre || ': best?' END AS album, genre,
       CASE WHEN n % 5 = 0 THEN 'a & b <c>' ELSE '' END AS comment, CASE WHEN n % 3 = 0 THEN artist ELSE '' END AS remixer,
       CASE WHEN n % 2 = 0 THEN '' || (p_size + 1970) ELSE '' END AS year, CASE WHEN n % 3 = 1 THEN p_size END AS track_number, p_size + 60.0::DOUBLE AS duration_s,
       CASE WHEN n % 2 = 0 THEN 48000 ELSE 44100 END AS sample_rate, p_size * 8 AS bitrate, file_size, bpm, n % 2 = 0 AS bpm_locked,
       CASE WHEN n % 7 <> 0 THEN n % 12 END AS tonic, n % 2 = 0 AS minor, n % 7 AS rating, CASE WHEN n % 3 <> 0 THEN (n * 7919) % 16777216 END AS colour,
       n % 4 AS play_count, CASE WHEN n % 2 = 1 THEN DATE '2020-01-01' + p_size END AS date_added, CASE WHEN n % 2 = 0 THEN 26.0 ELSE 0.0 END AS mixxx_ms,
       CASE WHEN n % 7 = 0 THEN '' ELSE ['C','Db','D','Eb','E','F','F#','G','Ab','A','Bb','B'][n % 12 + 1] || CASE WHEN n % 2 = 0 THEN 'm' ELSE '' END END AS key_name
       FROM tracks_a""",
    "tracks_a",
)


@query(
    "mixxx_track_rows",
    with_views(
        "full_tracks",
        """SELECT track_id, regexp_extract(location, '[^/]*$') AS filename, '/lib/' || artist AS directory, coalesce('' || track_number, '') AS tracknumber,
             key_name AS key, CASE WHEN tonic IS NULL THEN 0 ELSE tonic + CASE WHEN minor THEN 13 ELSE 1 END END AS key_id,
             CASE n % 6 WHEN 0 THEN 'ogg' WHEN 1 THEN 'flac' ELSE 'mp3' END AS filetype, (play_count > 0)::INT AS played, bpm_locked::INT AS bpm_lock,
             colour AS color, date_added || 'T00:00:00.000Z' AS datetime_added FROM full_tracks""",
    ),
)
def mixxx_track_rows(spark, sf):
    """K3, tracks."""
    return T.mixxx_tracks(full_tracks(spark, sf)).select(
        "track_id", "filename", "directory", "tracknumber", "key", "key_id", "filetype", "played",
        "bpm_lock", "color", "datetime_added",
    )


def _cues(spark, sf):
    return S.cues(spark, sf, "all")


@query(
    "mixxx_cue_rows",
    with_views(
        "full_tracks cues_all",
        """SELECT track_id, cues_all.ordinal, greatest(0, round_even((position_ms - mixxx_ms) * (sample_rate * 2 / 1000.0) / 2, 0)::BIGINT * 2) AS position,
             CASE WHEN role = 'loop' THEN round_even((end_ms - position_ms) * (sample_rate * 2 / 1000.0) / 2, 0)::BIGINT * 2 ELSE 0 END AS length, name AS label
           FROM cues_all JOIN full_tracks USING (track_id)""",
    ),
)
def mixxx_cue_rows(spark, sf):
    """K3, cue units (slots are F8's part)."""
    slots = _cues(spark, sf).select(
        "library_id", "track_id", c("ordinal").alias("kind"), "position_ms",
        F.coalesce(c("end_ms") - c("position_ms"), F.lit(0.0)).alias("length_ms"),
        F.lit(-1).alias("hotcue"), "name", "colour",
    )
    out = T.mixxx_cues(slots, full_tracks(spark, sf))
    return out.select("track_id", c("type").alias("ordinal"), "position", "length", "label")


@query(
    "mixxx_constant_grids",
    with_views(
        "full_tracks",
        f"""SELECT track_id, {sql_milli('bpm')} AS bpm, round_even((p - bar * floor(p / bar)) * sample_rate / 1000, 0)::BIGINT AS frame FROM (
             SELECT track_id, bpm, sample_rate, 240000.0 / bpm AS bar, 25.0::DOUBLE - mixxx_ms - (p_size % 4) * 60000.0 / bpm AS p FROM full_tracks)""",
    ),
)
def mixxx_constant_grids(spark, sf):
    """K3, grids of one section."""
    t = full_tracks(spark, sf)
    tempo = t.select(
        "library_id", "track_id", F.lit(25.0).alias("position_ms"), "bpm", (c("p_size") % 4 + 1).alias("beat")
    )
    return T.mixxx_beats(tempo, t)[0].select("track_id", milli(c("bpm")).alias("bpm"), "frame")


@query(
    "mixxx_beat_maps",
    with_views(
        "full_tracks tempo_a",
        """SELECT track_id, round_even(x * sample_rate / 1000, 0)::BIGINT AS frame FROM (
             SELECT track_id, sample_rate, start + unnest(range(0, greatest(0, ceil((coalesce(nxt - len / 2, duration_s * 1000) - start) / len))::BIGINT)) * len AS x FROM (
               SELECT *, p - CASE WHEN r = 1 AND p >= 0 THEN floor(p / len) ELSE 0 END * len AS start FROM (
                 SELECT track_id, sample_rate, duration_s, position_ms - mixxx_ms AS p, 60000.0 / t.bpm AS len, row_number() OVER w AS r, lead(position_ms - mixxx_ms) OVER w AS nxt
                 FROM (SELECT * FROM tempo_a WHERE position_ms <> 60000.0 / bpm * 64 + 25.0) t JOIN full_tracks f USING (track_id)
                 WINDOW w AS (PARTITION BY track_id ORDER BY position_ms))))""",
    ),
)
def mixxx_beat_maps(spark, sf):
    """K3 + F1 + F2: grids of several sections as beat frames."""
    return T.mixxx_beats(S.tempo(spark, sf, "a"), full_tracks(spark, sf))[1].select("track_id", "frame")


@query(
    "mixxx_grid_columns",
    with_views(
        "full_tracks tempo_a",
        f"""SELECT track_id, 2 AS channels, {sql_milli('CASE WHEN n % 5 = 0 THEN coalesce(g.b, 0) ELSE bpm END')} AS bpm,
             CASE WHEN g.b IS NULL THEN NULL WHEN n % 2 = 0 THEN 'BeatGrid-2.0' ELSE 'BeatMap-1.0' END AS beats_version
           FROM full_tracks LEFT JOIN (SELECT track_id, min(bpm) AS b FROM tempo_a GROUP BY 1) g USING (track_id)""",
    ),
)
def mixxx_grid_columns(spark, sf):
    """K3: what a track's row says of its grid; even tracks keep one tempo, every fifth has no bpm of its own."""
    t = full_tracks(spark, sf).withColumn("bpm", F.when(c("n") % 5 == 0, 0.0).otherwise(c("bpm")))
    tempo = S.tempo(spark, sf, "a").withColumn("n", F.substring("track_id", 3, 20).cast("bigint")).where("n % 2 = 1 OR beat <> 3")
    out = T.mixxx_grid_columns(t, tempo.select("library_id", "track_id", "position_ms", "bpm", "beat"))
    return out.select("track_id", "channels", milli(c("bpm")).alias("bpm"), "beats_version")


# Lists of a target that shows every fourth order as a list already, every eighth of them hidden.
view(
    "mixxx_targets",
    """SELECT *, CASE WHEN how = 'created' THEN top + row_number() OVER (PARTITION BY mode, crate, how ORDER BY k) ELSE k END AS id,
         CASE WHEN how = 'created' THEN top + row_number() OVER (PARTITION BY mode, crate, how ORDER BY k) ELSE k END AS position FROM (
       SELECT mode, o_orderkey AS k, o_orderstatus = 'F' AS crate, o_orderpriority || ' / ' || o_orderkey AS name, o_orderkey % 4 = 0 AS there,
         o_orderkey % 8 = 0 AND o_orderstatus <> 'F' AS hidden,
         CASE WHEN mode = 'replace' AND o_orderkey % 4 = 0 AND (o_orderkey % 8 <> 0 OR o_orderstatus = 'F') THEN 'replaced' ELSE 'created' END AS how,
         (SELECT max(x.o_orderkey) FROM orders x WHERE x.o_orderkey % 4 = 0 AND (x.o_orderstatus = 'F') = (o.o_orderstatus = 'F')) AS top
       FROM orders o, (VALUES ('replace'), ('add')) m(mode)) t""",
)
_LIST_ROWS = """SELECT mode, id, CASE WHEN how = 'created' AND there THEN name || ' (2)' ELSE name END AS name, {position}how AS action FROM mixxx_targets WHERE crate = {crate}
    UNION ALL SELECT mode, k, name, {kept}'kept' FROM mixxx_targets WHERE crate = {crate} AND there AND how = 'created'"""


def _mixxx_lists(spark, sf, table):
    orders, lines = S.table(spark, sf, "orders"), S.table(spark, sf, "lineitem")
    lib, k = F.lit("A").alias("library_id"), c("o_orderkey")
    there = orders.where("o_orderkey % 4 = 0").select(
        lib, k.alias("id"), F.concat("o_orderpriority", F.lit(" / "), k.cast("string")).alias("name"), k.alias("position"), (k % 8 == 0).alias("hidden"), "o_orderstatus"
    )
    held = there.select(lib, c("id").alias("list_id"), F.lit(-1).cast("bigint").alias("track_id"), F.lit(1).cast("bigint").alias("position"), "o_orderstatus")
    crate = c("o_orderstatus") == "F"
    target = {
        "playlists": there.where(~crate).drop("o_orderstatus"), "crates": there.where(crate).select("library_id", "id", "name"),
        "playlist_tracks": held.where(~crate).drop("o_orderstatus"), "crate_tracks": held.where(crate).select("library_id", "list_id", "track_id"),
    }
    ids = S.table(spark, sf, "part").where("p_partkey % 10 <> 0").select(
        lib, F.concat(F.lit("a:"), c("p_partkey").cast("string")).alias("track_id"), (c("p_partkey") + 1).cast("bigint").alias("target_track_id")
    )
    entries = lines.select(
        lib, F.concat(F.lit("a:"), c("l_orderkey").cast("string")).alias("node_id"), c("l_linenumber").cast("bigint").alias("position"),
        F.concat(F.lit("a:"), c("l_partkey").cast("string")).alias("track_id"),
    )
    nodes = S.nodes(spark, sf, "a").drop("pair_id")
    both = [T.mixxx_lists(nodes, entries, ids, target, replace, only=[table])[table].withColumn("mode", F.lit(m)) for m, replace in (("replace", True), ("add", False))]
    return both[0].unionByName(both[1]).drop("library_id")


@query("mixxx_playlist_rows", with_views("mixxx_targets", _LIST_ROWS.format(crate="false", position="position, false AS hidden, ", kept="k, hidden, ")))
def mixxx_playlist_rows(spark, sf):
    """Playlists, replaced and added to."""
    return _mixxx_lists(spark, sf, "playlists")


@query("mixxx_crate_rows", with_views("mixxx_targets", _LIST_ROWS.format(crate="true", position="", kept="")))
def mixxx_crate_rows(spark, sf):
    """Crates, replaced and added to."""
    return _mixxx_lists(spark, sf, "crates")


@query(
    "mixxx_playlist_tracks",
    with_views(
        "mixxx_targets",
        """SELECT mode, id AS list_id, l_partkey + 1 AS track_id, row_number() OVER (PARTITION BY mode, k ORDER BY l_linenumber, 'a:' || l_partkey) AS position
           FROM mixxx_targets JOIN lineitem ON l_orderkey = k WHERE NOT crate AND l_partkey % 10 <> 0
           UNION ALL SELECT mode, k, -1, 1 FROM mixxx_targets WHERE NOT crate AND there AND how = 'created'""",
    ),
)
def mixxx_playlist_tracks(spark, sf):
    """PlaylistTracks; entries of replaced lists are gone, tracks the target lacks left out."""
    return _mixxx_lists(spark, sf, "playlist_tracks")


@query(
    "mixxx_crate_tracks",
    with_views(
        "mixxx_targets",
        """SELECT DISTINCT mode, id AS list_id, l_partkey + 1 AS track_id FROM mixxx_targets JOIN lineitem ON l_orderkey = k WHERE crate AND l_partkey % 10 <> 0
           UNION ALL SELECT mode, k, -1 FROM mixxx_targets WHERE crate AND there AND how = 'created'""",
    ),
)
def mixxx_crate_tracks(spark, sf):
    """crate_tracks, a track once in each crate."""
    return _mixxx_lists(spark, sf, "crate_tracks")


_TEXTS = " ".join(
    f"UNION ALL SELECT track_id, '{tag}', {col} FROM full_tracks WHERE {col} <> ''"
    for tag, col in (("tsng", "title"), ("tart", "artist"), ("talb", "album"), ("tgen", "genre"), ("tcom", "comment"), ("trmx", "remixer"), ("ttyr", "year"), ("tkey", "key_name"))
)


@query(
    "serato_field_rows",
    with_views(
        "full_tracks",
        f"""SELECT track_id, 'ttyp' AS tag, CASE n % 6 WHEN 0 THEN 'ogg' WHEN 1 THEN 'flac' ELSE 'mp3' END AS value FROM full_tracks
            UNION ALL SELECT track_id, 'pfil', ltrim(location, '/') FROM full_tracks {_TEXTS}
            UNION ALL SELECT track_id, 'tbpm', printf('%.2f', bpm) FROM full_tracks
            UNION ALL SELECT track_id, unnest(['tadd', 'uadd']), '' || epoch(date_added)::BIGINT FROM full_tracks WHERE date_added IS NOT NULL
            UNION ALL SELECT track_id, 'bmis', '0' FROM full_tracks UNION ALL SELECT track_id, 'bbgl', CASE WHEN bpm_locked THEN '1' ELSE '0' END FROM full_tracks""",
    ),
)
def serato_field_rows(spark, sf):
    """K4, fields (the colour is `serato_colours`)."""
    out = T.serato_fields(full_tracks(spark, sf))
    return out.where("tag <> 'ulbl'").select("track_id", "tag", "value")


@query(
    "serato_crate_rows",
    with_views(
        "full_tracks",
        """SELECT replace(o_orderpriority, '%%', '%') || '%%' || o_orderkey || '.crate' AS crate, l_linenumber AS position, ltrim(location, '/') AS ptrk
           FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN full_tracks ON n = l_partkey""",
    ),
)
def serato_crate_rows(spark, sf):
    """K4, crates."""
    out = T.serato_crates(S.nodes(spark, sf, "a"), S.entries(spark, sf, "all"), full_tracks(spark, sf))
    return out.drop("library_id")


def _local_tracks(spark, sf):
    t = full_tracks(spark, sf)
    local = (
        F.when(c("n") % 5 == 0, F.lit(None).cast("string"))
        .when(c("n") % 5 == 1, F.concat(F.lit("/media/stick/Music"), F.substring("location", 5, 500)))
        .otherwise(F.concat(F.lit("/home/dj"), "location"))
    )
    return t.withColumn("local", local)


def placed(spark, sf):
    """Tracks placed on a device that holds some copies and transcodes of an earlier run, and files of
    other sizes at the places of some copies."""
    rows = _local_tracks(spark, sf)
    first = T.place_on_device(rows, "/media/stick/").where("action IN ('copy', 'transcode')")
    n = c("n")
    length = F.when(n % 15 == 2, c("file_size")).when(n % 15 == 8, c("file_size") + 1).when(n % 30 == 12, F.lit(5))
    inventory = first.select("device_path", length.cast("bigint").alias("length")).where("length IS NOT NULL")
    return T.place_on_device(rows, "/media/stick/", inventory=inventory)


view(
    "placed",
    r"""SELECT * REPLACE (CASE WHEN action = 'copy' AND n % 15 = 2 OR action = 'transcode' AND n % 30 = 12 THEN 'in place' ELSE action END AS action) FROM (
        SELECT *, CASE action WHEN 'in place' THEN '/Music' || substr(location, 5) WHEN 'transcode' THEN folder || stem || '.mp3'
          WHEN 'copy' THEN folder || stem || CASE n % 6 WHEN 1 THEN '.flac' ELSE '.mp3' END END AS device_path,
          CASE action WHEN 'transcode' THEN 26.0 ELSE 0.0 END AS shift_ms FROM (
        SELECT *, '/Contents/' || artist || '/' || CASE WHEN album = '' THEN 'Unknown Album' ELSE regexp_replace(album, '[:?]', '_', 'g') END || '/' AS folder,
          CASE WHEN n % 6 = 0 AND n % 5 = 0 THEN 'unplayable' WHEN n % 6 = 0 THEN 'transcode' WHEN n % 5 = 0 THEN 'skip' WHEN n % 5 = 1 THEN 'in place' ELSE 'copy' END AS action
        FROM full_tracks))""",
    "full_tracks",
)


@query("placement_plan", with_views("placed", "SELECT track_id, action, device_path, shift_ms::DOUBLE AS shift_ms FROM placed"))
def placement_plan(spark, sf):
    """K6, C6."""
    return placed(spark, sf).select("track_id", "action", "device_path", "shift_ms")


@query(
    "second_placement",
    with_views("placed", "SELECT 'A' AS library_id, 0 AS copy, 0 AS transcode, count(*) FILTER (device_path IS NOT NULL) AS in_place FROM placed"),
)
def second_placement(spark, sf):
    """Once the plan's files are there, a second run copies and transcodes nothing."""
    there = placed(spark, sf).where("device_path IS NOT NULL").select("device_path", c("file_size").alias("length"))
    again = T.place_on_device(_local_tracks(spark, sf), "/media/stick/", inventory=there)
    return R.placement_summary(again.withColumn("analysis", F.lit(None).cast("string"))).select("library_id", "copy", "transcode", "in_place")


@query(
    "quality_counts",
    with_views(
        "placed full_tracks",
        """SELECT 'A' AS library_id, rule, count(*) AS n, array_to_string(list(detail ORDER BY track_id, detail)[1:3], ', ') AS examples FROM (
             SELECT 'unplayable format' AS rule, track_id, location AS detail FROM placed WHERE action = 'unplayable'
             UNION ALL SELECT 'not on the device', track_id, location FROM placed WHERE action = 'skip'
             UNION ALL SELECT 'placeholder waveform', track_id, location FROM placed WHERE device_path IS NOT NULL AND n % 3 = 2
             UNION ALL SELECT 'unknown sample rate', track_id, location FROM full_tracks WHERE n % 4 = 0 AND n % 3 = 0
             UNION ALL SELECT 'cues without a slot', track_id, k || ' cues, ' || l || ' loops' FROM (
               SELECT 'a:' || l_partkey AS track_id, greatest(0, count(*) FILTER (l_returnflag <> 'R') - 16) AS k, greatest(0, count(*) FILTER (l_returnflag = 'R') - 8) AS l FROM lineitem GROUP BY 1) WHERE k + l > 0)
           GROUP BY rule""",
    ),
)
def quality_counts(spark, sf):
    """What a projection could not carry over, by rule."""
    p = placed(spark, sf).withColumn("analysis", F.when(c("device_path").isNotNull() & (c("n") % 3 == 2), "placeholder"))
    t = full_tracks(spark, sf)
    facts = t.where("n % 3 <> 0").select(
        "location", F.lit(48000).alias("sample_rate"), c("duration_s"), c("bitrate"), c("file_size")
    )
    measured = O.measured_or_stated(t.withColumn("sample_rate", F.when(c("n") % 4 != 0, c("sample_rate"))), facts)
    cues = S.cues(spark, sf, "all")
    loop = c("role") == "loop"
    left = cues.groupBy("library_id", "track_id").agg(
        F.greatest(F.lit(0), F.count_if(~loop) - 16).alias("leftover_cues"), F.greatest(F.lit(0), F.count_if(loop) - 8).alias("leftover_loops")
    )
    issues = R.placement_issues(p, c("location")).unionByName(R.rate_issues(measured)).unionByName(R.dropped_cue_issues(left))
    return R.issue_counts(issues)


@query(
    "placement_summary",
    with_views(
        "placed",
        """SELECT 'A' AS library_id, count(*) FILTER (action = 'copy') AS copy, count(*) FILTER (action = 'transcode') AS transcode, count(*) FILTER (action = 'in place') AS in_place,
             count(*) FILTER (action = 'skip') AS skip, count(*) FILTER (action = 'unplayable') AS unplayable,
             count(*) FILTER (device_path IS NOT NULL AND n % 3 = 0) AS reused, count(*) FILTER (device_path IS NOT NULL AND n % 3 = 1) AS measured,
             count(*) FILTER (device_path IS NOT NULL AND n % 3 = 2) AS placeholder FROM placed""",
    ),
)
def placement_summary(spark, sf):
    """G8."""
    how = F.when(c("n") % 3 == 0, "reused").when(c("n") % 3 == 1, "measured").otherwise("placeholder")
    p = placed(spark, sf).withColumn("analysis", F.when(c("device_path").isNotNull(), how))
    return R.placement_summary(p)


view(
    "device",
    """SELECT track_id, row_number() OVER (ORDER BY ordinal) AS id, CASE WHEN title <> '' THEN title ELSE regexp_replace(regexp_extract(device_path, '[^/]*$'), '\\.[^.]*$', '') END AS title,
         device_path AS file_path, regexp_extract(device_path, '[^/]*$') AS filename, key_name, round_even(bpm * 100, 0)::INT AS tempo, coalesce(track_number, 0) AS track_number,
         CASE WHEN year = '' THEN 0 ELSE year::INT END AS year, least(5, rating) AS rating, round_even(duration_s, 0)::INT AS duration, sample_rate, 16 AS sample_depth, bitrate, file_size,
         CASE WHEN device_path LIKE '%.flac' THEN 5 ELSE 1 END AS file_type, coalesce(date_added::VARCHAR, '2024-05-06') AS date_added, '2024-05-06' AS analyze_date FROM placed WHERE device_path IS NOT NULL""",
    "placed",
)


@query(
    "device_tracks",
    with_views("device", "SELECT * FROM device"),
)
def device_tracks(spark, sf):
    """K5, fact rows."""
    return T.device_tracks(placed(spark, sf), today=F.lit("2024-05-06")).select(
        "track_id", "id", "title", "file_path", "filename", "key_name", "tempo", "track_number", "year", "rating", "duration",
        "sample_rate", "sample_depth", "bitrate", "file_size", "file_type", "date_added", "analyze_date",
    )


@query(
    "device_playlist_nodes",
    """WITH t AS (SELECT r_regionkey AS r, NULL AS n, NULL AS c, r_name AS name FROM region
         UNION ALL SELECT n_regionkey, n_nationkey, NULL, n_name FROM nation
         UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey),
       w AS (SELECT *, row_number() OVER (ORDER BY r, n NULLS FIRST, c NULLS FIRST) AS id FROM t)
       SELECT w.id, coalesce(p.id, 0) AS parent, row_number() OVER (PARTITION BY coalesce(p.id, 0) ORDER BY w.id) - 1 AS seq, w.name, w.c IS NULL AS is_folder
       FROM w LEFT JOIN w p ON p.r = w.r AND CASE WHEN w.n IS NULL THEN false WHEN w.c IS NULL THEN p.n IS NULL ELSE p.n = w.n AND p.c IS NULL END""",
)
def device_playlist_nodes(spark, sf):
    """K5: regions and nations as folders, customers as lists."""
    region, nation, cust = (S.table(spark, sf, t) for t in ("region", "nation", "customer"))
    key = lambda p, x: F.concat(F.lit(p), c(x).cast("string"))
    node = lambda df, i, up, seq, name, folder: df.select(F.lit("A").alias("library_id"), i.alias("node_id"), up.alias("parent_id"), c(seq).cast("bigint").alias("seq"), c(name).alias("name"), F.lit(folder).alias("is_folder"))
    rows = node(region, key("r", "r_regionkey"), F.lit("none"), "r_regionkey", "r_name", True).unionByName(
        node(nation, key("n", "n_nationkey"), key("r", "n_regionkey"), "n_nationkey", "n_name", True)
    )
    rows = rows.unionByName(node(cust.join(nation, c("n_nationkey") == c("c_nationkey"), "left_semi"), key("c", "c_custkey"), key("n", "c_nationkey"), "c_custkey", "c_name", False))
    return T.device_playlist_nodes(P.tree_paths(rows)[0]).drop("library_id", "node_id")


@query(
    "device_playlist_entries",
    with_views(
        "device",
        """SELECT l_orderkey AS node, id AS content_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, id) AS seq
           FROM lineitem JOIN device ON track_id = 'a:' || l_partkey""",
    ),
)
def device_playlist_entries(spark, sf):
    """K5, playlist entries."""
    out = T.device_entries(S.entries(spark, sf, "all"), T.device_tracks(placed(spark, sf)))
    return out.select(F.substring("node_id", 3, 20).cast("bigint").alias("node"), "content_id", "seq")


@query(
    "reusable_analyses",
    with_views(
        "tracks_a",
        """SELECT track_id, CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'target ' || n WHEN p_size % 5 <> 0 THEN 'source ' || n END AS reuse FROM tracks_a""",
    ),
)
def reusable_analyses(spark, sf):
    """Analyses at the target for even sizes (right path for every third), at the source unless divisible by five."""
    t = S.tracks_a(spark, sf)
    key = c("n").cast("string")
    wanted = t.select(
        "library_id", "track_id", F.concat(F.lit("target "), key).alias("target_file"),
        c("location").alias("device_path"), F.concat(F.lit("source "), key).alias("source_file"),
    )
    right = F.when(c("p_size") % 3 == 0, c("location")).otherwise("elsewhere")
    found = t.where("p_size % 2 = 0").select(F.concat(F.lit("target "), key).alias("file"), right.alias("describes")).unionByName(
        t.where("p_size % 5 <> 0").select(F.concat(F.lit("source "), key).alias("file"), F.lit("any").alias("describes"))
    )
    return T.reusable_analysis(wanted, found).select("track_id", "reuse")


# --- upsert -----------------------------------------------------------------------------------
@query(
    "existing_rows",
    with_views(
        "tracks_a tracks_b",
        """SELECT b.track_id, e.id AS existing_id FROM tracks_b b LEFT JOIN (SELECT lower(location) AS k, max(n) AS id FROM tracks_a GROUP BY 1) e
             ON e.k = lower(replace(b.location, '/home/dj/Music', '/USB/music'))""",
    ),
)
def existing_rows(spark, sf):
    """J13, case ignored."""
    loc = F.replace(c("location"), F.lit("/home/dj/Music"), F.lit("/USB/music"))
    inc = S.tracks_b(spark, sf).withColumn("location", loc).withColumn("library_id", F.lit("A"))
    have = S.tracks_a(spark, sf).withColumn("id", c("n"))
    return T.existing_by_location(inc, have, ignore_case=True).select("track_id", "existing_id")


_UPSERT = """have AS (SELECT c_custkey AS id, c_name AS title, c_mktsegment AS genre, c_acctbal AS other FROM customer),
    inc AS (SELECT o_custkey AS id, max(o_orderpriority) AS genre, 'o' || max(o_orderkey) AS title FROM orders GROUP BY 1
      UNION ALL SELECT s_suppkey + 1000000, 'new', s_name FROM supplier)"""


@query(
    "upserted_tracks",
    f"""WITH {_UPSERT} SELECT coalesce(h.id, i.id) AS id, coalesce(i.title, h.title) AS title, coalesce(i.genre, h.genre) AS genre, other,
          CASE WHEN h.id IS NULL THEN 'added' WHEN i.id IS NULL THEN 'kept' ELSE 'updated' END AS action FROM have h FULL JOIN inc i ON i.id = h.id""",
)
def upserted_tracks(spark, sf):
    """M9: customers as the base table, their latest orders and the suppliers as incoming rows."""
    have, inc = _upsert_sides(spark, sf)
    return T.upsert(have, inc, ["id"], ["title", "genre"])


@query(
    "inserted_tracks_only",
    f"""WITH {_UPSERT} SELECT coalesce(h.id, i.id) AS id, coalesce(h.title, i.title) AS title, coalesce(h.genre, i.genre) AS genre, other,
          CASE WHEN h.id IS NULL THEN 'added' ELSE 'kept' END AS action FROM have h FULL JOIN inc i ON i.id = h.id""",
)
def inserted_tracks_only(spark, sf):
    """M9 without overwriting."""
    have, inc = _upsert_sides(spark, sf)
    return T.upsert(have, inc, ["id"], ["title", "genre"], overwrite=False)


@query(
    "replaced_cue_rows",
    with_views(
        "cues_a cues_b",
        """SELECT substr(track_id, 3) AS track, ordinal, name FROM cues_a JOIN part ON track_id = 'a:' || p_partkey WHERE p_size <= 25
           UNION ALL SELECT substr(track_id, 3), ordinal, name FROM cues_b JOIN part ON track_id = 'b:' || p_partkey WHERE p_size > 25""",
    ),
)
def replaced_cue_rows(spark, sf):
    """M9: the cues of an updated track are replaced as a whole, also where it has none now."""
    def rows(side: str):
        return S.cues(spark, sf, side).select(F.substring("track_id", 3, 20).alias("track"), "ordinal", "name")

    touched = S.table(spark, sf, "part").where("p_size > 25").select(c("p_partkey").cast("string").alias("track"))
    return T.replaced_children(rows("a"), rows("b").join(touched, "track", "left_semi"), touched, ["track"])


def _upsert_sides(spark, sf):
    have = S.table(spark, sf, "customer").select(
        c("c_custkey").alias("id"), c("c_name").alias("title"), c("c_mktsegment").alias("genre"), c("c_acctbal").alias("other")
    )
    inc = S.table(spark, sf, "orders").groupBy(c("o_custkey").alias("id")).agg(
        F.max("o_orderpriority").alias("genre"), F.concat(F.lit("o"), F.max("o_orderkey").cast("string")).alias("title")
    )
    new = S.table(spark, sf, "supplier").select(
        (c("s_suppkey") + 1000000).alias("id"), F.lit("new").alias("genre"), c("s_name").alias("title")
    )
    return have, inc.unionByName(new)


@query(
    "before_image",
    f"""WITH {_UPSERT} SELECT id, title, genre, other FROM have WHERE id IN (SELECT id FROM inc)""",
)
def before_image(spark, sf):
    """K7, rows an upsert will change."""
    have, inc = _upsert_sides(spark, sf)
    return U.before_image(have, inc, ["id"])[0]


@query(
    "reverted_tracks",
    "SELECT c_custkey AS id, c_name AS title, c_mktsegment AS genre, c_acctbal AS other FROM customer",
)
def reverted_tracks(spark, sf):
    """K7: an upsert undone gives the original table."""
    have, inc = _upsert_sides(spark, sf)
    image, created = U.before_image(have, inc, ["id"])
    after = T.upsert(have, inc, ["id"], ["title", "genre"]).drop("action")
    return U.revert(after, image, created, ["id"])


@query(
    "created_files",
    """SELECT p_partkey AS n, rel_path FROM (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN 'PIONEER/' WHEN 1 THEN 'Contents/' WHEN 2 THEN '_Serato_/' ELSE 'x.bak-1/' END || p_name || ' ' || p_partkey AS rel_path FROM part)
       WHERE p_size > 25 AND NOT starts_with(rel_path, 'PIONEER/') AND NOT starts_with(rel_path, '_Serato_/') AND NOT contains(rel_path, '.bak-')""",
)
def created_files(spark, sf):
    """Every file before, and the files of longer tracks after, the conversion."""
    n = c("p_partkey")
    top = F.when(n % 4 == 0, "PIONEER/").when(n % 4 == 1, "Contents/").when(n % 4 == 2, "_Serato_/").otherwise("x.bak-1/")
    after = S.table(spark, sf, "part").select(
        F.lit("/d").alias("root"), n.alias("n"), "p_size", F.concat(top, "p_name", F.lit(" "), n.cast("string")).alias("rel_path")
    )
    return U.created_files(after.where("p_size <= 25"), after, ".bak-").select("n", "rel_path")


@query(
    "distinct_sources",
    "SELECT DISTINCT o_orderstatus AS format, o_orderpriority AS path FROM orders",
)
def distinct_sources(spark, sf):
    """U4."""
    o = S.table(spark, sf, "orders").select(c("o_orderstatus").alias("format"), c("o_orderpriority").alias("path"))
    return U.distinct_sources(o)


# --- written libraries --------------------------------------------------------------------------------
def _labelled(spark, sf):
    """The base catalogue as one library for each brand."""
    return S.tracks_a(spark, sf).select(c("artist").alias("library_id"), "track_id", "ordinal", "location", "title", "file_size")


@query(
    "written_libraries",
    with_views(
        "tracks_a",
        """SELECT artist AS library_id, track_id, location, CASE WHEN n_changed THEN title || ' again' ELSE title END AS title FROM (
             SELECT *, right(artist, 1) IN ('2', '4') AS n_changed, right(artist, 1) = '4' AS gone FROM tracks_a) WHERE NOT gone""",
    ),
)
def written_libraries(spark, sf):
    """K1, M8: one folder for each library; a second write replaces the changed libraries alone, one of which has no tracks left."""
    folder = record_written(f"{shared_folder(spark).rstrip('/')}/segue/neutral-{uuid.uuid4().hex}")
    t = _labelled(spark, sf)
    neutral.write_tables({"tracks": t}, folder)
    changed = t.where(F.substring("library_id", -1, 1).isin("2", "4")).select("library_id").distinct()
    after = t.withColumn("title", F.concat("title", F.lit(" again"))).where(F.substring("library_id", -1, 1) != "4")
    neutral.write_tables({"tracks": after}, folder, changed=changed)
    back = neutral.read_tables(spark, folder, ("tracks",))["tracks"]
    return back.select(c("library_id").cast("string").alias("library_id"), "track_id", "location", "title")


# --- documents -------------------------------------------------------------------------------------
@query("xml_documents")
def xml_documents(spark, sf):
    """K2 + F10: the whole collection as document lines."""
    t = full_tracks(spark, sf)
    marks = X.rekordbox_marks(S.cues(spark, sf, "all"), ["library_id", "track_id"])
    nodes = S.nodes(spark, sf, "a").select(
        "library_id", "node_id", F.lit("").alias("parent_id"), "name", "is_folder",
        F.slice("path", 2, 1).alias("path"),
        F.array(F.struct(c("ordinal").alias("seq"), c("node_id").alias("id"))).alias("sort_key"),
    )
    lines = D.document_lines(
        t, S.tempo(spark, sf, "a").drop("pair_id"), marks, nodes, S.entries(spark, sf, "all").drop("pair_id")
    )
    return lines.select("library_id", "section", F.to_json("key").alias("key"), "line")
