"""Merging two libraries: metadata, cues, grids, playlists, reports."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from segue import standins as S
from segue.catalog.matching import OPTIONS, matched
from segue.catalog.registry import query
from segue.catalog.scalars import milli, sql_milli
from segue.catalog.sql import VIEWS, rules_sql, with_views
from segue.operators import merge as M
from segue.operators.playlists import merge_playlists, with_parents
from segue.operators.sync import merge_libraries, needs_writing, sync_both_ways
from segue.options import MergeOptions
from segue.session import materialise

c = F.col


def _pairs(spark, sf):
    a, b = S.tracks_a(spark, sf), S.tracks_b(spark, sf)
    return a, b, M.links(a, b, matched(spark, sf))


_META = """SELECT a.track_id, {title} AS title, {artist} AS artist, {genre} AS genre,
      coalesce({changed}, false) AS changed
    FROM tracks_a a LEFT JOIN links l ON l.base_id = a.track_id LEFT JOIN tracks_b b ON b.track_id = l.incoming_id"""


@query(
    "merged_metadata_fill",
    with_views(
        "links tracks_a tracks_b",
        _META.format(
            title="a.title", artist="a.artist",
            genre="CASE WHEN a.genre = '' THEN coalesce(b.genre, '') ELSE a.genre END",
            changed="a.genre = '' AND b.genre <> ''",
        ),
    ),
)
def merged_metadata_fill(spark, sf):
    """M1, empty fields only."""
    a, b, pairs = _pairs(spark, sf)
    out = M.merge_metadata(a, b.select("pair_id", "track_id", "title", "artist", "genre"), pairs, OPTIONS)
    return out.select("track_id", "title", "artist", "genre", "changed")


@query(
    "merged_metadata_replace",
    with_views(
        "links tracks_a tracks_b",
        _META.format(
            **{
                f: f"CASE WHEN b.{f} <> '' THEN b.{f} ELSE a.{f} END"
                for f in ("title", "artist", "genre")
            },
            changed="(b.title <> '' AND b.title <> a.title) OR (b.artist <> '' AND b.artist <> a.artist) OR (b.genre <> '' AND b.genre <> a.genre)",
        ),
    ),
)
def merged_metadata_replace(spark, sf):
    """M1, incoming values preferred."""
    a, b, pairs = _pairs(spark, sf)
    opts = MergeOptions(metadata="replace", path_rules=OPTIONS.path_rules)
    out = M.merge_metadata(a, b.select("pair_id", "track_id", "title", "artist", "genre"), pairs, opts)
    return out.select("track_id", "title", "artist", "genre", "changed")


def _merged_cues(spark, sf, opts):
    _, _, pairs = _pairs(spark, sf)
    inc = M.to_base_ids(S.cues(spark, sf, "b"), pairs, ("position_ms", "end_ms"))
    return M.merge_cues(S.cues(spark, sf, "a"), inc, opts)


def _cue_walk(first: str, second: str) -> str:
    """Greedy walk over the second side's cues of each track with incoming cues."""
    spot = "(role = 'loop') || '|' || round_even(position_ms / 5, 0)::BIGINT"
    return f"""
    f1 AS (SELECT track_id, list_distinct(list({spot})) AS spots, list_distinct(list(slot) FILTER (slot IS NOT NULL)) AS slots
      FROM {first} GROUP BY 1),
    s1 AS (SELECT track_id, list({{'o': ordinal, 's': slot, 'k': {spot}}} ORDER BY ordinal) AS l FROM {second}
      WHERE track_id IN (SELECT track_id FROM inc_cues) GROUP BY 1),
    cwalk AS (SELECT s1.track_id, l, 1 AS k, coalesce(spots, []) AS spots, coalesce(slots, []) AS slots,
        NULL::BIGINT AS kept FROM s1 LEFT JOIN f1 USING (track_id)
      UNION ALL
      SELECT track_id, l, k + 1, CASE WHEN ok THEN list_append(spots, l[k].k) ELSE spots END,
        CASE WHEN ok AND l[k].s IS NOT NULL THEN list_append(slots, l[k].s) ELSE slots END,
        CASE WHEN ok THEN l[k].o END
      FROM (SELECT *, NOT list_contains(spots, l[k].k) AND (l[k].s IS NULL OR NOT list_contains(slots, l[k].s)) AS ok
            FROM cwalk WHERE k <= len(l))),
    merged AS (
      SELECT track_id, ordinal, role, position_ms, slot, name FROM cues_a WHERE track_id NOT IN (SELECT track_id FROM inc_cues)
      UNION ALL SELECT track_id, ordinal, role, position_ms, slot, name FROM {first} WHERE track_id IN (SELECT track_id FROM inc_cues)
      UNION ALL SELECT s.track_id, s.ordinal, role, position_ms, slot, name FROM {second} s
        JOIN cwalk w ON w.track_id = s.track_id AND w.kept = s.ordinal)"""


_CUE_COLS = f"SELECT track_id, ordinal, role, {sql_milli('position_ms')} AS at, slot, name FROM merged"


def _cue_rows(df):
    return df.select("track_id", "ordinal", "role", milli(c("position_ms")).alias("at"), "slot", "name")


@query(
    "merged_cues",
    with_views("inc_cues cues_a", _CUE_COLS, _cue_walk("inc_cues", "cues_a")),
)
def merged_cues(spark, sf):
    """M2 merge, incoming preferred."""
    return _cue_rows(_merged_cues(spark, sf, OPTIONS)[0])


@query(
    "merged_cues_base_first",
    with_views("inc_cues cues_a", _CUE_COLS, _cue_walk("cues_a", "inc_cues")),
)
def merged_cues_base_first(spark, sf):
    """M2 merge, base preferred."""
    return _cue_rows(_merged_cues(spark, sf, MergeOptions(prefer="base"))[0])


_REPLACED = """merged AS (
      SELECT track_id, ordinal, role, position_ms, slot, name FROM cues_a WHERE track_id NOT IN (SELECT track_id FROM inc_cues)
      UNION ALL SELECT track_id, ordinal, role, position_ms, slot, name FROM inc_cues)"""


@query(
    "replaced_cues",
    with_views("inc_cues cues_a", _CUE_COLS, _REPLACED),
)
def replaced_cues(spark, sf):
    """M2 replace."""
    return _cue_rows(_merged_cues(spark, sf, MergeOptions(cues="replace"))[0])


@query(
    "filled_cues",
    with_views(
        "inc_cues cues_a", _CUE_COLS,
        """merged AS (SELECT track_id, ordinal, role, position_ms, slot, name FROM cues_a
      UNION ALL SELECT track_id, ordinal, role, position_ms, slot, name FROM inc_cues WHERE track_id NOT IN (SELECT track_id FROM cues_a))""",
    ),
)
def filled_cues(spark, sf):
    """M2 fill."""
    return _cue_rows(_merged_cues(spark, sf, MergeOptions(cues="fill"))[0])


def _marks_sql(src: str) -> str:
    place = "(role = 'loop') || '|' || round_even(position_ms / 5, 0)::BIGINT"
    return f"""SELECT track_id, 'spot|' || {place} AS m FROM {src}
        UNION SELECT track_id, 'hot|' || slot || '|' || {place} FROM {src} WHERE slot < 8
        UNION SELECT track_id, 'name|' || slot || '|' || name FROM {src} WHERE slot < 8 AND name <> ''"""


_CHANGED = f"""{_REPLACED}, bm AS ({_marks_sql('cues_a')}), am AS ({_marks_sql('merged')})"""


@query(
    "changed_cue_tracks",
    with_views(
        "inc_cues cues_a",
        "SELECT DISTINCT track_id FROM ((SELECT * FROM bm EXCEPT SELECT * FROM am) UNION ALL (SELECT * FROM am EXCEPT SELECT * FROM bm))",
        _CHANGED,
    ),
)
def changed_cue_tracks(spark, sf):
    """M5: tracks whose visible marks a replacing merge changes."""
    return _merged_cues(spark, sf, MergeOptions(cues="replace"))[1].select("track_id")


@query(
    "shifted_cues",
    with_views(
        "inc_cues",
        f"SELECT track_id, ordinal, {sql_milli('position_ms')} AS at, {sql_milli('end_ms')} AS end_at FROM inc_cues",
    ),
)
def shifted_cues(spark, sf):
    """T4: matched cues on the base file's timeline."""
    _, _, pairs = _pairs(spark, sf)
    inc = M.to_base_ids(S.cues(spark, sf, "b"), pairs, ("position_ms", "end_ms"))
    return inc.select(
        "track_id", "ordinal", milli(c("position_ms")).alias("at"), milli(c("end_ms")).alias("end_at")
    )


def _grids(spark, sf, opts):
    _, _, pairs = _pairs(spark, sf)
    inc = M.to_base_ids(S.tempo(spark, sf, "b"), pairs, ("position_ms",))
    return M.merge_grids(S.tempo(spark, sf, "a"), inc, opts)


_GRID = f"SELECT track_id, {sql_milli('position_ms')} AS at, {sql_milli('bpm')} AS bpm, beat FROM"


@query(
    "merged_grids_fill",
    with_views(
        "inc_tempo tempo_a",
        f"""{_GRID} tempo_a UNION ALL {_GRID} inc_tempo
            WHERE track_id NOT IN (SELECT track_id FROM tempo_a)""",
    ),
)
def merged_grids_fill(spark, sf):
    """M3 fill."""
    merged, _, _ = _grids(spark, sf, OPTIONS)
    return merged.select("track_id", milli(c("position_ms")).alias("at"), milli(c("bpm")).alias("bpm"), "beat")


@query(
    "changed_grids_replace",
    with_views(
        "inc_tempo tempo_a",
        """SELECT DISTINCT track_id FROM (
             (SELECT * FROM (SELECT track_id, round_even(position_ms, 0) p, round_even(bpm, 2) t FROM tempo_a WHERE track_id IN (SELECT track_id FROM inc_tempo))
              EXCEPT ALL SELECT track_id, round_even(position_ms, 0), round_even(bpm, 2) FROM inc_tempo)
             UNION ALL
             (SELECT track_id, round_even(position_ms, 0) p, round_even(bpm, 2) t FROM inc_tempo
              EXCEPT ALL SELECT track_id, round_even(position_ms, 0), round_even(bpm, 2) FROM tempo_a))""",
    ),
)
def changed_grids_replace(spark, sf):
    """M3 replace: tracks whose grid visibly changes."""
    return _grids(spark, sf, MergeOptions(grids="replace"))[2].select("track_id")


@query(
    "added_tracks",
    with_views(
        "matches tracks_b",
        f"""SELECT 'sync:' || track_id AS track_id, {rules_sql('location')} AS location, title FROM tracks_b
            WHERE track_id NOT IN (SELECT incoming_id FROM matches)""",
    ),
)
def added_tracks(spark, sf):
    """U1."""
    out = M.new_tracks(S.tracks_b(spark, sf), matched(spark, sf), OPTIONS)
    return out.select("track_id", "location", "title")


@query(
    "first_track_per_id",
    """SELECT CAST(l_partkey AS VARCHAR) AS track_id, min(o) AS ordinal, arg_min(l_suppkey, o) AS l_suppkey
       FROM (SELECT *, (l_orderkey * 8 + l_linenumber) * 1000000000 + (l_suppkey * 7919 + round_even(l_extendedprice * 100, 0)::BIGINT) % 1000000000 AS o FROM lineitem) GROUP BY 1""",
)
def first_track_per_id(spark, sf):
    """Duplicate ids keep the first row."""
    li = S.table(spark, sf, "lineitem").select(
        F.lit("L").alias("library_id"), c("l_partkey").cast("string").alias("track_id"),
        S._line_ordinal().alias("ordinal"), "l_suppkey",
    )
    return M.first_by_id(li).select("track_id", "ordinal", "l_suppkey")


# --- playlists ------------------------------------------------------------------------------
def _lists(spark, sf, policy):
    ids = M.id_map(S.tracks_b(spark, sf), matched(spark, sf), OPTIONS)
    return merge_playlists(
        S.nodes(spark, sf, "a"), S.entries(spark, sf, "a"), S.nodes(spark, sf, "b"),
        S.entries(spark, sf, "b"), ids, policy,
    )


_LISTS = """olds AS (SELECT l_orderkey AS k, 'a:' || l_partkey AS track_id,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'a:' || l_partkey) AS position
      FROM lineitem WHERE l_suppkey % 2 = 1),
    incs AS (SELECT l_orderkey AS k, merged_id AS track_id, l_linenumber AS ln, o_orderstatus = 'P' AS new
      FROM lineitem JOIN idmap ON incoming_id = 'b:' || l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey % 2 = 0)"""


@query(
    "merged_playlists",
    with_views(
        "idmap",
        """SELECT 'a:' || k AS node_id, position, track_id FROM olds
        UNION ALL SELECT CASE WHEN new THEN 'sync:b:' ELSE 'a:' END || f.k, row_number() OVER (PARTITION BY f.k ORDER BY ln, f.track_id)
            + CASE WHEN new THEN 0 ELSE coalesce(n, 0) END, f.track_id
          FROM (SELECT * FROM incs WHERE new OR NOT EXISTS (SELECT 1 FROM olds WHERE olds.k = incs.k AND olds.track_id = incs.track_id)) f
          LEFT JOIN (SELECT k, count(*) AS n FROM olds GROUP BY k) s ON s.k = f.k""",
        _LISTS,
    ),
)
def merged_playlists(spark, sf):
    """M4 merge."""
    return _lists(spark, sf, "merge")[1].select("node_id", "position", "track_id")


@query(
    "replaced_playlists",
    with_views(
        "idmap",
        """SELECT 'a:' || k AS node_id, position, track_id FROM olds JOIN orders ON o_orderkey = k WHERE o_orderstatus = 'P'
        UNION ALL SELECT CASE WHEN new THEN 'sync:b:' ELSE 'a:' END || k, row_number() OVER (PARTITION BY k ORDER BY ln, track_id), track_id FROM incs""",
        _LISTS,
    ),
)
def replaced_playlists(spark, sf):
    """M4 replace."""
    return _lists(spark, sf, "replace")[1].select("node_id", "position", "track_id")


@query(
    "added_playlists",
    with_views(
        "idmap",
        """SELECT 'a:' || k AS node_id, position, track_id FROM olds
        UNION ALL SELECT 'sync:b:' || k, row_number() OVER (PARTITION BY k ORDER BY ln, track_id), track_id FROM incs WHERE new""",
        _LISTS,
    ),
)
def added_playlists(spark, sf):
    """M4 add."""
    return _lists(spark, sf, "add")[1].select("node_id", "position", "track_id")


@query(
    "playlist_merge_report",
    with_views(
        "idmap",
        """SELECT 'ab' AS pair_id, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS playlists_added,
          (SELECT count(DISTINCT k) FROM incs WHERE NOT new AND NOT EXISTS
            (SELECT 1 FROM olds WHERE olds.k = incs.k AND olds.track_id = incs.track_id)) AS playlists_updated""",
        _LISTS,
    ),
)
def playlist_merge_report(spark, sf):
    """Lists added and changed by a merge."""
    return _lists(spark, sf, "merge")[2]


@query(
    "merged_playlist_nodes",
    """WITH top AS (SELECT max(o_orderkey) AS t FROM orders),
      base AS (SELECT 'a:' || o_orderkey AS node_id, o_orderkey AS ordinal, o_orderpriority || '/' || o_orderkey AS path, o_orderkey % 7 = 0 AS is_folder FROM orders
        UNION ALL SELECT DISTINCT 'a:' || o_orderpriority, 0, o_orderpriority, true FROM orders WHERE o_orderpriority < '3'),
      added AS (SELECT 'sync:b:' || o_orderkey AS node_id, t + o_orderkey + 1 AS ordinal, o_orderpriority AS f,
        o_orderpriority || '/' || CASE WHEN o_orderstatus = 'P' THEN 'new ' ELSE '' END || o_orderkey AS path FROM orders, top
        WHERE o_orderstatus = 'P' OR o_orderkey % 7 = 0),
      nodes AS (SELECT * FROM base UNION ALL SELECT node_id, ordinal, path, false FROM added
        UNION ALL SELECT 'sync:folder:["' || f || '"]', min(ordinal), f, true FROM added WHERE f >= '3' GROUP BY f)
      SELECT n.node_id, n.ordinal, n.path, n.is_folder, p.node_id AS parent_id
      FROM nodes n LEFT JOIN nodes p ON p.is_folder AND contains(n.path, '/') AND p.path = split_part(n.path, '/', 1)""",
)
def merged_playlist_nodes(spark, sf):
    """M4: lists and folders after a merge; some folders are there already, and at some lists'
    paths the base has a folder."""
    base = S.nodes(spark, sf, "a").withColumn("is_folder", c("ordinal") % 7 == 0)
    folder = S.table(spark, sf, "orders").where("o_orderpriority < '3'").select("o_orderpriority").distinct().select(
        F.lit("ab").alias("pair_id"), F.lit("A").alias("library_id"),
        F.concat(F.lit("a:"), "o_orderpriority").alias("node_id"), F.lit(0).cast("bigint").alias("ordinal"),
        F.array("o_orderpriority").alias("path"), c("o_orderpriority").alias("name"),
        F.lit(True).alias("is_folder"), F.lit(False).alias("is_crate"),
    )
    ids = S.tracks_b(spark, sf).select("pair_id", c("track_id").alias("incoming_id"), c("track_id").alias("merged_id"))
    nodes, _, _ = merge_playlists(
        base.unionByName(folder), S.entries(spark, sf, "a"), S.nodes(spark, sf, "b"), S.entries(spark, sf, "b"), ids
    )
    return with_parents(nodes).select("node_id", "ordinal", F.array_join("path", "/").alias("path"), "is_folder", "parent_id")


_SYNC = f"""{_REPLACED.strip()}, bm AS ({_marks_sql('cues_a')}), am AS ({_marks_sql('merged')}),
    cue_changed AS (SELECT DISTINCT track_id FROM ((SELECT * FROM bm EXCEPT SELECT * FROM am) UNION ALL (SELECT * FROM am EXCEPT SELECT * FROM bm))),
    meta_changed AS (SELECT a.track_id FROM tracks_a a JOIN links l ON l.base_id = a.track_id JOIN tracks_b b ON b.track_id = l.incoming_id
      WHERE (b.title <> '' AND b.title <> a.title) OR (b.artist <> '' AND b.artist <> a.artist) OR (b.genre <> '' AND b.genre <> a.genre)),
    grid_changed AS (SELECT DISTINCT track_id FROM inc_tempo WHERE track_id NOT IN (SELECT track_id FROM tempo_a)),
    {_LISTS}"""


@query(
    "sync_report",
    with_views(
        "inc_cues cues_a inc_tempo tempo_a idmap tracks_a",
        """SELECT 'ab' AS pair_id, (SELECT count(*) FROM matches) AS matched,
          (SELECT count(*) FROM tracks_b) - (SELECT count(*) FROM matches) AS added,
          (SELECT count(*) FROM (SELECT track_id FROM cue_changed UNION SELECT track_id FROM meta_changed UNION SELECT track_id FROM grid_changed)) AS updated,
          (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS playlists_added,
          (SELECT count(DISTINCT k) FROM incs WHERE NOT new AND NOT EXISTS
            (SELECT 1 FROM olds WHERE olds.k = incs.k AND olds.track_id = incs.track_id)) AS playlists_updated""",
        _SYNC,
    ),
)
def sync_report(spark, sf):
    """The whole merge, counted."""
    opts = MergeOptions(cues="replace", metadata="replace", path_rules=OPTIONS.path_rules)
    return merge_libraries(S.library(spark, sf, "a"), _incoming(spark, sf), opts)[1]


def _incoming(spark, sf):
    lib = S.library(spark, sf, "b")
    return lib.with_(tracks=lib.tracks.select("pair_id", "library_id", "track_id", "ordinal", "location", "title", "artist", "genre", "duration_s", "file_size", "bpm", "p_size", "n"))


# --- the same library merged once more: the views of a merge, over the merged tables ------
_ONCE = "bkeys m1 m2 blocks walk m3 m4 matches inc_cues inc_tempo idmap f1 s1 cwalk merged bm am"


def _again(sql: str) -> str:
    """The same SQL with the merged library as base."""
    sql = re.sub(rf"\b({'|'.join([*_ONCE.split(), 'links'])})\b", r"\1_2", sql)
    sql = sql.replace("arg_max(id, ordinal)", "arg_max(id, {'o': ordinal, 'id': id})")
    return re.sub(r"\b(tracks|cues)_a\b", r"\1_m", sql)


_WALK = _cue_walk("inc_cues", "cues_a")
_SECOND = f"""{_WALK}, {_LISTS},
    tracks_m AS (SELECT track_id, ordinal, location, title, artist, genre, duration_s, file_size FROM tracks_a
      UNION ALL SELECT 'sync:' || track_id, ordinal, {rules_sql('location')}, title, artist, genre, duration_s, file_size
      FROM tracks_b WHERE track_id NOT IN (SELECT incoming_id FROM matches)),
    cues_m AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY position_ms, ordinal) AS ordinal, role, position_ms, slot, name
      FROM (SELECT * FROM merged UNION ALL SELECT 'sync:' || track_id, ordinal, role, position_ms, slot, name
        FROM cues_b WHERE track_id NOT IN (SELECT incoming_id FROM matches))),
    {', '.join(f'{v}_2 AS ({_again(VIEWS[v][1])})' for v in 'bkeys m1 m2 blocks walk m3 m4 matches'.split())},
    links_2 AS (SELECT incoming_id, base_id, CASE WHEN (i.location LIKE '%.mp3') = (b.location LIKE '%.mp3') THEN 0.0
        WHEN b.location LIKE '%.mp3' THEN 26.0 ELSE -26.0 END AS shift
      FROM matches_2 JOIN tracks_b i ON i.track_id = incoming_id JOIN tracks_m b ON b.track_id = base_id),
    {', '.join(f'{v}_2 AS ({_again(VIEWS[v][1])})' for v in 'inc_cues inc_tempo idmap'.split())},
    {_again(_WALK)}, bm AS ({_marks_sql('cues_m')}), am AS ({_marks_sql('merged_2')}),
    changed AS (
      SELECT track_id FROM (SELECT * FROM bm EXCEPT SELECT * FROM am) UNION SELECT track_id FROM (SELECT * FROM am EXCEPT SELECT * FROM bm)
      UNION SELECT m.track_id FROM tracks_m m JOIN links_2 ON base_id = m.track_id JOIN tracks_b b ON b.track_id = incoming_id
        WHERE m.genre = '' AND b.genre <> ''
      UNION SELECT track_id FROM inc_tempo_2 WHERE track_id NOT LIKE 'sync:%' AND track_id NOT IN (SELECT track_id FROM tempo_a)
        AND track_id NOT IN (SELECT track_id FROM inc_tempo)),
    olds_2 AS (SELECT k, track_id FROM olds JOIN orders ON o_orderkey = k WHERE o_orderstatus <> 'P' UNION SELECT k, track_id FROM incs),
    incs_2 AS (SELECT l_orderkey AS k, merged_id AS track_id FROM lineitem JOIN idmap_2 ON incoming_id = 'b:' || l_partkey WHERE l_suppkey % 2 = 0),
    counts AS (SELECT (SELECT count(*) FROM tracks_b) - (SELECT count(*) FROM matches_2) AS added, (SELECT count(*) FROM changed) AS updated,
      (SELECT count(DISTINCT k) FROM incs_2 ANTI JOIN olds_2 USING (k, track_id)) AS playlists_updated)"""


@query(
    "second_sync_report",
    with_views(
        "inc_cues cues_a cues_b inc_tempo tempo_a tempo_b idmap tracks_a tracks_b",
        """SELECT 'ab' AS pair_id, added, updated, 0 AS playlists_added, playlists_updated,
          CASE WHEN added + updated + playlists_updated > 0 THEN 1 ELSE 0 END AS to_write FROM counts""",
        _SECOND,
    ),
)
def second_sync_report(spark, sf):
    """M7, M8: the same library merged once more. Where its matches are clear nothing changes; tracks alike
    in name that were added before are candidates now, and may be paired anew."""
    merged, _ = merge_libraries(S.library(spark, sf, "a"), _incoming(spark, sf), OPTIONS)
    merged = merged.with_(cues=M.numbered_cues(merged.cues))
    tables = {f: materialise(getattr(merged, f), f"merged-{f}") for f in ("tracks", "cues", "tempo", "nodes", "entries")}
    report = materialise(merge_libraries(merged.with_(**tables), _incoming(spark, sf), OPTIONS)[1], "second-report")
    writes = report.join(needs_writing(report).withColumn("w", F.lit(1)), "pair_id", "left")
    return writes.select("pair_id", "added", "updated", "playlists_added", "playlists_updated", F.coalesce("w", F.lit(0)).alias("to_write"))


# --- and the other way round: the views of a merge with the sides exchanged ------------------
def _back(sql: str) -> str:
    """The same SQL with library b as base and a as the incoming one."""
    sql = re.sub(rf"\b({'|'.join([*_ONCE.split(), 'links', 'ikeys'])})\b", r"\1_r", sql)
    return re.sub(r"\b(tracks|cues|tempo)_([ab])\b", lambda m: f"{m[1]}_{'ba'['ab'.index(m[2])]}", sql)


_BACK_RULES = "CASE WHEN starts_with(lower(location), '/usb/music/') THEN '/home/dj/Music' || substr(location, 11) ELSE location END"
_BOTH_WAYS = f"""{_WALK}, {_LISTS},
    ikeys_r AS ({_back(VIEWS['ikeys'][1].replace(rules_sql('location'), _BACK_RULES))}),
    {', '.join(f'{v}_r AS ({_back(VIEWS[v][1])})' for v in 'bkeys m1 m2 blocks walk m3 m4 matches'.split())},
    links_r AS (SELECT incoming_id, base_id, CASE WHEN b.location LIKE '%.mp3' THEN 0.0 ELSE -26.0 END AS shift
      FROM matches_r JOIN tracks_b b ON b.track_id = base_id),
    {', '.join(f'{v}_r AS ({_back(VIEWS[v][1])})' for v in 'inc_cues inc_tempo idmap'.split())},
    {_back(_cue_walk('cues_a', 'inc_cues'))},
    bm AS ({_marks_sql('cues_a')}), am AS ({_marks_sql('merged')}), bm_r AS ({_marks_sql('cues_b')}), am_r AS ({_marks_sql('merged_r')}),
    changed AS (
      SELECT track_id FROM (SELECT * FROM bm EXCEPT SELECT * FROM am) UNION SELECT track_id FROM (SELECT * FROM am EXCEPT SELECT * FROM bm)
      UNION SELECT a.track_id FROM tracks_a a JOIN links ON base_id = a.track_id JOIN tracks_b b ON b.track_id = incoming_id WHERE a.genre = '' AND b.genre <> ''
      UNION SELECT track_id FROM inc_tempo WHERE track_id NOT IN (SELECT track_id FROM tempo_a)),
    changed_r AS (
      SELECT track_id FROM (SELECT * FROM bm_r EXCEPT SELECT * FROM am_r) UNION SELECT track_id FROM (SELECT * FROM am_r EXCEPT SELECT * FROM bm_r)
      UNION SELECT b.track_id FROM tracks_b b JOIN links_r ON base_id = b.track_id JOIN tracks_a a ON a.track_id = incoming_id WHERE b.genre = '' AND a.genre <> ''
      UNION SELECT track_id FROM inc_tempo_r WHERE track_id NOT IN (SELECT track_id FROM tempo_b)),
    olds_r AS (SELECT l_orderkey AS k, 'b:' || l_partkey AS track_id FROM lineitem WHERE l_suppkey % 2 = 0),
    incs_r AS (SELECT l_orderkey AS k, merged_id AS track_id FROM lineitem JOIN idmap_r ON incoming_id = 'a:' || l_partkey
      JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey % 2 = 1 AND o_orderstatus <> 'P'),
    fresh AS (SELECT count(*) AS lists FROM orders WHERE o_orderstatus = 'P')"""


@query(
    "two_way_sync_report",
    with_views(
        "inc_cues cues_a cues_b inc_tempo tempo_a tempo_b idmap tracks_a tracks_b",
        """SELECT 'ab' AS pair_id, (SELECT count(*) FROM matches) AS matched,
          (SELECT count(*) FROM tracks_b) - (SELECT count(*) FROM matches) AS added, (SELECT count(*) FROM changed) AS updated,
          lists AS playlists_added, (SELECT count(DISTINCT k) FROM (SELECT * FROM incs WHERE NOT new) ANTI JOIN olds USING (k, track_id)) AS playlists_updated,
          'b to a' AS direction FROM fresh
        UNION ALL SELECT 'ab', (SELECT count(*) FROM matches_r), (SELECT count(*) FROM tracks_a) - (SELECT count(*) FROM matches_r),
          (SELECT count(*) FROM changed_r), lists, (SELECT count(DISTINCT k) FROM incs_r ANTI JOIN olds_r USING (k, track_id)), 'a to b' FROM fresh""",
        _BOTH_WAYS,
    ),
)
def two_way_sync_report(spark, sf):
    """M6: both directions from the originals, one preference."""
    there, back = sync_both_ways(_incoming(spark, sf), S.library(spark, sf, "a"), OPTIONS)
    # one after the other: in one plan the driver would hold the shuffles of both merges until the last ends
    reports = [materialise(r.withColumn("direction", F.lit(d)), "sync-report") for (_, r), d in ((there, "b to a"), (back, "a to b"))]
    return reports[0].unionByName(reports[1])
