"""SQL views that mirror `segue.standins`, composed into WITH preludes."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, sql: str, *needs: str) -> None:
    VIEWS[name] = (needs, sql)


def with_views(names: str, body: str, recursive: str = "") -> str:
    """``WITH RECURSIVE <views and what they need>, <extra ctes> <body>``."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for need in VIEWS[name][0]:
                add(need)
            order.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in order]
    if recursive:
        parts.append(recursive.strip().rstrip(","))
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def stem_sql(path: str) -> str:
    return norm_sql(f"regexp_replace(regexp_extract({path}, '[^/]*$'), '\\.[^.]*$', '')")


def norm_sql(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def rules_sql(path: str) -> str:
    """The stand-in rule list, longest first."""
    p = f"replace({path}, '\\', '/')"
    return f"""CASE
      WHEN lower({p}) = '/home/dj/music/none' OR starts_with(lower({p}), '/home/dj/music/none/')
        THEN '/never' || substr({p}, 20)
      WHEN lower({p}) = '/home/dj/music' OR starts_with(lower({p}), '/home/dj/music/')
        THEN '/usb/Music' || substr({p}, 15)
      WHEN lower({p}) = '/home' OR starts_with(lower({p}), '/home/') THEN '/elsewhere' || substr({p}, 6)
      WHEN lower({p}) = 'd:/dj' OR starts_with(lower({p}), 'd:/dj/') THEN '/usb/dj' || substr({p}, 6)
      ELSE {path} END"""


view(
    "tracks_a",
    """SELECT 'ab' AS pair_id, 'A' AS library_id, 'a:' || p_partkey AS track_id, p_partkey AS ordinal,
      '/usb/Music/' || p_brand || '/' || p_name || ' ' || (p_partkey % 500) || '.mp3' AS location,
      p_name AS title, p_brand AS artist, p_type AS genre, p_size::DOUBLE AS duration_s,
      round_even(p_retailprice * 100, 0)::BIGINT AS file_size, (60 + p_size)::DOUBLE AS bpm,
      p_size, p_partkey AS n FROM part""",
)
view(
    "tracks_b",
    """SELECT 'ab' AS pair_id, 'B' AS library_id, 'b:' || n AS track_id, ordinal,
      CASE WHEN n % 10 < 2 THEN '/home/dj/Music/' || artist || '/' || title || ' ' || (n % 500) || '.mp3'
           WHEN n % 10 < 4 THEN '/other/' || title || ' ' || (n % 500) || '.mp3'
           WHEN n % 10 < 6 THEN '/other/renamed ' || n || '.mp3'
           WHEN n % 10 = 6 THEN '/other/' || title || ' ' || (n % 500) || '.flac'
           ELSE '/new/file ' || n || '.mp3' END AS location,
      CASE WHEN n % 10 < 4 THEN title WHEN n % 10 < 6 THEN upper(title)
           WHEN n % 10 = 6 THEN 'other ' || title WHEN n % 10 < 9 THEN 'new ' || n
           ELSE title END AS title,
      CASE WHEN n % 10 IN (4, 5) THEN lower(artist) WHEN n % 10 IN (7, 8) THEN 'nobody ' || n
           ELSE artist END AS artist,
      CASE WHEN n % 10 < 5 THEN genre ELSE '' END AS genre,
      duration_s + CASE WHEN n % 10 IN (4, 5) THEN 1.0 WHEN n % 10 = 9 THEN 5.0 ELSE 0.0 END AS duration_s,
      CASE WHEN n % 10 < 4 THEN file_size WHEN n % 10 IN (7, 8) THEN n + 1 ELSE 0 END AS file_size,
      bpm, p_size, n FROM tracks_a""",
    "tracks_a",
)
# --- the match, tier by tier ------------------------------------------------------------
view(
    "bkeys",
    f"""SELECT track_id AS id, ordinal, lower(location) AS pk, {stem_sql('location')} AS stem,
      file_size AS size, {norm_sql('artist')} AS ak, {norm_sql('title')} AS tk,
      title <> '' AS has_title, duration_s AS d FROM tracks_a""",
    "tracks_a",
)
view(
    "ikeys",
    f"""SELECT track_id AS id, ordinal, lower({rules_sql('location')}) AS pk,
      {stem_sql('location')} AS stem, file_size AS size, {norm_sql('artist')} AS ak,
      {norm_sql('title')} AS tk, title <> '' AS has_title, duration_s AS d FROM tracks_b""",
    "tracks_b",
)
view(
    "m1",
    """SELECT i.id AS incoming_id, b.id AS base_id, 'path' AS rule FROM
      (SELECT pk, arg_min(id, ordinal) AS id FROM ikeys GROUP BY pk) i JOIN
      (SELECT pk, arg_max(id, ordinal) AS id FROM bkeys GROUP BY pk) b USING (pk)""",
    "bkeys", "ikeys",
)
view(
    "m2",
    """SELECT i.id AS incoming_id, b.id AS base_id, 'name+size' AS rule FROM
      (SELECT stem, size, arg_min(id, ordinal) AS id FROM ikeys
       WHERE size <> 0 AND id NOT IN (SELECT incoming_id FROM m1) GROUP BY ALL) i JOIN
      (SELECT stem, size, min(id) AS id FROM bkeys
       WHERE size <> 0 AND id NOT IN (SELECT base_id FROM m1) GROUP BY ALL HAVING count(*) = 1) b
      USING (stem, size)""",
    "m1",
)
view(
    "blocks",
    """SELECT b_list, i_list FROM
      (SELECT ak, tk, list({'id': id, 'd': d} ORDER BY ordinal) AS b_list FROM bkeys
       WHERE has_title AND id NOT IN (SELECT base_id FROM m1 UNION SELECT base_id FROM m2)
       GROUP BY ALL) JOIN
      (SELECT ak, tk, list({'id': id, 'd': d} ORDER BY ordinal) AS i_list FROM ikeys
       WHERE has_title AND id NOT IN (SELECT incoming_id FROM m1 UNION SELECT incoming_id FROM m2)
       GROUP BY ALL) USING (ak, tk)""",
    "m2",
)
view(
    "walk",
    """SELECT b_list, i_list, 1 AS k, []::VARCHAR[] AS taken, NULL::VARCHAR AS incoming_id,
        NULL::VARCHAR AS base_id FROM blocks
      UNION ALL
      SELECT b_list, i_list, k + 1,
        CASE WHEN len(free) = 1 THEN list_append(taken, free[1].id) ELSE taken END,
        i_list[k].id, CASE WHEN len(free) = 1 THEN free[1].id END
      FROM (SELECT *, list_filter(b_list, lambda b: NOT list_contains(taken, b.id) AND
              (i_list[k].d = 0 OR b.d = 0 OR abs(i_list[k].d - b.d) <= 2.0)) AS free
            FROM walk WHERE k <= len(i_list))""",
    "blocks",
)
view(
    "m3",
    """SELECT incoming_id, base_id, 'artist+title' AS rule FROM walk WHERE base_id IS NOT NULL""",
    "walk",
)
view(
    "m4",
    """SELECT i.id AS incoming_id, b.id AS base_id, 'file name' AS rule FROM
      (SELECT stem, arg_min(id, ordinal) AS id FROM ikeys WHERE id NOT IN
        (SELECT incoming_id FROM m1 UNION SELECT incoming_id FROM m2 UNION SELECT incoming_id FROM m3)
       GROUP BY ALL) i JOIN
      (SELECT stem, min(id) AS id FROM bkeys WHERE id NOT IN
        (SELECT base_id FROM m1 UNION SELECT base_id FROM m2 UNION SELECT base_id FROM m3)
       GROUP BY ALL HAVING count(*) = 1) b USING (stem)""",
    "m3",
)
view(
    "matches",
    "SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3 UNION ALL SELECT * FROM m4",
    "m4",
)


# --- cues, grids, playlists ---------------------------------------------------------------
def _cues(prefix: str, where: str) -> str:
    return f"""SELECT '{prefix.upper()}' AS library_id, '{prefix}:' || l_partkey AS track_id,
      (l_orderkey * 8 + l_linenumber) * 1000000000 + (l_suppkey * 7919 + round_even(l_extendedprice * 100, 0)::BIGINT) % 1000000000 AS ordinal,
      CASE WHEN l_returnflag = 'R' THEN 'loop' ELSE 'cue' END AS role,
      round_even(l_extendedprice, 0) AS position_ms,
      CASE WHEN l_returnflag = 'R' THEN round_even(l_extendedprice, 0) + l_quantity * 1000 END AS end_ms,
      CASE WHEN l_returnflag <> 'N' THEN l_linenumber - 1 END AS slot, l_linestatus AS name,
      CASE WHEN l_suppkey % 3 = 0 THEN 2679316 END AS colour FROM lineitem {where}"""


view("cues_a", _cues("a", "WHERE l_suppkey % 2 = 1"))
view("cues_b", _cues("b", "WHERE l_suppkey % 2 = 0"))
view("cues_all", _cues("a", ""))
for _side, _bpm, _where in (
    ("a", "(60 + p_size)::DOUBLE", "WHERE p_size > 10"),
    ("b", "(60 + p_size + CASE WHEN p_partkey % 4 = 0 THEN 0.5 ELSE 0.0 END)::DOUBLE", ""),
):
    view(
        f"tempo_{_side}",
        f"""SELECT '{_side}:' || p_partkey AS track_id, m.p AS position_ms, m.t AS bpm, m.b AS beat FROM
          (SELECT p_partkey, unnest([{{'p': 25.0::DOUBLE, 't': bpm, 'b': 1}},
             {{'p': 60000.0 / bpm * 64 + 25.0, 't': bpm, 'b': 1}},
             {{'p': 60000.0 / bpm * 98 + 25.0, 't': bpm + 10, 'b': 3}}]) AS m
           FROM (SELECT p_partkey, {_bpm} AS bpm FROM part {_where}))""",
    )
view(
    "links",
    """SELECT incoming_id, base_id, CASE WHEN i.location LIKE '%.mp3' THEN 0.0 ELSE 26.0 END AS shift
       FROM matches JOIN tracks_b i ON i.track_id = incoming_id""",
    "matches",
)
view(
    "inc_cues",
    """SELECT base_id AS track_id, ordinal, role, position_ms + shift AS position_ms, end_ms + shift AS end_ms,
       slot, name, colour FROM cues_b JOIN links ON track_id = incoming_id""",
    "links", "cues_b",
)
view(
    "inc_tempo",
    """SELECT base_id AS track_id, position_ms + shift AS position_ms, bpm, beat
       FROM tempo_b JOIN links ON track_id = incoming_id""",
    "links", "tempo_b",
)
view(
    "idmap",
    """SELECT t.track_id AS incoming_id, coalesce(base_id, 'sync:' || t.track_id) AS merged_id
       FROM tracks_b t LEFT JOIN matches ON incoming_id = t.track_id""",
    "matches",
)
