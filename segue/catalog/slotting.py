"""Slot allocation over every track's cues."""

from __future__ import annotations

from pyspark.sql import functions as F

from segue import standins as S
from segue.catalog.registry import query
from segue.catalog.scalars import _sql_list, milli, sql_milli
from segue.catalog.sql import view, with_views
from segue.functions import colours as K
from segue.functions import locations as L
from segue.operators import slots as X

c = F.col
T = ["track_id"]


def rich_cues(spark, sf):
    """All roles, slots up to 38, close and repeated positions."""
    m = F.pmod(c("ordinal"), F.lit(7))
    role = (
        F.when(m == 0, "main").when(m == 1, "intro").when(m == 2, "outro").when(m == 3, "fade_in")
        .otherwise(c("role"))
    )
    q = S.cues(spark, sf, "all").withColumn("role", role)
    slot = F.when(c("slot") < 3, c("slot")).otherwise(c("slot") + F.pmod(c("ordinal"), F.lit(4)).cast("int") * 10)
    return q.select(
        "track_id", "ordinal", "role", (F.pmod(c("position_ms"), F.lit(3000.0)) + 0.25).alias("position_ms"),
        F.when(c("role") == "loop", F.pmod(c("position_ms"), F.lit(3000.0)) + F.pmod(c("ordinal"), F.lit(2000))).alias("end_ms"),
        F.when(F.pmod(c("ordinal"), F.lit(3)) > 0, slot).cast("int").alias("slot"),
        F.when(c("name") == "F", "").otherwise(c("name")).alias("name"), "colour", "locked",
    )


view(
    "rich_cues",
    """SELECT track_id, ordinal, role, position_ms, CASE WHEN role = 'loop' THEN position_ms - 0.25 + ordinal % 2000 END AS end_ms,
         CASE WHEN ordinal % 3 > 0 THEN CASE WHEN slot < 3 THEN slot ELSE slot + (ordinal % 4) * 10 END END::INT AS slot,
         CASE WHEN name = 'F' THEN '' ELSE name END AS name, colour
       FROM (SELECT track_id, ordinal, CASE ordinal % 7 WHEN 0 THEN 'main' WHEN 1 THEN 'intro' WHEN 2 THEN 'outro' WHEN 3 THEN 'fade_in' ELSE role END AS role,
         position_ms % 3000 + 0.25 AS position_ms, slot, name, colour FROM cues_all)""",
    "cues_all",
)
_ITEM = "{'o': ordinal, 'r': role, 'p': position_ms, 'e': end_ms, 's': slot, 'n': name, 'c': colour}"


@query(
    "mixxx_slots",
    with_views(
        "rich_cues",
        f"""SELECT track_id, x.o AS ordinal, kind, hotcue, {sql_milli('x.p')} AS at,
              {sql_milli("CASE WHEN kind = 4 THEN x.e - x.p WHEN kind IN (6, 7) THEN greatest(0.0, coalesce(x.e - x.p, 0.0)) ELSE 0.0 END")} AS length,
              CASE WHEN hotcue < 0 THEN 0 ELSE coalesce(x.c, {_sql_list(K.MIXXX_CUE)}[hotcue % 8 + 1]) END AS colour, x.n AS name
            FROM mwalk WHERE kind IS NOT NULL""",
        f"""l1 AS (SELECT track_id, list({_ITEM} ORDER BY slot IS NULL, coalesce(slot, 0), position_ms, ordinal) AS l FROM rich_cues GROUP BY 1),
        l2 AS (SELECT track_id, l, list_transform(list_filter(l, lambda y: y.s IS NOT NULL AND y.r <> 'loop'), lambda y: y.p) AS hot,
            list_filter(range(8, 36), lambda s: len(list_filter(l, lambda y: y.s = s)) = 0) AS free FROM l1),
        mwalk AS (SELECT track_id, l, hot, free, 1 AS k, false AS has_main, []::INT[] AS placed, 1 AS nf,
            l[1] AS x, NULL::INT AS kind, NULL::INT AS hotcue FROM l2
          UNION ALL
          SELECT track_id, l, hot, free, k + 1, has_main OR act = 'main',
            CASE WHEN act IN ('own', 'free') THEN list_append(placed, tgt::INT) ELSE placed END,
            CASE WHEN act = 'free' THEN nf + 1 ELSE nf END, x,
            CASE act WHEN 'main' THEN 2 WHEN 'range' THEN CASE x.r WHEN 'intro' THEN 6 ELSE 7 END
              WHEN 'own' THEN CASE WHEN x.r = 'loop' AND coalesce(x.e - x.p, 0) > 0 THEN 4 ELSE 1 END
              WHEN 'free' THEN CASE WHEN x.r = 'loop' AND coalesce(x.e - x.p, 0) > 0 THEN 4 ELSE 1 END END,
            CASE WHEN act IN ('main', 'range') THEN -1 WHEN act IN ('own', 'free') THEN tgt END::INT
          FROM (SELECT *, CASE
                WHEN x.r = 'main' AND NOT has_main THEN 'main'
                WHEN x.r IN ('intro', 'outro') AND es IS NULL THEN 'range'
                WHEN es IS NULL AND x.r <> 'loop' AND len(list_filter(hot, lambda h: abs(h - x.p) < 5)) > 0 THEN 'drop'
                WHEN es IS NOT NULL THEN 'own'
                WHEN nf <= len(free) THEN 'free' ELSE 'drop' END AS act,
                CASE WHEN es IS NOT NULL THEN es ELSE free[nf] END AS tgt
              FROM (SELECT * REPLACE (l[k] AS x), CASE WHEN l[k].s < 36 AND NOT list_contains(placed, l[k].s) THEN l[k].s END AS es
                FROM mwalk WHERE k <= len(l))))""",
    ),
)
def mixxx_slots(spark, sf):
    """F8."""
    out = X.mixxx_slots(rich_cues(spark, sf), T)
    return out.select(
        "track_id", "ordinal", "kind", "hotcue", milli(c("position_ms")).alias("at"),
        milli(c("length_ms")).alias("length"), "colour", "name",
    )


_SERATO_WALK = f"""own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, slot ORDER BY position_ms, ordinal) AS rn
          FROM rich_cues WHERE slot < 8) WHERE rn = 1),
        l1 AS (SELECT track_id, list({_ITEM} ORDER BY position_ms, slot IS NULL, slot, ordinal) AS l FROM rich_cues
          WHERE role <> 'loop' AND (track_id, ordinal) NOT IN (SELECT (track_id, ordinal) FROM own) GROUP BY 1),
        l2 AS (SELECT l1.track_id, l, coalesce(pos, []) AS pos, list_filter(range(0, 8), lambda s: NOT list_contains(coalesce(used, []), s)) AS free
          FROM l1 LEFT JOIN (SELECT track_id, list(round_even(position_ms, 0)) AS pos, list(slot) AS used FROM own GROUP BY 1) USING (track_id)),
        ewalk AS (SELECT track_id, l, pos, free, 1 AS k, 1 AS nf, NULL::INT AS slot, NULL::BIGINT AS stop FROM l2
          UNION ALL
          SELECT track_id, l, CASE WHEN act = 'put' THEN list_append(pos, round_even(l[k].p, 0)) ELSE pos END, free, k + 1,
            CASE WHEN act = 'put' THEN nf + 1 ELSE nf END, CASE WHEN act = 'put' THEN free[nf] END::INT,
            CASE WHEN act = 'stop' THEN k ELSE stop END
          FROM (SELECT *, CASE WHEN stop IS NOT NULL THEN 'after' WHEN len(list_filter(pos, lambda h: abs(h - l[k].p) < 5)) > 0 THEN 'near'
                WHEN nf > len(free) THEN 'stop' ELSE 'put' END AS act FROM ewalk WHERE k <= len(l)))"""
_STORED = _sql_list(K.SERATO_STORED)
_DEFAULT = _sql_list([K.SERATO_STORED[i] for i in K.SERATO_DEFAULT_CUE_INDEX])


@query(
    "serato_hot_cues",
    with_views(
        "rich_cues",
        f"""SELECT track_id, ordinal, slot, position_ms, CASE WHEN colour IS NULL THEN {_DEFAULT}[slot % 8 + 1] ELSE 52224 END AS colour, name FROM (
            SELECT track_id, ordinal, slot, round_even(position_ms, 0)::BIGINT AS position_ms, colour, name FROM own
            UNION ALL SELECT track_id, l[k - 1].o, slot, round_even(l[k - 1].p, 0)::BIGINT, l[k - 1].c,
              CASE WHEN l[k - 1].n <> '' OR l[k - 1].r = 'cue' THEN l[k - 1].n ELSE
                CASE l[k - 1].r WHEN 'fade_in' THEN 'Fade_In' WHEN 'main' THEN 'Main' WHEN 'intro' THEN 'Intro' ELSE 'Outro' END END
            FROM ewalk WHERE slot IS NOT NULL)""",
        _SERATO_WALK,
    ),
)
def serato_hot_cues(spark, sf):
    """F9, hot cues."""
    return X.serato_slots(rich_cues(spark, sf), T)[0].select(
        "track_id", "ordinal", "slot", "position_ms", "colour", "name"
    )


@query(
    "serato_saved_loops",
    with_views(
        "rich_cues",
        """SELECT track_id, ordinal, rn - 1 AS index, round_even(position_ms, 0)::BIGINT AS start_ms,
             round_even(CASE WHEN end_ms = 0 THEN position_ms ELSE end_ms END, 0)::BIGINT AS end_ms, name FROM (
             SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY position_ms, slot IS NULL, slot, ordinal) AS rn
             FROM rich_cues WHERE role = 'loop') WHERE rn <= 8""",
    ),
)
def serato_saved_loops(spark, sf):
    """F9, loops."""
    return X.serato_slots(rich_cues(spark, sf), T)[1].select(
        "track_id", "ordinal", "index", "start_ms", "end_ms", "name"
    )


@query(
    "serato_leftovers",
    with_views(
        "rich_cues",
        """SELECT track_id, coalesce(a, 0) AS leftover_cues, coalesce(b, 0) AS leftover_loops FROM
             (SELECT track_id, max(len(l) - stop + 1) AS a FROM ewalk WHERE stop IS NOT NULL GROUP BY 1) FULL JOIN
             (SELECT track_id, count(*) - 8 AS b FROM rich_cues WHERE role = 'loop' GROUP BY 1 HAVING count(*) > 8) USING (track_id)""",
        _SERATO_WALK,
    ),
)
def serato_leftovers(spark, sf):
    """Cues and loops without a slot."""
    return X.serato_slots(rich_cues(spark, sf), T)[2]


_HOT = """hot AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, slot ORDER BY position_ms, role = 'main', ordinal) AS rn
          FROM rich_cues WHERE slot < 8) WHERE rn = 1),
        mem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track_id, role = 'loop', round_even(position_ms, 0)
            ORDER BY slot IS NULL, coalesce(slot, 0), position_ms, role = 'main', ordinal) AS rn
          FROM rich_cues WHERE (track_id, ordinal) NOT IN (SELECT (track_id, ordinal) FROM hot)) WHERE rn = 1)"""


@query(
    "rekordbox_marks",
    with_views(
        "rich_cues",
        f"""SELECT track_id, ordinal, num, CASE role WHEN 'loop' THEN 4 WHEN 'fade_in' THEN 1 ELSE 0 END AS type,
              CASE WHEN name = '' AND role = 'intro' THEN 'Intro' WHEN name = '' AND role = 'outro' THEN 'Outro' ELSE name END AS name,
              {sql_milli('position_ms')} AS start_us, {sql_milli("CASE WHEN role = 'loop' THEN end_ms END")} AS end_us,
              CASE WHEN num >= 0 THEN coalesce(colour, 2679316) END AS colour
            FROM (SELECT *, slot AS num FROM hot UNION ALL SELECT *, -1 FROM mem)""",
        _HOT,
    ),
)
def rekordbox_marks(spark, sf):
    """F10, S15 defaults: marks of the XML target."""
    out = X.rekordbox_marks(rich_cues(spark, sf), T)
    return out.select(
        "track_id", "ordinal", "num", "type", "name", milli(c("start_ms")).alias("start_us"),
        milli(c("end_ms")).alias("end_us"), "colour",
    )


@query(
    "device_cue_lists",
    with_views(
        "rich_cues",
        """SELECT track_id, ordinal, 'hot' AS list, slot + 1 AS hot, CASE WHEN role = 'loop' AND end_ms > position_ms THEN 2 ELSE 1 END AS type,
             round_even(position_ms, 0)::BIGINT AS start_ms, CASE WHEN role = 'loop' AND end_ms > position_ms THEN round_even(end_ms, 0)::BIGINT END AS end_ms, name
           FROM rich_cues WHERE slot < 8 AND role IN ('cue', 'loop')
           UNION ALL
           SELECT track_id, ordinal, 'memory', 0, CASE WHEN lp THEN 2 ELSE 1 END, round_even(position_ms, 0)::BIGINT,
             CASE WHEN lp THEN round_even(end_ms, 0)::BIGINT END,
             CASE WHEN name = '' AND role = 'intro' THEN 'Intro' WHEN name = '' AND role = 'outro' THEN 'Outro' ELSE name END FROM (
             SELECT *, row_number() OVER (PARTITION BY track_id, lp, round_even(position_ms, 0) ORDER BY position_ms, role = 'main', ordinal) AS rn
             FROM (SELECT *, role = 'loop' AND coalesce(end_ms > position_ms, false) AS lp FROM rich_cues)
             WHERE NOT (coalesce(slot < 8, false) AND role IN ('cue', 'loop'))) WHERE rn = 1""",
    ),
)
def device_cue_lists(spark, sf):
    """F10, device variant."""
    return X.device_lists(rich_cues(spark, sf), T).drop("sort_key")


@query(
    "preferred_cue_lists",
    with_views(
        "rich_cues",
        """SELECT track_id, ordinal, slot FROM rich_cues WHERE name = ''
           UNION ALL SELECT track_id, ordinal, slot FROM (SELECT *, row_number() OVER
             (PARTITION BY track_id, slot, round_even(position_ms, 0) ORDER BY position_ms, ordinal) AS rn FROM rich_cues
             WHERE name <> '' AND track_id NOT IN (SELECT track_id FROM rich_cues WHERE name = '' )) WHERE rn = 1""",
    ),
)
def preferred_cue_lists(spark, sf):
    """unnamed cues stand in for the rich list, named ones for the plain list."""
    q = rich_cues(spark, sf)
    out = X.preferred_cues(q.where("name = ''"), q.where("name <> ''"), T)
    return out.select("track_id", "ordinal", "slot")


@query(
    "deduplicated_cue_lists",
    with_views(
        "rich_cues",
        """SELECT track_id, ordinal, slot FROM (SELECT *, row_number() OVER
             (PARTITION BY track_id, slot, round_even(position_ms, 0) ORDER BY position_ms, ordinal) AS rn FROM rich_cues) WHERE rn = 1""",
    ),
)
def deduplicated_cue_lists(spark, sf):
    """no track has a rich list."""
    q = rich_cues(spark, sf)
    return X.preferred_cues(q.where("name = 'none'"), q, T).select("track_id", "ordinal", "slot")


@query(
    "analysis_folder_numbers",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE::VARCHAR AS folder,
         row_number() OVER (PARTITION BY l_shipdate ORDER BY o) - 1 AS number
       FROM (SELECT *, (l_orderkey * 8 + l_linenumber) * 1000000000 + (l_suppkey * 7919 + round_even(l_extendedprice * 100, 0)::BIGINT) % 1000000000 AS o FROM lineitem)""",
)
def analysis_folder_numbers(spark, sf):
    """F12, ship dates standing in for the folders of colliding paths."""
    li = S.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        c("l_shipdate").cast("date").cast("string").alias("folder"), S._line_ordinal().alias("ordinal"),
    )
    return X.folder_numbers(li, []).drop("ordinal")


@query(
    "track_analysis_files",
    with_views(
        "tracks_a",
        """SELECT track_id, folder || '/ANLZ' || lpad(CAST(row_number() OVER (PARTITION BY folder ORDER BY ordinal) - 1 AS VARCHAR), greatest(4, length(CAST(row_number() OVER (PARTITION BY folder ORDER BY ordinal) - 1 AS VARCHAR)))::INT, '0') || '.DAT' AS file
           FROM (SELECT track_id, ordinal, '/PIONEER/USBANLZ/P' || lpad(upper(to_hex((r & 1) | ((r >> 1) & 2) | ((r >> 4) & 4)
            | ((r >> 4) & 8) | ((r >> 5) & 16) | ((r >> 8) & 32) | ((r >> 10) & 64))), 3, '0')
            || '/' || lpad(upper(to_hex(r)), 8, '0') AS folder
          FROM (SELECT track_id, ordinal, list_reduce(list_transform(range(1, len(location) + 1), lambda i: ord(location[i])::BIGINT),
              lambda h, u: (((h * 23497 + u) & 4294967295) * 37813 + u) & 4294967295, 0::BIGINT) % 200003 AS r
            FROM tracks_a))""",
    ),
)
def track_analysis_files(spark, sf):
    """F12 + S19: the file each track's analysis is stored in."""
    t = S.tracks_a(spark, sf).select(
        "library_id", "track_id", "ordinal", L.analysis_folder(c("location")).alias("folder")
    )
    number = c("number").cast("string")  # padded, never cut
    file = F.concat("folder", F.lit("/ANLZ"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0")), F.lit(".DAT"))
    return X.folder_numbers(t, ["library_id"]).select("track_id", file.alias("file"))


_SIDE = """SELECT substr(track_id, 3) AS k, CASE WHEN role = 'loop' THEN 'loop' ELSE 'cue' END AS kind,
    coalesce(slot, 9) AS index, arg_min(position_ms, ordinal) AS {p}p, arg_min(name, ordinal) AS {p}name,
    arg_min(coalesce(colour, {c}), ordinal) AS {p}colour FROM {t} GROUP BY ALL"""


@query(
    "marker_overlay",
    with_views(
        "cues_a cues_b",
        """SELECT k AS track_id, kind, index, coalesce(op, np) AS at, coalesce(nname, '') AS name,
             CASE WHEN op IS NULL OR (kind = 'loop' AND np IS NOT NULL) THEN ncolour ELSE ocolour END AS colour
           FROM n FULL JOIN o USING (k, kind, index)
           WHERE op IS NOT NULL OR kind = 'loop' OR index >= 5 OR k NOT IN (SELECT k FROM o)""",
        f"n AS ({_SIDE.format(p='n', c=7, t='cues_a')}), o AS ({_SIDE.format(p='o', c=8, t='cues_b')})",
    ),
)
def marker_overlay(spark, sf):
    """Side b's cues as the older tag over side a's."""

    def side(name, colour):
        q = S.cues(spark, sf, name).select(
            F.substring("track_id", 3, 20).alias("track_id"),
            F.when(c("role") == "loop", "loop").otherwise("cue").alias("kind"),
            F.coalesce("slot", F.lit(9)).alias("index"), "ordinal", "position_ms", "end_ms", "name",
            F.coalesce("colour", F.lit(colour)).alias("colour"), "locked",
        )
        fields = F.struct("position_ms", "end_ms", "name", "colour", "locked")
        return q.groupBy("track_id", "kind", "index").agg(F.min_by(fields, "ordinal").alias("f")).select(
            "track_id", "kind", "index", "f.*"
        )

    old = side("b", 8)
    out = X.overlay_markers(side("a", 7), old, T, old.select("track_id").distinct())
    return out.select("track_id", "kind", "index", c("position_ms").alias("at"), "name", "colour")
