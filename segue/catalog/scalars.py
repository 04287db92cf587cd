"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from segue import standins as S
from segue.catalog.registry import query
from segue.catalog.sql import norm_sql, rules_sql, view, with_views
from segue.functions import colours as K
from segue.functions import cues as Q
from segue.functions import grid as G
from segue.functions import keys as KEY
from segue.functions import locations as L
from segue.functions import numbers as N
from segue.functions import text as T
from segue.operators.rewrite import apply_rule_table, apply_rules, parse_rule_lines

c = F.col


def milli(x):
    return N.half_even(x * 1000)


def sql_milli(x: str) -> str:
    return f"round_even(({x}) * 1000, 0)::BIGINT"


# --- paths ------------------------------------------------------------------------------
def paths(spark, sf):
    name = F.concat("title", F.lit(" "), c("n").cast("string"))
    m = c("n") % 5
    return S.tracks_a(spark, sf).select(
        "n", "title", "artist", "p_size",
        F.when(m == 0, F.concat(F.lit("/usb/Music/"), "artist", F.lit("/"), name, F.lit(".mp3")))
        .when(m == 1, F.concat(F.lit("C:\\Music\\"), "artist", F.lit("\\"), name, F.lit(".MP3")))
        .when(m == 2, F.concat(F.lit("\\\\nas\\share\\"), name, F.lit(".tar.Flac")))
        .when(m == 3, F.concat(F.lit("D:/DJ/50% off + more~*/"), name))
        .otherwise(F.concat(F.lit("//nas/share/"), name, F.lit(".ogg")))
        .alias("path"),
    )


view(
    "paths",
    r"""SELECT n, title, artist, p_size, CASE n % 5
      WHEN 0 THEN '/usb/Music/' || artist || '/' || title || ' ' || n || '.mp3'
      WHEN 1 THEN 'C:\Music\' || artist || '\' || title || ' ' || n || '.MP3'
      WHEN 2 THEN '\\nas\share\' || title || ' ' || n || '.tar.Flac'
      WHEN 3 THEN 'D:/DJ/50% off + more~*/' || title || ' ' || n
      ELSE '//nas/share/' || title || ' ' || n || '.ogg' END AS path FROM tracks_a""",
    "tracks_a",
)
_NAME = r"regexp_extract(replace(path, '\', '/'), '[^/]*$')"


@query(
    "path_parts",
    with_views(
        "paths",
        rf"""SELECT n, replace(path, '\', '/') AS normalised,
          substr(path, 2, 1) = ':' OR starts_with(path, '\\') AS is_windows,
          {_NAME} AS file_name, lower(regexp_extract({_NAME}, '\.([^.]*)$', 1)) AS extension,
          regexp_replace({_NAME}, '\.[^.]*$', '') AS stem,
          CASE WHEN p_size % 3 = 0 THEN artist || ' - ' || title WHEN p_size % 3 = 1 THEN title
               ELSE {_NAME} END AS shown FROM paths""",
    ),
)
def path_parts(spark, sf):
    """S1-S4."""
    p = paths(spark, sf)
    artist = F.when(c("p_size") % 3 == 0, c("artist")).otherwise("")
    title = F.when(c("p_size") % 3 == 2, F.lit("")).otherwise(c("title"))
    return p.select(
        "n", T.normalise_path(c("path")).alias("normalised"),
        T.is_windows_path(c("path")).alias("is_windows"), T.file_name(c("path")).alias("file_name"),
        T.extension(c("path")).alias("extension"),
        T.name_without_extension(c("path")).alias("stem"),
        T.display_name(artist, title, c("path")).alias("shown"),
    )


@query(
    "normalised_text",
    f"SELECT doc_id, md5({norm_sql("replace(text, 'ß', 'ss')")}) AS normalised FROM documents",
)
def normalised_text(spark, sf):
    """S5 over whole documents in four languages."""
    return S.table(spark, sf, "documents").select(
        "doc_id", F.md5(T.norm_text(c("text")).cast("binary")).alias("normalised")
    )


@query(
    "location_codec",
    with_views(
        "paths",
        r"""SELECT n, location, CASE WHEN starts_with(replace(path, '\', '/'), '//') THEN substr(replace(path, '\', '/'), 3) ELSE replace(path, '\', '/') END AS decoded
          FROM (SELECT n, path, CASE
            WHEN regexp_matches(replace(path, '\', '/'), '^[A-Za-z]:/') THEN 'file://localhost/' ||
              replace(replace(url_encode(replace(path, '\', '/')), '%2F', '/'), '%3A', ':')
            WHEN starts_with(replace(path, '\', '/'), '//') THEN 'file:' ||
              replace(url_encode(replace(path, '\', '/')), '%2F', '/')
            ELSE 'file://localhost' || replace(url_encode(path), '%2F', '/') END AS location FROM paths)""",
    ),
)
def location_codec(spark, sf):
    """Path -> XML location -> path."""
    loc = L.path_to_location(c("path"))
    back = L.location_to_path(c("location"))
    return paths(spark, sf).select("n", loc.alias("location")).select(
        "n", "location", back.alias("decoded")
    )


@query(
    "page_url_paths",
    r"""SELECT page_id, url_decode(replace(regexp_replace(url, '^file://(localhost)?', ''), '+', '%2B')) AS decoded,
        lower(regexp_extract(regexp_extract(url, '[^/]*$'), '\.([^.]*)$', 1)) AS extension FROM pages""",
)
def page_url_paths(spark, sf):
    """S3, S12 on real-world URLs."""
    return S.table(spark, sf, "pages").select(
        "page_id", L.location_to_path(c("url")).alias("decoded"),
        T.extension(c("url")).alias("extension"),
    )


@query(
    "root_relative_paths",
    with_views(
        "paths",
        r"""SELECT n, rel, '/USB/music' || '/' || rel AS absolute FROM (
          SELECT n, ltrim(CASE WHEN starts_with(lower(p), '/usb/music/') THEN substr(p, 12)
            WHEN regexp_matches(p, '^[A-Za-z]:/') THEN substr(p, 4) ELSE p END, '/') AS rel
          FROM (SELECT n, replace(path, '\', '/') AS p FROM paths))""",
    ),
)
def root_relative_paths(spark, sf):
    """S13."""
    root = F.lit("/USB/music/")
    rel = L.to_root_relative(c("path"), root)
    return paths(spark, sf).select("n", rel.alias("rel")).select(
        "n", "rel", L.from_root_relative(c("rel"), root).alias("absolute")
    )


@query(
    "fat_safe_names",
    r"""SELECT p_partkey, CASE WHEN s2 = '' THEN 'Unknown' ELSE trim(s2) END AS safe,
        regexp_extract(y, '^\s*(\d{4})', 1) AS year,
        CASE WHEN y = '0' THEN '' ELSE y END AS year_text
      FROM (SELECT p_partkey, y, rtrim(substr(rtrim(trim(regexp_replace(raw, '[<>:"/\\|?*\x00-\x1f]', '_', 'g')), '.'), 1, 12), ' .') AS s2
        FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '0' ELSE ' ' || (1900 + p_size) || '-05' END AS y,
          CASE WHEN p_partkey % 7 = 0 THEN '...' ELSE ' ' || p_name || CASE p_partkey % 3 WHEN 0 THEN '/x? ' WHEN 1 THEN ' a. .' ELSE ':<b>' END END AS raw
          FROM part))""",
)
def fat_safe_names(spark, sf):
    """S16, S17."""
    p = S.table(spark, sf, "part")
    m = c("p_partkey") % 3
    raw = F.when(c("p_partkey") % 7 == 0, "...").otherwise(
        F.concat(
            F.lit(" "), "p_name",
            F.when(m == 0, "/x? ").when(m == 1, " a. .").otherwise(":<b>"),
        )
    )
    year = F.when(m == 0, "0").otherwise(
        F.concat(F.lit(" "), (c("p_size") + 1900).cast("string"), F.lit("-05"))
    )
    return T.with_fat_safe(
        p.select(
            "p_partkey", raw.alias("safe"), T.year_digits(year).alias("year"),
            T.year_or_empty(year).alias("year_text"),
        ),
        {"safe": 12},
    )


@query(
    "analysis_folders",
    with_views(
        "tracks_a",
        """SELECT track_id, '/PIONEER/USBANLZ/P' || lpad(upper(to_hex((r & 1) | ((r >> 1) & 2) | ((r >> 4) & 4)
            | ((r >> 4) & 8) | ((r >> 5) & 16) | ((r >> 8) & 32) | ((r >> 10) & 64))), 3, '0')
            || '/' || lpad(upper(to_hex(r)), 8, '0') AS folder
          FROM (SELECT track_id, list_reduce(list_transform(range(1, len(location) + 1), lambda i: ord(location[i])::BIGINT),
              lambda h, u: (((h * 23497 + u) & 4294967295) * 37813 + u) & 4294967295, 0::BIGINT) % 200003 AS r
            FROM tracks_a)""",
    ),
)
def analysis_folders(spark, sf):
    """S19."""
    return S.tracks_a(spark, sf).select(
        "track_id", L.analysis_folder(c("location")).alias("folder")
    )


@query(
    "file_kinds",
    with_views(
        "paths",
        r"""SELECT n, coalesce(kind, '') AS kind, CASE WHEN n % 11 = 0 THEN 6 ELSE coalesce(code, 1) END AS file_type,
             ext IN ('ogg','oga','opus','wma','ape','wv','caf','mka','webm') AS unplayable
           FROM (SELECT n, lower(regexp_extract(regexp_extract(replace(path, '\', '/'), '[^/]*$'), '\.([^.]*)$', 1)) AS ext FROM paths)
           LEFT JOIN (VALUES ('mp3','MP3 File',1), ('flac','FLAC File',5), ('wav','WAV File',11)) AS v(ext, kind, code) USING (ext)""",
    ),
)
def file_kinds(spark, sf):
    """S27, C6."""
    ext = T.extension(c("path"))
    codec = F.when(c("n") % 11 == 0, F.lit("alac"))
    return paths(spark, sf).select(
        "n", L.kind_label(ext).alias("kind"), L.file_type_code(ext, codec).alias("file_type"),
        L.is_unplayable(ext).alias("unplayable"),
    )


@query(
    "playlist_names",
    """SELECT o_orderkey, CASE WHEN crate THEN 'Crates / ' ELSE '' END || o_orderpriority || ' / ' || o_orderkey AS path,
          o_orderpriority || ' / ' || o_orderkey AS flat
        FROM (SELECT *, o_orderstatus = 'F' AS crate FROM orders)""",
)
def playlist_names(spark, sf):
    """S25."""
    crate = c("o_orderstatus") == "F"
    parents = F.when(crate, F.array(F.lit("Crates"), c("o_orderpriority"))).otherwise(
        F.array(c("o_orderpriority"))
    )
    name = c("o_orderkey").cast("string")
    return S.table(spark, sf, "orders").select(
        "o_orderkey", L.playlist_path(parents, name).alias("path"),
        L.flat_playlist_name(parents, name, crate).alias("flat"),
    )


# --- keys and colours ---------------------------------------------------------------------
_WHEEL = """(VALUES (0,'C',8),(1,'Db',3),(2,'D',10),(3,'Eb',5),(4,'E',12),(5,'F',7),(6,'F#',2),(7,'G',9),
  (8,'Ab',4),(9,'A',11),(10,'Bb',6),(11,'B',1)) AS maj(tonic, note, num)"""


@query(
    "musical_keys",
    f"""WITH k AS (SELECT p_partkey, p_partkey % 12 AS tonic, (p_partkey // 12) % 2 = 1 AS minor,
            (p_partkey // 24) % 3 AS style FROM part),
          m AS (SELECT k.*, maj.note, CASE WHEN minor THEN rel.num ELSE maj.num END AS num FROM k
            JOIN {_WHEEL} ON maj.tonic = k.tonic
            JOIN {_WHEEL.replace('maj(', 'rel(')} ON rel.tonic = (k.tonic + 3) % 12)
        SELECT p_partkey, tonic, minor, note || CASE WHEN minor THEN 'm' ELSE '' END AS musical,
          num || CASE WHEN minor THEN 'A' ELSE 'B' END AS camelot,
          ((num + 4) % 12 + 1) || CASE WHEN minor THEN 'm' ELSE 'd' END AS open_key,
          tonic + CASE WHEN minor THEN 13 ELSE 1 END AS chromatic, true AS round_trip FROM m""",
)
def musical_keys(spark, sf):
    """Each key written in one notation, parsed, and written in all of them."""
    n = c("p_partkey")
    key = KEY.make_key((n % 12).cast("int"), (F.floor(n / 12) % 2) == 1)
    style = F.floor(n / 24) % 3
    text = (
        F.when(style == 0, KEY.format_key(c("k"), "camelot"))
        .when(style == 1, KEY.format_key(c("k"), "open_key"))
        .otherwise(KEY.format_key(c("k"), "musical"))
    )
    parsed = S.table(spark, sf, "part").select("p_partkey", key.alias("k")).select(
        "p_partkey", KEY.parse_key(F.concat(F.lit(" "), text)).alias("k")
    )
    k = c("k")
    return parsed.select(
        "p_partkey", k["tonic"].alias("tonic"), k["minor"].alias("minor"),
        KEY.format_key(k, "musical").alias("musical"), KEY.format_key(k, "camelot").alias("camelot"),
        KEY.format_key(k, "open_key").alias("open_key"), KEY.chromatic_id(k).alias("chromatic"),
        (KEY.key_from_chromatic_id(KEY.chromatic_id(k)) == k).alias("round_trip"),
    )


def _sql_list(values) -> str:
    return "[" + ", ".join(str(v) for v in values) + "]"


def _sql_nearest(values) -> str:
    """1-based index of the nearest palette entry."""
    return (
        f"list_min(list_transform({_sql_list(values)}, lambda p, i: {{'d': 2 * (((x >> 16) & 255) - ((p >> 16) & 255)) ** 2"
        " + 4 * (((x >> 8) & 255) - ((p >> 8) & 255)) ** 2 + 3 * ((x & 255) - (p & 255)) ** 2, 'i': i})).i"
    )


_COLOUR = "SELECT p_partkey, (p_partkey * 7919 + p_size * 65537) % 16777216 AS x FROM part"


@query(
    "palette_colours",
    f"""SELECT p_partkey, x >> 16 AS r, (x >> 8) & 255 AS g, x & 255 AS b, x AS packed,
          upper(lpad(to_hex(x), 6, '0')) AS hex,
          {_sql_list(K.REKORDBOX_TRACK)}[{_sql_nearest(K.REKORDBOX_TRACK)}] AS track_colour,
          {_sql_nearest(K.REKORDBOX_TRACK)} AS track_colour_id,
          {_sql_list(K.REKORDBOX_CUE)}[{_sql_nearest(K.REKORDBOX_CUE)}] AS cue_colour
        FROM ({_COLOUR})""",
)
def palette_colours(spark, sf):
    """S8, S10, S11."""
    x = ((c("p_partkey") * 7919 + c("p_size") * 65537) % 16777216).cast("int")
    t = S.table(spark, sf, "part").select("p_partkey", x.alias("x"))
    x = c("x")
    return t.select(
        "p_partkey", K.red(x).alias("r"), K.green(x).alias("g"), K.blue(x).alias("b"),
        K.pack_rgb(K.red(x), K.green(x), K.blue(x)).alias("packed"), K.hex_rgb(x).alias("hex"),
        K.rekordbox_track_colour(x).alias("track_colour"),
        K.rekordbox_track_colour_id(x).alias("track_colour_id"),
        K.nearest(x, K.REKORDBOX_CUE).alias("cue_colour"),
    )


@query(
    "serato_colours",
    f"""WITH s AS (SELECT p_partkey, p_size % 8 AS slot, CASE WHEN p_size % 5 = 0 THEN NULL ELSE x END AS x,
            CASE WHEN p_size % 4 = 0 THEN {_sql_list(K.SERATO_STORED)}[1 + p_partkey % 18]
                 WHEN p_size % 4 = 1 THEN 16777215 ELSE x END AS stored
          FROM (SELECT *, (p_partkey * 7919 + p_size * 65537) % 16777216 AS x FROM part))
        SELECT p_partkey,
          CASE WHEN stored = 16777215 THEN NULL
               ELSE coalesce({_sql_list(K.SERATO_SHOWN)}[list_position({_sql_list(K.SERATO_STORED)}, stored)], stored) END AS cue_shown,
          CASE WHEN x IS NULL THEN {_sql_list([K.SERATO_STORED[i] for i in K.SERATO_DEFAULT_CUE_INDEX])}[slot + 1]
               ELSE {_sql_list(K.SERATO_STORED)}[{_sql_nearest(K.SERATO_SHOWN)}] END AS cue_stored,
          CASE WHEN stored = 16777215 THEN NULL WHEN stored = 10066329 THEN 592137 WHEN stored = 0 THEN 3355443
               WHEN stored < 6710886 THEN stored + 10066330 ELSE stored - 6710886 END AS track_shown,
          CASE WHEN x IS NULL THEN 16777215 WHEN near = 3355443 THEN 0
               WHEN near < 10066330 THEN near + 6710886 ELSE near - 10066330 END AS track_stored
        FROM (SELECT *, {_sql_list(K.SERATO_TRACK)}[{_sql_nearest(K.SERATO_TRACK)}] AS near FROM s)""",
)
def serato_colours(spark, sf):
    """S9."""
    n, size = c("p_partkey"), c("p_size")
    x = ((n * 7919 + size * 65537) % 16777216).cast("int")
    stored = F.get(F.array(*[F.lit(v) for v in K.SERATO_STORED]), (n % 18).cast("int"))
    t = S.table(spark, sf, "part").select(
        "p_partkey", (size % 8).alias("slot"), F.when(size % 5 != 0, x).alias("x"),
        F.when(size % 4 == 0, stored).when(size % 4 == 1, 0xFFFFFF).otherwise(x).alias("stored"),
    )
    return t.select(
        "p_partkey", K.serato_cue_shown(c("stored")).alias("cue_shown"),
        K.serato_cue_stored(c("x"), c("slot")).alias("cue_stored"),
        K.serato_track_shown(c("stored")).alias("track_shown"),
        K.serato_track_stored(c("x")).alias("track_stored"),
    )


# --- numbers ---------------------------------------------------------------------------------
@query(
    "lenient_numbers",
    """WITH t AS (SELECT p_partkey, p_size,
            CASE p_partkey % 4 WHEN 0 THEN '' || p_size || '.75' WHEN 1 THEN 'x' || p_size WHEN 2 THEN '-' || p_size ELSE '' END AS num,
            CASE p_partkey % 3 WHEN 0 THEN (p_size % 5) || ':' || p_size || ':07.5' WHEN 1 THEN p_size || ':30' ELSE 'oops' END AS clock,
            CASE p_partkey % 4 WHEN 0 THEN '44100' WHEN 1 THEN '44.1k' WHEN 2 THEN '48.0 kHz' ELSE '' END AS rate,
            CASE p_partkey % 3 WHEN 0 THEN '2020-02-' || lpad('' || p_size, 2, '0') || 'T10:00' WHEN 1 THEN '2021-05-01' ELSE 'soon' END AS day FROM part)
       SELECT p_partkey, coalesce(try_cast(num AS DOUBLE), 0.0) AS as_double,
         coalesce(trunc(try_cast(num AS DOUBLE)), 0)::INT AS as_int,
         (CASE p_partkey % 3 WHEN 0 THEN ((p_size % 5) * 60 + p_size) * 60 + 7.5 WHEN 1 THEN p_size * 60 + 30.0 ELSE 0.0 END)::DOUBLE AS seconds,
         CASE p_partkey % 4 WHEN 0 THEN 44100 WHEN 1 THEN 44100 WHEN 2 THEN 48000 ELSE 0 END AS hz,
         CAST(try_cast(substr(day, 1, 10) AS DATE) AS VARCHAR) AS added,
         round_even((p_partkey % 256) / 51, 0)::INT AS stars,
         greatest(0, least(5, p_size - 10)) * 51 AS stars_255,
         CASE WHEN rtrim(rtrim(t2, '0'), '.') IN ('', '-0', '-') THEN '0' ELSE rtrim(rtrim(t2, '0'), '.') END AS number
       FROM (SELECT *, printf('%.3f', (p_partkey % 16 - 8) / 8.0) AS t2 FROM t)""",
)
def lenient_numbers(spark, sf):
    """S14, S15, S18."""
    n, size = c("p_partkey"), c("p_size")
    txt = size.cast("string")
    num = (
        F.when(n % 4 == 0, F.concat(txt, F.lit(".75")))
        .when(n % 4 == 1, F.concat(F.lit("x"), txt))
        .when(n % 4 == 2, F.concat(F.lit("-"), txt))
        .otherwise("")
    )
    clock = (
        F.when(n % 3 == 0, F.concat((size % 5).cast("string"), F.lit(":"), txt, F.lit(":07.5")))
        .when(n % 3 == 1, F.concat(txt, F.lit(":30")))
        .otherwise("oops")
    )
    rate = F.when(n % 4 == 0, "44100").when(n % 4 == 1, "44.1k").when(n % 4 == 2, "48.0 kHz").otherwise("")
    day = (
        F.when(n % 3 == 0, F.concat(F.lit("2020-02-"), F.lpad(txt, 2, "0"), F.lit("T10:00")))
        .when(n % 3 == 1, "2021-05-01")
        .otherwise("soon")
    )
    return S.table(spark, sf, "part").select(
        "p_partkey", N.lenient_double(num).alias("as_double"), N.lenient_int(num).alias("as_int"),
        N.clock_seconds(clock).alias("seconds"), N.sample_rate(rate).alias("hz"),
        N.lenient_date(day).cast("string").alias("added"),
        N.stars_from_255(n % 256).alias("stars"), N.stars_to_255(size - 10).alias("stars_255"),
        T.number_text((n % 16 - 8) / F.lit(8.0)).alias("number"),
    )


# --- cue and grid scalars ------------------------------------------------------------------------
@query(
    "cue_codes",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_shipdate::DATE AS VARCHAR) AS day,
         CASE l_linenumber % 6 WHEN 0 THEN 'cue' WHEN 1 THEN 'fade_in' WHEN 2 THEN 'fade_out' WHEN 3 THEN 'main' WHEN 4 THEN 'loop' ELSE 'cue' END AS role,
         CASE l_linenumber % 6 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 4 ELSE 0 END AS mark,
         CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 5 THEN 3 WHEN 6 THEN 4 WHEN 7 THEN 5 END AS slot,
         CASE WHEN l_quantity >= 1 AND abs(l_quantity * 500 * 125 / 60000 - round_even(l_quantity * 500 * 125 / 60000, 0)) < 0.02
                AND round_even(l_quantity * 500 * 125 / 60000, 0) >= 1
              THEN round_even(l_quantity * 500 * 125 / 60000, 0)::INT END AS beats
       FROM lineitem""",
)
def cue_codes(spark, sf):
    """S21, S22, S24."""
    li = S.table(spark, sf, "lineitem")
    role = Q.role_of_mark(c("l_linenumber") % 6)
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        c("l_shipdate").cast("date").cast("string").alias("day"),
        role.alias("role"), Q.mark_of_role(role).alias("mark"),
        Q.slot_of_kind(c("l_linenumber")).alias("slot"),
        Q.loop_beats(F.lit(0.0), c("l_quantity") * 500, F.lit(125)).alias("beats"),
    )


@query(
    "mixxx_cue_units",
    f"""WITH r AS (SELECT *, CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 6 WHEN 5 THEN 7 WHEN 6 THEN 5 ELSE 1 END AS kind,
            CASE WHEN l_returnflag = 'N' THEN -1.0 ELSE l_extendedprice END AS pos, l_quantity * 100 - 500 AS len FROM lineitem),
          v AS (SELECT *, CASE WHEN pos >= 0 THEN pos / (44100 * 2 / 1000.0) + 26 END AS start, greatest(0.0, len / (44100 * 2 / 1000.0)) AS span FROM r)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
          CASE kind WHEN 1 THEN 'cue' WHEN 2 THEN 'main' WHEN 4 THEN 'loop' WHEN 6 THEN 'intro' ELSE 'outro' END AS role,
          {sql_milli('coalesce(start, span + 26)')} AS position,
          {sql_milli("CASE WHEN start IS NOT NULL AND (kind = 4 OR (kind IN (6, 7) AND span > 0)) THEN start + span END")} AS end_at,
          CASE WHEN kind IN (1, 4) AND l_suppkey % 9 > 0 THEN l_suppkey % 9 - 1 END AS slot,
          CASE WHEN start IS NULL THEN CASE kind WHEN 6 THEN 'Intro end' ELSE 'Outro end' END ELSE '' END AS name
        FROM v WHERE (kind IN (1, 2) AND start IS NOT NULL) OR (kind = 4 AND start IS NOT NULL AND span > 0)
          OR (kind IN (6, 7) AND (start IS NOT NULL OR span > 0))""",
)
def mixxx_cue_units(spark, sf):
    """Samples to milliseconds, end-only ranges, invalid cues dropped."""
    li = S.table(spark, sf, "lineitem")
    ln = c("l_linenumber")
    kind = (
        F.when(ln == 2, 2).when(ln == 3, 4).when(ln == 4, 6).when(ln == 5, 7).when(ln == 6, 5)
        .otherwise(1)
    )
    cue = Q.mixxx_cue(
        kind, (c("l_suppkey") % 9 - 1),
        F.when(c("l_returnflag") == "N", -1.0).otherwise(c("l_extendedprice")),
        c("l_quantity") * 100 - 500, F.lit(255), F.lit("\x00"), F.lit(44100), F.lit(26.0),
    )
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    q = li.select(*keys, cue.alias("q")).where("q IS NOT NULL")
    return q.select(
        *keys, c("q.role").alias("role"), milli(c("q.position_ms")).alias("position"),
        milli(c("q.end_ms")).alias("end_at"), c("q.slot").alias("slot"), c("q.name").alias("name"),
    )


@query(
    "first_downbeats",
    f"""SELECT p_partkey, {sql_milli("p - bar * floor(p / bar)")} AS downbeat FROM (
        SELECT p_partkey, 240000.0 / (60 + p_size) AS bar,
          p_partkey * 7.5 - (p_partkey % 4) * 60000.0 / (60 + p_size) AS p FROM part)""",
)
def first_downbeats(spark, sf):
    """S20."""
    n = c("p_partkey")
    return S.table(spark, sf, "part").select(
        "p_partkey",
        milli(G.first_downbeat_ms(n * 7.5, c("p_size") + 60, n % 4 + 1)).alias("downbeat"),
    )


@query(
    "beat_frames",
    f"""SELECT map_id, pos AS beat, {sql_milli('p')} AS position FROM (
        SELECT map_id, unnest(l) AS p, generate_subscripts(l, 1) AS pos FROM (
          SELECT event_id // 64 AS map_id, list_sort(list(floor(value * 100) * 1000.0 / 44100 + 26)) AS l FROM events
          WHERE event_type <> 'error' AND value >= 1 GROUP BY 1))""",
)
def beat_frames(spark, sf):
    """Enabled, non-negative frames in order, as milliseconds."""
    e = S.table(spark, sf, "events")
    frame = F.when(c("value") >= 1, F.floor(c("value") * 100)).otherwise(-1).cast("bigint")
    # a beat map is one row of the landed table; here 64 consecutive events stand in for it
    maps = e.groupBy(F.floor(c("event_id") / 64).alias("map_id")).agg(
        F.collect_list(
            F.struct(frame.alias("frame"), (c("event_type") != "error").alias("enabled"))
        ).alias("frames")
    )
    ms = G.beat_frames_to_ms(c("frames"), F.lit(44100), F.lit(26.0))
    return maps.select("map_id", F.posexplode(ms).alias("i", "p")).select(
        "map_id", (c("i") + 1).alias("beat"), milli(c("p")).alias("position")
    )


# --- rules ---------------------------------------------------------------------------------------
RULE_TEXT = "\n".join(f"{old} => {new}" for old, new in S.PATH_RULES) + "\n => /skipped\nno arrow"


@query(
    "path_rules_rewrite",
    with_views(
        "tracks_b paths",
        f"""SELECT 'b' AS source, n, {rules_sql('location')} AS rewritten FROM tracks_b
            UNION ALL SELECT 'p', n, {rules_sql('path')} FROM paths""",
    ),
)
def path_rules_rewrite(spark, sf):
    """J11 with literal rules."""
    b = S.tracks_b(spark, sf).select(F.lit("b").alias("source"), "n", c("location").alias("path"))
    p = paths(spark, sf).select(F.lit("p").alias("source"), "n", "path")
    return b.unionByName(p).select(
        "source", "n", apply_rules(c("path"), S.PATH_RULES).alias("rewritten")
    )


def _rule_table(spark, sf):
    """The rule text once per region, so the rules come as a table."""
    regions = S.table(spark, sf, "region").select(
        c("r_name").alias("rule_set"), F.lit(RULE_TEXT).alias("text")
    )
    return parse_rule_lines(regions, "text", ["rule_set"])


@query(
    "path_rules_table",
    with_views(
        "tracks_b paths",
        f"""SELECT r_name AS rule_set, source, n, {rules_sql('path')} AS rewritten FROM
            (SELECT 'b' AS source, n, location AS path FROM tracks_b UNION ALL SELECT 'p', n, path FROM paths)
            JOIN region ON r_regionkey = n % 5""",
    ),
)
def path_rules_table(spark, sf, max_broadcast=50_000):
    """S26 + J11 with a rule table, one rule set per region."""
    b = S.tracks_b(spark, sf).select(F.lit("b").alias("source"), "n", c("location").alias("path"))
    p = paths(spark, sf).select(F.lit("p").alias("source"), "n", "path")
    sets = S.table(spark, sf, "region").select("r_regionkey", c("r_name").alias("rule_set"))
    rows = b.unionByName(p).join(sets, c("n") % 5 == c("r_regionkey")).drop("r_regionkey")
    out = apply_rule_table(
        rows, _rule_table(spark, sf), ["rule_set", "source", "n"], "path", "rewritten",
        max_broadcast,
    )
    return out.select("rule_set", "source", "n", "rewritten")


@query(
    "path_rules_table_shuffled",
    with_views(
        "tracks_b paths",
        f"""SELECT r_name AS rule_set, source, n, {rules_sql('path')} AS rewritten FROM
            (SELECT 'b' AS source, n, location AS path FROM tracks_b UNION ALL SELECT 'p', n, path FROM paths)
            JOIN region ON r_regionkey = n % 5""",
    ),
)
def path_rules_table_shuffled(spark, sf):
    """J11 as it runs when the rule table is too large to broadcast."""
    return path_rules_table(spark, sf, max_broadcast=0)


# --- predicates -----------------------------------------------------------------------------------
@query(
    "hidden_and_search",
    r"""SELECT page_id, len(list_filter(string_split(rel, '/'), lambda p: p <> '.mixxx' AND (starts_with(p, '.') OR starts_with(p, '$')))) > 0 AS hidden,
          contains(lower(url), 'page=') AS found
        FROM (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN '.Trash/' WHEN 1 THEN '.mixxx/' ELSE '$RECYCLE.BIN/' END
          || regexp_replace(url, '^https?://[^/]*/', '') AS rel FROM pages)""",
)
def hidden_and_search(spark, sf):
    """C4, C5."""
    from segue.operators.reports import in_hidden_folder, search

    n = c("page_id")
    rel = F.concat(
        F.when(n % 3 == 0, ".Trash/").when(n % 3 == 1, ".mixxx/").otherwise("$RECYCLE.BIN/"),
        F.regexp_replace("url", "^https?://[^/]*/", ""),
    )
    return S.table(spark, sf, "pages").select(
        "page_id", in_hidden_folder(rel).alias("hidden"),
        search("PAGE=", c("url")).alias("found"),
    )
