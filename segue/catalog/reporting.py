"""Reports, playlists, dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue import standins as S
from segue.catalog.registry import query
from segue.catalog.scalars import paths
from segue.catalog.sql import view, with_views
from segue.functions import keys as KEY
from segue.operators import dims as D
from segue.operators import playlists as P
from segue.operators import reports as R
from segue.operators import rewrite as W
from segue.operators import select as J
from segue.plans.ordered import ranked

c = F.col


@query(
    "library_summary",
    with_views(
        "cues_a cues_b tempo_a tempo_b",
        """SELECT library_id, tracks, playlists, hot_cues, memory_cues, gridded FROM
          (SELECT 'A' AS library_id, (SELECT count(*) FROM part) AS tracks, (SELECT count(*) FROM orders) AS playlists,
             (SELECT count(slot) FROM cues_a) AS hot_cues, (SELECT count(*) - count(slot) FROM cues_a) AS memory_cues,
             (SELECT count(DISTINCT track_id) FROM tempo_a) AS gridded
           UNION ALL SELECT 'B', (SELECT count(*) FROM part), (SELECT count(*) FROM orders),
             (SELECT count(slot) FROM cues_b), (SELECT count(*) - count(slot) FROM cues_b), (SELECT count(DISTINCT track_id) FROM tempo_b))""",
    ),
)
def library_summary(spark, sf):
    """G1 over two libraries."""
    cols = ["library_id", "track_id"]

    def both(make):
        return make("a").unionByName(make("b"))

    tracks = S.tracks_a(spark, sf).select(*cols).unionByName(S.tracks_b(spark, sf).select(*cols))
    return R.library_summary(
        tracks, both(lambda s: S.cues(spark, sf, s)), both(lambda s: S.tempo(spark, sf, s)),
        both(lambda s: S.nodes(spark, sf, s)),
    )


@query(
    "track_rows",
    with_views(
        "tracks_a cues_all tempo_a",
        """SELECT track_id, artist, title, round_even(bpm, 2) AS bpm, location, coalesce(h, 0) AS hot_cues, coalesce(m, 0) AS memory_cues,
             coalesce(g, 0) AS grid FROM tracks_a
           LEFT JOIN (SELECT track_id, count(slot) AS h, count(*) - count(slot) AS m FROM cues_all GROUP BY 1) USING (track_id)
           LEFT JOIN (SELECT track_id, count(*) AS g FROM tempo_a GROUP BY 1) USING (track_id)""",
    ),
)
def track_rows(spark, sf):
    """G3."""
    out = R.track_rows(S.tracks_a(spark, sf), S.cues(spark, sf, "all"), S.tempo(spark, sf, "a"))
    return out.drop("library_id")


@query(
    "playlist_sizes",
    """SELECT 'a:' || o_orderkey AS node_id, coalesce(n, 0) AS tracks, o_orderstatus = 'F' AS is_crate FROM orders
       LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def playlist_sizes(spark, sf):
    """G4."""
    out = R.playlist_sizes(S.nodes(spark, sf, "a"), S.entries(spark, sf, "all"))
    return out.select("node_id", "tracks", "is_crate")


_FOLDER = r"""array_to_string(p[1:CASE WHEN p[1] = '' THEN 4 ELSE 3 END], '/')"""
view(
    "folders",
    rf"""SELECT f AS folder, count(*) AS tracks, min(n) AS first_seen FROM (SELECT n, {_FOLDER} AS f FROM
         (SELECT n, string_split(replace(path, '\', '/'), '/') AS p FROM paths)) GROUP BY 1""",
    "paths",
)


def _path_tracks(spark, sf):
    return paths(spark, sf).select(
        F.lit("A").alias("library_id"), c("n").alias("ordinal"), c("path").alias("location")
    )


@query("folder_counts", with_views("folders", "SELECT folder, tracks, first_seen FROM folders"))
def folder_counts(spark, sf):
    """G5."""
    return R.folder_counts(_path_tracks(spark, sf)).drop("library_id")


@query(
    "common_folders",
    with_views("folders", "SELECT folder, tracks FROM folders ORDER BY tracks DESC, first_seen LIMIT 6"),
)
def common_folders(spark, sf):
    """G5, L1."""
    return R.common_folders(_path_tracks(spark, sf)).drop("library_id")


@query(
    "top_page_folders",
    r"""SELECT site, folder, tracks FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY tracks DESC, fs) AS rn FROM (
         SELECT p[3] AS site, array_to_string(p[1:3], '/') AS folder, count(*) AS tracks, min(page_id) AS fs FROM
         (SELECT page_id, string_split(url, '/') AS p FROM pages) GROUP BY ALL)) WHERE rn <= 6""",
)
def top_page_folders(spark, sf):
    """L1 per library, sites standing in for libraries."""
    t = S.table(spark, sf, "pages").select(
        F.get(F.split("url", "/"), F.lit(2)).alias("library_id"), c("page_id").alias("ordinal"),
        c("url").alias("location"),
    )
    return R.common_folders(t).withColumnRenamed("library_id", "site")


# --- inventory --------------------------------------------------------------------------
view(
    "inventory",
    """SELECT CASE WHEN p_size % 2 = 0 THEN '/usb/Music' ELSE '/mnt/x' END AS root,
         artist || '/' || title || ' ' || (n % 500) || '.mp3' AS rel_path, n FROM tracks_a""",
    "tracks_a",
)


def inventory(spark, sf):
    return S.tracks_a(spark, sf).select(
        F.when(c("p_size") % 2 == 0, "/usb/Music").otherwise("/mnt/x").alias("root"),
        F.when(c("p_size") % 2 == 0, 1).otherwise(0).alias("root_order"),
        F.concat("artist", F.lit("/"), "title", F.lit(" "), (c("n") % 500).cast("string"), F.lit(".mp3")).alias("rel_path"),
        c("file_size").alias("length"),
    )


@query(
    "missing_files",
    with_views(
        "tracks_a tracks_b inventory",
        """SELECT track_id, location FROM (SELECT track_id, location FROM tracks_a UNION ALL SELECT track_id, location FROM tracks_b)
           WHERE location NOT IN (SELECT root || '/' || rel_path FROM inventory)""",
    ),
)
def missing_files(spark, sf):
    """J10."""
    cols = ["library_id", "track_id", "location"]
    t = S.tracks_a(spark, sf).select(*cols).unionByName(S.tracks_b(spark, sf).select(*cols))
    return R.missing_files(t, inventory(spark, sf)).select("track_id", "location")


@query(
    "missing_file_report",
    with_views(
        "tracks_a tracks_b inventory",
        """SELECT library_id, 'missing file' AS rule, count(*) AS n, array_to_string(list(location ORDER BY track_id)[1:3], ', ') AS examples
           FROM (SELECT library_id, track_id, location FROM tracks_a UNION ALL SELECT library_id, track_id, location FROM tracks_b)
           WHERE location NOT IN (SELECT root || '/' || rel_path FROM inventory) GROUP BY 1""",
    ),
)
def missing_file_report(spark, sf):
    """J10, G7, L3."""
    cols = ["library_id", "track_id", "location"]
    t = S.tracks_a(spark, sf).select(*cols).unionByName(S.tracks_b(spark, sf).select(*cols))
    gone = R.missing_files(t, inventory(spark, sf))
    return R.issue_counts(R.issue_rows(gone, "missing file", "track_id", c("location")))


@query(
    "inferred_mounts",
    with_views(
        "tracks_a tracks_b inventory",
        """SELECT library_id, prefix, root, votes FROM (SELECT *, row_number() OVER (PARTITION BY library_id, prefix ORDER BY votes DESC, seen) AS rn FROM (
             SELECT library_id, prefix, root, count(*) AS votes, min(rk) AS seen FROM (
               SELECT library_id, rk, arg_min(prefix, (ax, ro)) AS prefix, arg_min(root, (ax, ro)) AS root FROM (
                 SELECT library_id, rk, i AS ax, array_to_string(p[1:i], '/') AS prefix, array_to_string(p[i + 1:], '/') AS rel_path FROM (
                   SELECT library_id, rk, p, unnest(range(1, len(p))) AS i FROM (
                     SELECT library_id, string_split(location, '/') AS p, row_number() OVER w AS rk
                     FROM (SELECT library_id, ordinal, location FROM tracks_a UNION ALL SELECT library_id, ordinal, location FROM tracks_b)
                     WHERE location NOT IN (SELECT root || '/' || rel_path FROM inventory)
                     WINDOW w AS (PARTITION BY library_id ORDER BY ordinal))))
               JOIN (SELECT DISTINCT root, rel_path, CASE root WHEN '/mnt/x' THEN 0 ELSE 1 END AS ro FROM inventory) USING (rel_path)
               WHERE prefix <> '' GROUP BY 1, 2) WHERE prefix <> root GROUP BY ALL)) WHERE rn = 1""",
    ),
)
def inferred_mounts(spark, sf):
    """J15."""
    cols = ["library_id", "ordinal", "location"]
    t = S.tracks_a(spark, sf).select(*cols).unionByName(S.tracks_b(spark, sf).select(*cols))
    inv = inventory(spark, sf)
    return W.infer_mounts(R.missing_files(t, inv), inv)


# --- pages of tracks -----------------------------------------------------------------------
@query(
    "track_page",
    with_views(
        "tracks_a",
        """SELECT track_id, location, total FROM (SELECT *, count(*) OVER () AS total FROM tracks_a
             WHERE contains(lower(artist || ' ' || title || ' ' || location), 'ring')) ORDER BY ordinal LIMIT 200""",
    ),
)
def track_page(spark, sf):
    """C4, L2."""
    t = S.tracks_a(spark, sf).where(R.search("Ring", c("artist"), c("title"), c("location")))
    return R.track_page(t, 200, "ordinal").select("track_id", "location", "total")


@query(
    "first_details",
    """SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY o) AS rn FROM
        (SELECT *, (l_orderkey * 8 + l_linenumber) * 1000000000 + (l_suppkey * 7919 + round_even(l_extendedprice * 100, 0)::BIGINT) % 1000000000 AS o FROM lineitem)) WHERE rn <= 3""",
)
def first_details(spark, sf):
    """L3."""
    li = S.table(spark, sf, "lineitem").withColumn("o", S._line_ordinal())
    return R.first_k(li, ["l_partkey"], [c("o")], 3).select("l_partkey", "l_orderkey", "l_linenumber")


@query(
    "ordered_hot_cues",
    with_views(
        "cues_all",
        """SELECT track_id, ordinal, slot, position_ms, row_number() OVER (PARTITION BY track_id ORDER BY slot, position_ms, ordinal) AS place
           FROM cues_all WHERE slot IS NOT NULL""",
    ),
)
def ordered_hot_cues(spark, sf):
    """Place of each hot cue in its track, by slot and position."""
    q = S.cues(spark, sf, "all").where("slot IS NOT NULL")
    q = q.withColumn("key", c("slot") * 1e9 + c("position_ms"))
    out = ranked(q, ["track_id"], "key", "place", ["ordinal"])
    return out.select("track_id", "ordinal", "slot", "position_ms", "place")


# --- playlists ---------------------------------------------------------------------------------
@query(
    "known_playlist_entries",
    """SELECT l_orderkey AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'a:' || l_partkey) AS position, 'a:' || l_partkey AS track_id
       FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 20""",
)
def known_playlist_entries(spark, sf):
    """Entries whose track is not among the loaded ones vanish."""
    tracks = S.tracks_a(spark, sf).where("p_size > 20")
    e = P.known_entries(S.entries(spark, sf, "all"), tracks)
    return e.select(F.substring("node_id", 3, 20).cast("bigint").alias("node"), "position", "track_id")


@query(
    "crate_members",
    """SELECT l_orderkey AS node, 'a:' || l_partkey AS track_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY lower(p_brand), lower(p_name), 'a:' || l_partkey, l_linenumber) AS place
       FROM lineitem JOIN part ON p_partkey = l_partkey""",
)
def crate_members(spark, sf):
    """Members numbered by artist and title."""
    m = P.crate_members(S.entries(spark, sf, "all"), S.tracks_a(spark, sf))
    return m.select(
        F.substring("node_id", 3, 20).cast("bigint").alias("node"), "track_id", c("position").alias("place")
    )


@query(
    "star_join",
    """SELECT c_custkey, n.n_name AS home, coalesce(r.r_name, '') AS region, coalesce(o.n_name, '') AS other
       FROM customer JOIN nation n ON n.n_nationkey = c_nationkey
       LEFT JOIN region r ON r.r_regionkey = c_nationkey
       LEFT JOIN nation o ON o.n_nationkey = c_custkey % 40""",
)
def star_join(spark, sf):
    """One dimension in two roles, ids without a row."""
    nation = S.table(spark, sf, "nation").withColumnRenamed("n_nationkey", "id")
    region = S.table(spark, sf, "region").withColumnRenamed("r_regionkey", "id")
    fact = S.table(spark, sf, "customer").withColumn("other_id", (c("c_custkey") % 40).cast("int")).withColumn(
        "region_id", c("c_nationkey")
    )
    out = J.name_lookup(
        fact,
        {
            "home": (nation, "n_name", "c_nationkey"), "region": (region, "r_name", "region_id"),
            "other": (nation, "n_name", "other_id"),
        },
        library=False,
    )
    return out.select("c_custkey", "home", "region", "other")


@query(
    "resolved_entries",
    with_views(
        "tracks_a",
        """SELECT l_orderkey AS node, l_linenumber AS position, l_partkey AS part, track_id, by_place FROM (
            SELECT l.*, (l_suppkey % 2 = 0) AS by_place, CASE WHEN l_suppkey % 2 = 0 THEN b.track_id ELSE a.track_id END AS track_id FROM lineitem l
            JOIN tracks_a t ON t.n = l_partkey
            LEFT JOIN tracks_a a ON a.n = l_partkey
            LEFT JOIN (SELECT location, arg_max(track_id, ordinal) AS track_id FROM tracks_a GROUP BY 1) b ON b.location = t.location)""",
    ),
)
def resolved_entries(spark, sf):
    """Half the entries by id, half by location."""
    from segue.functions.locations import path_to_location

    t = S.tracks_a(spark, sf).withColumn("source_key", c("n").cast("string"))
    li = S.table(spark, sf, "lineitem").join(
        t.select(c("n").alias("l_partkey"), "location"), "l_partkey"
    )
    by_place = c("l_suppkey") % 2 == 0
    e = li.select(
        F.lit("A").alias("library_id"), c("l_orderkey").alias("node"), c("l_linenumber").alias("position"),
        c("l_partkey").alias("part"), by_place.alias("by_place"),
        F.when(by_place, "1").otherwise("0").alias("key_type"),
        F.when(by_place, path_to_location(c("location"))).otherwise(c("l_partkey").cast("string")).alias("key"),
    )
    return P.resolve_entries(e, t).drop("library_id")


def _crate_refs(spark, sf):
    """Line items name parts by path; every 13th supplier's references point elsewhere."""
    t = S.tracks_a(spark, sf).select(c("n").alias("l_partkey"), "location")
    li = S.table(spark, sf, "lineitem").join(t, "l_partkey")
    path = F.when(c("l_suppkey") % 13 == 0, F.concat(F.lit("/gone"), "location")).otherwise(F.upper("location"))
    return li.select(
        F.lit("A").alias("library_id"), c("l_orderkey").alias("node_id"), c("l_linenumber").alias("position"),
        path.alias("path"),
    )


@query(
    "crate_paths",
    with_views(
        "tracks_a",
        """SELECT l_orderkey AS node_id, l_linenumber AS position, b.track_id FROM lineitem JOIN tracks_a t ON t.n = l_partkey
           JOIN (SELECT lower(location) AS k, arg_max(track_id, ordinal) AS track_id FROM tracks_a GROUP BY 1) b ON b.k = lower(t.location)
           WHERE l_suppkey % 13 <> 0""",
    ),
)
def crate_paths(spark, sf):
    """J7, found references."""
    return P.resolve_crate_paths(_crate_refs(spark, sf), S.tracks_a(spark, sf))[0].drop("library_id")


@query(
    "lost_crate_paths",
    with_views(
        "tracks_a",
        """SELECT l_orderkey AS node_id, l_linenumber AS position, '/gone' || location AS path FROM lineitem JOIN tracks_a ON n = l_partkey
           WHERE l_suppkey % 13 = 0""",
    ),
)
def lost_crate_paths(spark, sf):
    """J7, unmatched references."""
    return P.resolve_crate_paths(_crate_refs(spark, sf), S.tracks_a(spark, sf))[1].drop("library_id")


@query(
    "playlist_trees",
    """WITH RECURSIVE nodes AS (SELECT c_custkey AS id, c_custkey // 4 AS parent, c_mktsegment AS name, c_nationkey AS seq FROM customer WHERE c_custkey > 0
          UNION ALL SELECT c_custkey + 10000000, c_custkey + 90000000, c_name, c_nationkey FROM customer),
        tree AS (SELECT id, id AS top, parent AS up, name AS path, 1 AS depth, lpad('' || seq, 3, '0') || ':' || id AS sort_key FROM nodes
          UNION ALL SELECT t.id, n.id, n.parent, n.name || ' / ' || t.path, t.depth + 1, lpad('' || n.seq, 3, '0') || ':' || n.id || '/' || t.sort_key
          FROM tree t JOIN nodes n ON n.id = t.up)
        SELECT id, path, depth, sort_key FROM tree WHERE up NOT IN (SELECT id FROM nodes)
        UNION ALL SELECT 200000000 + p_partkey, array_to_string(list_transform(range(p_partkey % 500 + 1), lambda x: 'd' || x), ' / '), (p_partkey % 500 + 1)::INT,
          array_to_string(list_transform(range(p_partkey % 500 + 1), lambda x: '000:' || (200000000 + p_partkey - p_partkey % 500 + x)), '/')
          FROM part""",
)
def playlist_trees(spark, sf):
    """Customers as nested folders (parent = key // 4), as many orphans, parts in chains of up to 500 folders."""
    return _folder_trees(spark, sf)[0]


@query(
    "playlist_tree_issues",
    """SELECT 'folder contains itself' AS rule, entity_id FROM (
         SELECT '' || (300000000 + s_suppkey) AS entity_id FROM supplier
         UNION ALL SELECT '' || (400000000 + n_nationkey) FROM nation
         UNION ALL SELECT '' || (500000000 + r_regionkey) FROM region)""",
)
def playlist_tree_issues(spark, sf):
    """Suppliers that contain themselves, nations in a ring, and regions below it, beside the good trees."""
    return _folder_trees(spark, sf)[1].select("rule", "entity_id")


def _folder_trees(spark, sf):
    cust = S.table(spark, sf, "customer")
    a = cust.where("c_custkey > 0").select(
        c("c_custkey").alias("id"), F.floor(c("c_custkey") / 4).alias("parent"),
        c("c_mktsegment").alias("name"), "c_nationkey",
    )
    b = cust.select(
        (c("c_custkey") + 10000000).alias("id"), (c("c_custkey") + 90000000).alias("parent"),
        c("c_name").alias("name"), "c_nationkey",
    )
    part, supplier, nation, region = (S.table(spark, sf, t) for t in ("part", "supplier", "nation", "region"))
    n = c("p_partkey")
    above = F.when(n % 500 == 0, 100000000).otherwise(200000000 + n - 1)
    zero = F.lit(0).alias("c_nationkey")
    d = part.select((n + 200000000).alias("id"), above.alias("parent"), F.concat(F.lit("d"), (n % 500).cast("string")).alias("name"), zero)
    own = (c("s_suppkey") + 300000000).alias("id")
    e = supplier.select(own, own.alias("parent"), c("s_name").alias("name"), zero)
    k = c("n_nationkey") + 400000000
    f = nation.select(k.alias("id"), (F.pmod(c("n_nationkey") + 1, F.lit(25)) + 400000000).alias("parent"), c("n_name").alias("name"), zero)
    g = region.select((c("r_regionkey") + 500000000).alias("id"), F.lit(400000000).alias("parent"), c("r_name").alias("name"), zero)
    parts = [x.select(c("id").cast("bigint"), c("parent").cast("bigint"), "name", c("c_nationkey").cast("bigint").alias("c_nationkey")) for x in (a, b, d, e, f, g)]
    nodes = reduce(DataFrame.unionByName, parts).select(
        F.lit("A").alias("library_id"), c("id").cast("string").alias("node_id"),
        c("parent").cast("string").alias("parent_id"), "name", c("c_nationkey").alias("seq"),
    )
    tree, issues = P.tree_paths(nodes)
    key = F.transform("sort_key", lambda k: F.concat(F.lpad(k["seq"].cast("string"), 3, "0"), F.lit(":"), k["id"]))
    return tree.select(
        c("node_id").cast("bigint").alias("id"), F.array_join("path", " / ").alias("path"),
        F.size("path").alias("depth"), F.array_join(key, "/").alias("sort_key"),
    ), issues


def _selected(spark, sf):
    n = S.nodes(spark, sf, "a")
    folders = n.select("library_id", F.slice("path", 1, 1).alias("path")).distinct().select(
        F.lit("ab").alias("pair_id"), "library_id", F.concat(F.lit("f:"), c("path")[0]).alias("node_id"),
        F.lit(0).cast("bigint").alias("ordinal"), "path", c("path")[0].alias("name"),
        F.lit(True).alias("is_folder"), F.lit(False).alias("is_crate"),
    )
    wanted = n.where("is_crate").select("library_id", F.array_join("path", " / ").alias("wanted"))
    return P.select_playlists(n.unionByName(folders), S.entries(spark, sf, "all"), S.tracks_a(spark, sf), wanted)


@query(
    "selected_playlists",
    """SELECT 'a:' || o_orderkey AS node_id FROM orders WHERE o_orderstatus = 'F'
       UNION ALL SELECT DISTINCT 'f:' || o_orderpriority FROM orders WHERE o_orderstatus = 'F'""",
)
def selected_playlists(spark, sf):
    """The wanted lists (every crate) and the folders above them."""
    return _selected(spark, sf)[0].select("node_id")


@query(
    "selected_entries",
    """SELECT 'a:' || l_orderkey AS node_id, l_linenumber AS position, 'a:' || l_partkey AS track_id
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'""",
)
def selected_entries(spark, sf):
    """J14, entries."""
    return _selected(spark, sf)[1].select("node_id", "position", "track_id")


@query(
    "selected_tracks",
    """SELECT DISTINCT 'a:' || l_partkey AS track_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey
       WHERE o_orderstatus = 'F'""",
)
def selected_tracks(spark, sf):
    """J14, tracks."""
    return _selected(spark, sf)[2].select("track_id")


def _crates(spark, sf):
    """Nations and customers as nested crates: region, region%%nation, region%%nation%%customer."""
    region, nation, cust = (S.table(spark, sf, t) for t in ("region", "nation", "customer"))
    n = nation.join(region, c("n_regionkey") == c("r_regionkey"))
    sep = F.lit("%%")
    a = region.select(c("r_name").alias("crate"), c("r_regionkey").cast("bigint").alias("n_tracks"))
    b = n.select(F.concat("r_name", sep, "n_name").alias("crate"), c("n_nationkey").cast("bigint").alias("n_tracks"))
    d = cust.join(n, c("c_nationkey") == c("n_nationkey")).select(
        F.concat("r_name", sep, "n_name", sep, "c_name").alias("crate"), F.lit(1).cast("bigint").alias("n_tracks")
    )
    return a.unionByName(b).unionByName(d).select(F.lit("A").alias("library_id"), "crate", "n_tracks")


@query(
    "crate_tree",
    """WITH n AS (SELECT * FROM nation JOIN region ON r_regionkey = n_regionkey),
          used AS (SELECT DISTINCT n_nationkey FROM n JOIN customer ON c_nationkey = n_nationkey)
        SELECT r_name || '/' || n_name || '/' || c_name AS path, false AS is_folder, 1 AS n_tracks FROM customer JOIN n ON n_nationkey = c_nationkey
        UNION ALL SELECT r_name || '/' || n_name, true, NULL FROM n WHERE n_nationkey IN (SELECT * FROM used)
        UNION ALL SELECT r_name || '/' || n_name || '/' || n_name, false, n_nationkey FROM n WHERE n_nationkey IN (SELECT * FROM used) AND n_nationkey > 0
        UNION ALL SELECT r_name || '/' || n_name, false, n_nationkey FROM n WHERE n_nationkey NOT IN (SELECT * FROM used)
        UNION ALL SELECT DISTINCT r_name, true, NULL FROM n
        UNION ALL SELECT r_name || '/' || r_name, false, r_regionkey FROM region WHERE r_regionkey > 0
        UNION ALL SELECT s_name || unnest(['', '/B', '/B/B']), true, NULL FROM supplier
        UNION ALL SELECT s_name || '/B/B/A', false, 3 FROM supplier
        UNION ALL SELECT s_name || '/B/B/B', false, CASE WHEN s_suppkey % 2 = 1 THEN 1 ELSE 2 END FROM supplier
        UNION ALL SELECT s_name || '/B/B', false, 2 FROM supplier WHERE s_suppkey % 2 = 1""",
)
def crate_tree(spark, sf):
    """nested crates, and for each supplier crates that repeat their parent's name, every second of
    which has an empty first crate."""
    sup = S.table(spark, sf, "supplier")
    names = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(n).cast("bigint").alias("n")) for x, n in (("%%B", 1), ("%%B%%B", 2), ("%%B%%B%%A", 3))])
    repeats = sup.select(F.lit("A").alias("library_id"), "s_name", "s_suppkey", F.explode(names).alias("r"))
    own = F.when((c("r.n") == 1) & (c("s_suppkey") % 2 == 0), 0).otherwise(c("r.n"))
    repeats = repeats.select("library_id", F.concat("s_name", "r.x").alias("crate"), own.alias("n_tracks"))
    nodes = P.crate_tree(_crates(spark, sf).unionByName(repeats))
    return nodes.select(F.array_join("path", "/").alias("path"), "is_folder", "n_tracks")


@query(
    "unique_list_names",
    """WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS name FROM customer)
       SELECT c_custkey, CASE WHEN k + t = 1 THEN name ELSE name || ' (' || (k + t) || ')' END AS unique_name FROM (
         SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY c_custkey) AS k,
           CASE WHEN lower(name) = 'building' THEN 1 ELSE 0 END AS t FROM l)""",
)
def unique_list_names(spark, sf):
    """segments as list names, one of them taken."""
    n = c("c_custkey")
    name = F.when(n % 2 == 0, c("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    rows = S.table(spark, sf, "customer").select(
        F.lit("A").alias("library_id"), n.alias("ordinal"), name.alias("name")
    )
    taken = spark.createDataFrame([("A", "Building")], "library_id string, name string")
    out = P.unique_names(rows, taken)
    return out.select(c("ordinal").alias("c_custkey"), "unique_name")


@query(
    "placed_lists",
    """WITH e AS (SELECT o_orderpriority || ' / ' || o_orderkey AS name, o_orderkey FROM orders WHERE o_orderstatus = 'F')
       SELECT o_orderkey, coalesce('t:' || e.o_orderkey, '') AS target, CASE WHEN e.o_orderkey IS NULL THEN 'create' ELSE 'replace' END AS action,
         o.o_orderpriority || ' / ' || o.o_orderkey AS unique_name
       FROM orders o LEFT JOIN e USING (o_orderkey)""",
)
def placed_lists(spark, sf):
    """Lists already at the target are replaced, the others created."""
    o = S.table(spark, sf, "orders")
    name = F.concat("o_orderpriority", F.lit(" / "), c("o_orderkey").cast("string"))
    rows = o.select(F.lit("A").alias("library_id"), c("o_orderkey").alias("ordinal"), name.alias("name"))
    there = o.where("o_orderstatus = 'F'").select(
        F.lit("A").alias("library_id"), F.concat(F.lit("t:"), c("o_orderkey").cast("string")).alias("target_id"), name.alias("name")
    )
    out = P.place_lists(rows, there, replace=True)
    return out.select(c("ordinal").alias("o_orderkey"), F.coalesce("target_id", F.lit("")).alias("target"), "action", "unique_name")


# --- dimensions ---------------------------------------------------------------------------------------
def _named(spark, sf):
    t = S.tracks_a(spark, sf)
    key = KEY.make_key((c("n") % 12).cast("int"), c("n") % 2 == 0)
    return t.select(
        "library_id", "track_id", "ordinal", "artist", c("title").alias("album"), "genre",
        F.when(c("p_size") % 5 == 0, "").otherwise(c("genre")).alias("label"),
        KEY.format_key(key, "musical").alias("key_name"),
        F.when(c("p_size") % 3 == 0, c("title")).otherwise("").alias("remixer"), c("artist").alias("composer"),
    )


_DIMS = """n AS (SELECT ordinal, track_id, artist, title AS album, genre, CASE WHEN p_size % 5 = 0 THEN '' ELSE genre END AS label,
        ['C','Db','D','Eb','E','F','F#','G','Ab','A','Bb','B'][ordinal % 12 + 1] || CASE WHEN ordinal % 2 = 0 THEN 'm' ELSE '' END AS key_name,
        CASE WHEN p_size % 3 = 0 THEN title ELSE '' END AS remixer, artist AS composer FROM tracks_a),
    u AS (SELECT ordinal, 0 AS ax, 'artist' AS kind, artist AS name FROM n UNION ALL SELECT ordinal, 1, 'album', album FROM n
      UNION ALL SELECT ordinal, 2, 'genre', genre FROM n UNION ALL SELECT ordinal, 3, 'label', label FROM n
      UNION ALL SELECT ordinal, 4, 'key', key_name FROM n UNION ALL SELECT ordinal, 5, 'artist', remixer FROM n
      UNION ALL SELECT ordinal, 6, 'artist', composer FROM n),
    dims AS (SELECT kind, name, row_number() OVER (PARTITION BY kind ORDER BY o, a) AS id FROM (
      SELECT kind, name, min(ordinal) AS o, arg_min(ax, (ordinal, ax)) AS a FROM u WHERE name <> '' GROUP BY ALL))"""


@query("dimension_rows", with_views("tracks_a", "SELECT kind, name, id FROM dims", _DIMS))
def dimension_rows(spark, sf):
    """G6."""
    return D.dimension_rows(_named(spark, sf)).drop("library_id")


@query(
    "dimension_ids",
    with_views(
        "tracks_a",
        """SELECT track_id, a.id AS artist_id, b.id AS album_id, coalesce(l.id, 0) AS label_id, coalesce(r.id, 0) AS remixer_id FROM n
           LEFT JOIN dims a ON a.kind = 'artist' AND a.name = artist LEFT JOIN dims b ON b.kind = 'album' AND b.name = album
           LEFT JOIN dims l ON l.kind = 'label' AND l.name = label LEFT JOIN dims r ON r.kind = 'artist' AND r.name = remixer""",
        _DIMS,
    ),
)
def dimension_ids(spark, sf):
    """The fact table's ids."""
    t = _named(spark, sf)
    return D.with_dimension_ids(t, D.dimension_rows(t)).select(
        "track_id", "artist_id", "album_id", "label_id", "remixer_id"
    )
