"""Playlists and crates.

Nodes carry their full name path.  Entry order is ranked in chunks of the stored
position, so one very long playlist is not sorted by a single task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.functions.locations import location_to_path
from segue.plans.ordered import ranked, running
from segue.session import discard, materialise


def known_entries(entries: DataFrame, tracks: DataFrame) -> DataFrame:
    """Entries whose track exists, positions renumbered from 1."""
    ids = tracks.select("library_id", "track_id").distinct()
    kept = entries.join(ids, ["library_id", "track_id"], "left_semi")
    return (
        ranked(kept, ["library_id", "node_id"], "position", "_rank", ties=["track_id"])
        .withColumn("position", F.col("_rank"))
        .drop("_rank")
    )


def crate_members(members: DataFrame, tracks: DataFrame) -> DataFrame:
    """Crates have no order of their own: artist, then title, without case, then track id, as
    ``position`` from 1 (J4).

    All tracks are sorted once by range, and a track's place in that order, which is dense
    within a range, is the number its crates are ranked by; a crate is not sorted by one task.
    """
    order = ["_artist", "_title", "track_id"]
    names = tracks.select(
        "library_id", "track_id", F.lower("artist").alias("_artist"), F.lower("title").alias("_title")
    ).repartitionByRange(*order).sortWithinPartitions(*order)
    # written, as a number given by place may not be given twice
    places = materialise(
        names.select("library_id", "track_id", F.monotonically_increasing_id().alias("_place")), "crate-order"
    )
    kept = members.join(places, ["library_id", "track_id"])
    return ranked(kept, ["library_id", "node_id"], "_place", "position").select(
        "library_id", "node_id", "track_id", "position"
    )


def resolve_entries(entries: DataFrame, tracks: DataFrame) -> DataFrame:
    """Entries by track id (``key_type`` 0) or by XML location (1); unknown ones vanish.

    ``tracks`` needs ``source_key``, ``location``, ``ordinal``.  Where several tracks
    share a key the last one counts; both lookups are reduced to unique keys first.
    """
    def lookup(key: str) -> DataFrame:
        return tracks.groupBy("library_id", F.col(key).alias("_key")).agg(
            F.max_by("track_id", F.struct("ordinal", "track_id")).alias("track_id")
        )

    by_place = F.col("key_type") == "1"
    ids = entries.where(~by_place).withColumn("_key", F.col("key")).join(
        lookup("source_key"), ["library_id", "_key"]
    )
    places = entries.where(by_place).withColumn("_key", location_to_path(F.col("key"))).join(
        lookup("location"), ["library_id", "_key"]
    )
    return ids.unionByName(places).drop("_key", "key", "key_type")


def resolve_crate_paths(refs: DataFrame, tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, unmatched references): crates name tracks by path, case ignored.

    ``refs(library_id, node_id, position, path)`` holds absolute paths.
    """
    key = F.lower(F.translate("location", "\\", "/"))
    known = tracks.groupBy("library_id", key.alias("_key")).agg(
        F.max_by("track_id", F.struct("ordinal", "track_id")).alias("track_id")
    )
    keyed = refs.withColumn("_key", F.lower(F.translate("path", "\\", "/")))
    joined = keyed.join(known, ["library_id", "_key"], "left")
    found = joined.where("track_id IS NOT NULL").select(
        "library_id", "node_id", "position", "track_id"
    )
    lost = joined.where("track_id IS NULL").select("library_id", "node_id", "position", "path")
    return found, lost


# --- trees -------------------------------------------------------------------------------
ANCHORS = 16
SAMPLE, HOT = 1024, 64  # a key is hot if it has more than 64 of every 1,024th row


def tree_paths(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adjacency list -> (nodes with ``path`` (names from the top) and ``sort_key`` (seq, id
    pairs from the top), issues); a node whose parent is unknown hangs at the top (J8).

    Only nodes with a node below them climb; paths double: a round joins every open one with the
    node its path ends below, and takes that one's whole path, so a tree of depth d takes log2(d)
    rounds. A folder that meets itself in its path is inside itself; it and all that hangs below it
    reach no top, have no place in the tree and become issue rows, while all other libraries go on.

    Rounds move whole paths, so there are two climbs: all such nodes to the nearest anchor above them, one
    node of about ``ANCHORS`` by a hash of its id, then anchors alone to the top. A node's whole path is
    that of its parent, joined at the end, and is not written.

    Rows without a node_id, and all but one row of a repeated node_id, are not in the tree.
    """
    own = F.struct(F.col("seq").cast("bigint").alias("seq"), F.col("node_id").alias("id"))
    anchor = lambda node: F.pmod(F.xxhash64("library_id", node), F.lit(ANCHORS)) == 0
    rows = materialise(nodes.where("node_id IS NOT NULL").dropDuplicates(["library_id", "node_id"]), "nodes")
    known = rows.select("library_id", F.col("node_id").alias("parent_id"), F.col("node_id").alias("_up"))
    named = F.col("library_id").isNotNull() & F.col("parent_id").isNotNull()
    hung = _looked_up(rows.where(named), known, "parent_id", "left").select(*[F.col(c) for c in nodes.columns], "_up")
    loose = rows.where(~named).select(*nodes.columns, F.when(F.lit(False), F.col("node_id")).alias("_up"))
    given, rows = rows, materialise(hung.unionByName(loose), "tree")
    discard(given)
    parents = rows.where("_up IS NOT NULL").select("library_id", F.col("_up").alias("node_id")).distinct()
    inner = rows.join(parents, ["library_id", "node_id"], "left_semi").select(
        "library_id", "node_id", "_up", F.array("name").alias("path"), F.array(own).alias("sort_key"), F.lit(False).alias("_lost")
    )
    local = _climbed(_stopped(materialise(inner, "tree"), anchor("_up")))
    tops = local.where(anchor("node_id")).select("library_id", "node_id", F.col("_to").alias("_up"), "path", "sort_key", "_lost")
    tops = _climbed(_stopped(tops, F.lit(False)))

    step = lambda state, key: state.select(
        "library_id", F.col("node_id").alias(key), F.col("path").alias("_path"), F.col("sort_key").alias("_key"), "_lost",
        *[c for c in ("_to",) if key == "_up"],
    )
    top = rows.where("_up IS NULL").select(*nodes.columns, F.array("name").alias("path"), F.array(own).alias("sort_key"), F.lit(False).alias("_lost"))
    state = _looked_up(rows.where("_up IS NOT NULL"), step(local, "_up"), "_up").select(
        *nodes.columns, F.concat("_path", F.array("name")).alias("path"), F.concat("_key", F.array(own)).alias("sort_key"), "_to", "_lost"
    )
    short = F.col("_to").isNull() | F.col("_lost")
    long = _looked_up(state.where(~short).drop("_lost"), step(tops, "_to"), "_to").select(
        *nodes.columns, F.concat("_path", "path").alias("path"), F.concat("_key", "sort_key").alias("sort_key"), "_lost"
    )
    state = top.unionByName(state.where(short).drop("_to")).unionByName(long)
    issues = state.where("_lost").select(
        "library_id", F.lit("folder contains itself").alias("rule"), F.col("node_id").cast("string").alias("entity_id"), F.col("name").alias("detail")
    )
    return state.where("NOT _lost").select(*nodes.columns, "path", "sort_key"), issues


def _looked_up(rows: DataFrame, side: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows(library_id, node_id, ...)`` joined with the one row of ``side`` for their ``key``.

    Half of all rows may have one key. Keys of many rows, found in a sample by a hash of the rows' ids, are few: their
    rows of ``side`` are broadcast, so that no task sorts all rows of a key.
    """
    on = ["library_id", key]
    some = rows.where(F.pmod(F.xxhash64(F.lit(SAMPLE), "library_id", "node_id"), F.lit(SAMPLE)) == 0)
    hot = materialise(some.groupBy(*on).count().where(F.col("count") > HOT).select(*on), "hot-nodes")
    if hot.isEmpty():
        return rows.join(side, on, how)
    rows = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
    few = side.join(F.broadcast(hot), on, "left_semi")
    met = rows.where("_hot").drop("_hot").join(F.broadcast(few), on, how)
    return met.unionByName(rows.where("_hot IS NULL").drop("_hot").join(side, on, how))


def _stopped(state: DataFrame, stop: Column) -> DataFrame:
    """``state`` with ``_to``, the node a row's path ends below for good: its ``_up`` where ``stop`` is true."""
    to = F.when(stop, F.col("_up"))
    return state.withColumns({"_to": to, "_up": F.when(to.isNull(), F.col("_up"))})


def _climbed(state: DataFrame) -> DataFrame:
    """``state`` with each path as long as its ``_up`` leads on."""
    given = state
    while True:
        open_ = F.col("_up").isNotNull() & ~F.col("_lost")
        if state.where(open_).isEmpty():
            return state
        above = state.select(
            "library_id", F.col("node_id").alias("_up"), F.col("_up").alias("_next"), "_to", F.col("path").alias("_path"),
            F.col("sort_key").alias("_key"), F.col("_lost").alias("_above_lost"),
        )
        met = _looked_up(state.where(open_).drop("_to"), above, "_up")
        lost = F.col("_above_lost") | F.exists("_key", lambda k: k["id"] == F.col("node_id"))
        met = met.select(
            "library_id", "node_id", F.col("_next").alias("_up"), "_to",
            F.when(lost, F.col("path")).otherwise(F.concat("_path", "path")).alias("path"),
            F.when(lost, F.col("sort_key")).otherwise(F.concat("_key", "sort_key")).alias("sort_key"), lost.alias("_lost"),
        )
        after = materialise(state.where(~open_).unionByName(met), "tree")
        if state is not given:
            discard(state)
        state = after


def select_playlists(
    nodes: DataFrame, entries: DataFrame, tracks: DataFrame, wanted: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Named lists (``wanted(library_id, wanted)`` as ``"Folder / Name"``), the folders above
    them, their entries and tracks (J14)."""
    key = ["library_id", "node_id"]
    lists = (
        nodes.where(~F.col("is_folder"))
        .withColumn("wanted", F.array_join("path", " / "))
        .join(wanted.distinct(), ["library_id", "wanted"], "left_semi")
        .drop("wanted")
    )
    above = lists.select(
        "library_id",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("path") - 1)),
                lambda i: F.slice("path", F.lit(1), i),
            )
        ).alias("path"),
    ).distinct()
    folders = nodes.where("is_folder").join(above, ["library_id", "path"], "left_semi")
    kept = entries.join(lists.select(*key), key, "left_semi")
    used = kept.select("library_id", "track_id").distinct()
    return (
        lists.unionByName(folders.select(*lists.columns)),
        kept,
        tracks.join(used, ["library_id", "track_id"], "left_semi"),
    )


# --- crates ----------------------------------------------------------------------------------
NODES = "library_id string, crate string, path array<string>, is_folder boolean, n_tracks bigint"


def crate_tree(crates: DataFrame) -> DataFrame:
    """Crates named ``A%%B`` -> nodes.

    ``crates(library_id, crate, n_tracks)``.  A crate with crates below it becomes a
    folder; its own tracks, if it has any, go to a list of the same name inside it.
    Parents are found by an equi join on exploded name prefixes.

    Where a name repeats its parent's (``B%%B``), a list that was moved inside its folder can be
    taken for the next crate's parent and move once more, so the order of the files counts: such
    trees, one below each first name of a library, are built by a walk over their ordered names.
    """
    rows = crates.withColumn("path", F.split("crate", "%%"))
    repeats = F.exists(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("path") - 1)),
        lambda i: (i < F.size("path")) & (F.get("path", i) == F.get("path", i - 1)),
    )
    top = F.get("path", F.lit(0)).alias("_top")
    ordered = rows.where(repeats).select("library_id", top).distinct()
    rows = rows.withColumn("_top", top)
    walked = rows.join(ordered, ["library_id", "_top"], "left_semi")
    walked = walked.groupBy("library_id", "_top").applyInPandas(_walk_crates, NODES)
    rows = rows.join(ordered, ["library_id", "_top"], "left_anti")
    prefixes = (
        rows.where(F.size("path") > 1)
        .select(
            "library_id",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.size("path") - 1),
                    lambda i: F.slice("path", F.lit(1), i),
                )
            ).alias("path"),
        )
        .distinct()
    )
    marked = rows.join(prefixes.withColumn("_f", F.lit(True)), ["library_id", "path"], "left")
    inner = F.col("_f").isNotNull()
    lists = marked.where(~inner | (F.col("n_tracks") > 0)).select(
        "library_id", "crate",
        F.when(inner, F.concat("path", F.slice("path", -1, 1))).otherwise(F.col("path")).alias("path"),
        F.lit(False).alias("is_folder"), "n_tracks",
    )
    folders = prefixes.select(
        "library_id", F.lit(None).cast("string").alias("crate"), "path",
        F.lit(True).alias("is_folder"), F.lit(None).cast("bigint").alias("n_tracks"),
    )
    return lists.unionByName(folders).unionByName(walked)


def _walk_crates(crates: pd.DataFrame) -> pd.DataFrame:
    """The tree below one first name: crates come by name, case ignored. A folder is a dict of
    its folders and a list of its lists; a parent's name becomes a folder once a crate needs it."""
    tree: tuple[dict, list] = ({}, [])
    files = sorted(zip(crates["crate"], crates["n_tracks"].fillna(0)), key=lambda f: (f[0].lower(), f[0]))
    for crate, n in files:
        *parents, name = crate.split("%%")
        folders, lists = tree
        for parent in parents:
            if parent not in folders:
                folders[parent] = ({}, [])
                same = next((x for x in lists if x[0] == parent), None)
                if same:
                    lists.remove(same)
                    if same[2]:
                        folders[parent][1].append(same)
            folders, lists = folders[parent]
        if name not in folders:
            lists.append((name, crate, int(n)))
        elif n:
            folders[name][1].append((name, crate, int(n)))
    out, todo = [], [((), tree)]
    while todo:
        path, (folders, lists) = todo.pop()
        out += [(crate, [*path, name], False, n) for name, crate, n in lists]
        out += [(None, [*path, name], True, None) for name in folders]
        todo += [((*path, name), below) for name, below in folders.items()]
    frame = pd.DataFrame(out, columns=["crate", "path", "is_folder", "n_tracks"])
    frame["n_tracks"] = frame["n_tracks"].astype("Int64")
    return frame.assign(library_id=crates["library_id"].iloc[0])


def crate_file_name(path: Column) -> Column:
    safe = F.transform(
        path,
        lambda n: F.coalesce(
            F.nullif(
                F.trim(F.replace(F.regexp_replace(n, r'[\\/:*?"<>|]', "-"), F.lit("%%"), F.lit("%"))),
                F.lit(""),
            ),
            F.lit("Untitled"),
        ),
    )
    return F.concat(F.array_join(safe, "%%"), F.lit(".crate"))


# --- names ---------------------------------------------------------------------------------------
def unique_names(nodes: DataFrame, taken: DataFrame) -> DataFrame:
    """``unique_name`` per node: the name, or ``name (2)``, ``name (3)``... compared without
    case with names already taken and with those given to earlier nodes (F13).

    ``nodes(library_id, ordinal, name)``, ``taken(library_id, name)``.

    The k-th node of a name gets the k-th number that is not excluded, so a rank and a
    short list of excluded numbers per name suffice.  A number n of name p is excluded
    when ``p (n)`` is taken, or when a node really called ``p (n)`` comes before p's nodes
    have used n up: fewer nodes of p precede it than there are usable numbers up to n.
    That is decided once per distinct name, from short names to longer ones.
    """
    lib = "library_id"
    rows = nodes.withColumn("_low", F.lower("name"))
    used = taken.select(lib, F.lower("name").alias("_low")).distinct()
    numbered = r"^(.*) \((\d+)\)$"
    number = F.regexp_extract("_low", numbered, 2)
    groups = materialise(
        rows.groupBy(lib, "_low").agg(F.min("ordinal").alias("_t"))
        .join(used.withColumn("_used", F.lit(True)), [lib, "_low"], "full")
        .withColumn("_used", F.coalesce("_used", F.lit(False)))
        .withColumn("_n", number.try_cast("bigint"))
        # only numbers as they would be written count: no leading zero, from 2 on
        .withColumn("_n", F.when((F.col("_n") >= 2) & (F.col("_n").cast("string") == number), F.col("_n")))
        .withColumn("_up", F.when(F.col("_n").isNotNull(), F.regexp_extract("_low", numbered, 1))),
        "names",
    )
    child = groups.where("_up IS NOT NULL")
    empty = F.array().cast("array<bigint>")
    first_lost = F.when(F.col("_used"), F.array(F.lit(1).cast("bigint"))).otherwise(empty)
    if child.isEmpty():
        settled = groups.select(lib, "_low", first_lost.alias("_x"))
    else:
        settled = _numbered_names(rows, groups, child, first_lost)

    ranks = ranked(rows, [lib, "_low"], "ordinal", "_k", ties=["name"])
    n = F.aggregate(
        F.col("_x"), F.col("_k"), lambda acc, x: F.when(x <= acc, acc + 1).otherwise(acc)
    )
    return ranks.join(settled, [lib, "_low"]).select(
        *nodes.columns,
        F.when(n == 1, F.col("name"))
        .otherwise(F.concat("name", F.lit(" ("), n.cast("string"), F.lit(")")))
        .alias("unique_name"),
    )


def _numbered_names(rows: DataFrame, groups: DataFrame, child: DataFrame, first_lost: Column) -> DataFrame:
    """The excluded numbers ``_x`` of every name, where some names (``child``) are another's with a number.
    Only these and the names they number are counted and settled level by level."""
    lib = "library_id"
    # how many nodes of the parent name precede the first node of the numbered name
    numbered = child.select(lib, F.col("_up").alias("_low")).distinct()
    asks = child.where("_t IS NOT NULL").select(
        lib, F.col("_up").alias("_low"), F.col("_t").alias("ordinal"), F.lit(0).alias("_w"),
        F.col("_low").alias("_child"),
    )
    events = rows.join(numbered, [lib, "_low"], "left_semi").select(
        lib, "_low", F.col("ordinal").cast("bigint").alias("ordinal"), F.lit(1).alias("_w"),
        F.lit(None).cast("string").alias("_child"),
    ).unionByName(asks.withColumn("ordinal", F.col("ordinal").cast("bigint")))
    before = running(events, [lib, "_low"], "ordinal", F.col("_w"), "sum", "_r", ["_w"]).where(
        "_child IS NOT NULL"
    )
    child = child.join(
        before.select(lib, F.col("_child").alias("_low"), "_r"), [lib, "_low"], "left"
    )
    claims = child.groupBy(lib, F.col("_up").alias("_low")).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("_n").alias("n"), F.coalesce("_r", F.lit(0)).cast("bigint").alias("r"),
                    F.col("_used").alias("used"), F.col("_low").alias("low"),
                )
            )
        ).alias("_claims")
    )
    names = materialise(
        groups.select(lib, "_low", "_up", "_used").join(claims, [lib, "_low"], "left"), "names"
    )

    settled = names.where("_up IS NULL AND _claims IS NULL").select(lib, "_low", first_lost.alias("_x"))
    names = names.where("_up IS NOT NULL OR _claims IS NOT NULL")
    # From the top: a name's own first use is lost when it is taken or its claim failed.
    level = names.join(
        names.select(lib, F.col("_low").alias("_up")), [lib, "_up"], "left_anti"
    ).withColumn("_lost", F.col("_used"))
    empty = F.array().cast("array<bigint>")
    while True:
        start = F.struct(
            F.when(F.col("_lost"), F.array(F.lit(1).cast("bigint"))).otherwise(empty).alias("x"),
            F.array().cast("array<string>").alias("lost"),
        )
        claims_col = F.coalesce(
            "_claims", F.array().cast("array<struct<n:bigint,r:bigint,used:boolean,low:string>>")
        )
        done = level.withColumn("_s", F.aggregate(claims_col, start, _claim))
        settled = settled.unionByName(done.select(lib, "_low", F.col("_s.x").alias("_x")))
        below = names.join(done.select(lib, F.col("_low").alias("_up"), "_s"), [lib, "_up"])
        if below.isEmpty():
            return settled
        level = below.withColumn("_lost", F.array_contains(F.col("_s.lost"), F.col("_low"))).drop("_s")


def _claim(acc: Column, c: Column) -> Column:
    """One numbered name against its parent's numbering, in order of the number."""
    usable = c["n"] - F.size(acc["x"])  # numbers 1..n the parent could have used
    wins = ~c["used"] & (c["r"] < usable)
    return F.struct(
        F.when(c["used"] | wins, F.array_append(acc["x"], c["n"])).otherwise(acc["x"]).alias("x"),
        F.when(wins, acc["lost"]).otherwise(F.array_append(acc["lost"], c["low"])).alias("lost"),
    )


def place_lists(nodes: DataFrame, existing: DataFrame, replace: bool) -> DataFrame:
    """Which target list each written list becomes.

    ``nodes(library_id, ordinal, name)``, ``existing(library_id, target_id, name[, hidden])``.  With
    ``replace`` a same-named target list (lowest id) is reused, its entries replaced;
    anything else is created under a unique name.  A hidden list is never reused, but its
    name is taken.
    """
    seen = existing.where("NOT hidden") if "hidden" in existing.columns else existing
    first = seen.groupBy("library_id", "name").agg(F.min("target_id").alias("target_id"))
    if replace:  # read by several steps below
        joined = materialise(nodes.join(first, ["library_id", "name"], "left"), "reused-lists")
    else:
        joined = nodes.withColumn("target_id", F.lit(None).cast(first.schema["target_id"].dataType))
    same = joined.where("target_id IS NOT NULL").withColumn("unique_name", F.col("name"))
    fresh = joined.where("target_id IS NULL").drop("target_id")
    named = unique_names(fresh, existing.select("library_id", "name"))
    return same.withColumn("action", F.lit("replace")).unionByName(
        named.withColumn("target_id", F.lit(None).cast(same.schema["target_id"].dataType))
        .withColumn("action", F.lit("create"))
        .select(*same.columns, "action")
    )


def write_lists(
    nodes: DataFrame, entries: DataFrame, ids: DataFrame, existing: DataFrame, existing_entries: DataFrame,
    replace: bool = True, once: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(lists, entries) of a target that numbers its lists, after ``nodes`` were written to it.

    ``nodes(library_id, node_id, ordinal, name)``: lists in their order, by the name the target shows;
    ``entries(library_id, node_id, position, track_id)``; ``ids(library_id, track_id, target_track_id)``:
    the tracks the target has, others are dropped; ``existing(library_id, id, name, position, hidden)``
    and ``existing_entries(library_id, list_id, track_id, position)``: what it holds.

    With ``replace`` lists of one name become one, a list of the target if it shows that name: what it
    held goes, and the last one's entries stay.  Without, each is created.  New lists are numbered after
    the target's last, and placed after its last position.  Entries are renumbered from 1, or with
    ``once`` a track is in a list once and has no position.
    """
    lib = "library_id"
    if replace:
        last = nodes.groupBy(lib, "name").agg(
            F.max_by("node_id", F.struct("ordinal", "node_id")).alias("node_id"), F.min("ordinal").alias("ordinal")
        )
    else:
        last = nodes.select(lib, "name", "node_id", "ordinal")
    placed = place_lists(last.select(lib, "node_id", "ordinal", "name"), existing.withColumnRenamed("id", "target_id"), replace)
    placed = materialise(placed, "placed-lists")
    top = existing.groupBy(lib).agg(F.max("id").alias("_id"), F.max("position").alias("_position"))
    fresh = ranked(placed.where("action = 'create'"), [lib], "ordinal", "_n", ["node_id"]).join(top, lib, "left")
    number = lambda c: (F.coalesce(c, F.lit(0)) + F.col("_n")).cast("bigint")
    created = fresh.select(
        lib, "node_id", number("_id").alias("id"), F.col("unique_name").alias("name"), number("_position").alias("position"), F.lit(False).alias("hidden"),
    )
    reused = placed.where("action = 'replace'").select(lib, "node_id", F.col("target_id").cast("bigint").alias("id"))
    kept = existing.select(lib, F.col("id").cast("bigint").alias("id"), "name", F.col("position").cast("bigint").alias("position"), "hidden")
    state = kept.join(reused.select(lib, "id", F.lit("replaced").alias("_s")), [lib, "id"], "left")
    lists = state.select(*kept.columns, F.coalesce("_s", F.lit("kept")).alias("action")).unionByName(
        created.drop("node_id").withColumn("action", F.lit("created"))
    )
    targets = reused.unionByName(created.select(lib, "node_id", "id"))
    rows = entries.join(targets, [lib, "node_id"]).join(ids.select(lib, "track_id", "target_track_id"), [lib, "track_id"])
    old = existing_entries.join(reused.select(lib, F.col("id").alias("list_id")), [lib, "list_id"], "left_anti")
    if once:
        written = rows.select(lib, F.col("id").alias("list_id"), F.col("target_track_id").alias("track_id"))
        return lists, old.select(lib, "list_id", "track_id").unionByName(written).distinct()
    written = ranked(rows, [lib, "id"], "position", "_place", ["track_id"]).select(
        lib, F.col("id").alias("list_id"), F.col("target_track_id").alias("track_id"), F.col("_place").alias("position")
    )
    return lists, old.select(lib, "list_id", "track_id", F.col("position").cast("bigint").alias("position")).unionByName(written)


# --- merge -------------------------------------------------------------------------------------------
def merge_playlists(
    base_nodes: DataFrame, base_entries: DataFrame, inc_nodes: DataFrame, inc_entries: DataFrame,
    ids: DataFrame, policy: str = "merge",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge lists by exact folder path and name (M4) -> (nodes, entries, report).

    Nodes: ``(pair_id, node_id, ordinal, path, is_folder, is_crate)``; entries:
    ``(pair_id, node_id, position, track_id)``; ``ids(pair_id, incoming_id, merged_id)``.
    Several incoming lists of one path apply in order.  Membership tests are equi joins
    on (list, track), and a list's rows are ranked in position chunks.
    """
    pair = "pair_id"
    key = F.array_join("path", "\u0001")
    target = (
        base_nodes.withColumn("_path", key)
        .groupBy(pair, "_path")
        .agg(F.min_by(F.struct("node_id", "is_folder"), "ordinal").alias("t"))
        .select(pair, "_path", F.col("t.node_id").alias("_base"), F.col("t.is_folder").alias("_fold"))
    )
    lists = inc_nodes.where(~F.col("is_folder")).withColumn("_path", key)
    lists = lists.join(target, [pair, "_path"], "left")
    # a folder of that name never becomes a list: each such incoming list is added on its own
    own = F.coalesce("_fold", F.lit(False))
    lists = lists.withColumn(
        "_group", F.when(own, F.concat_ws("\u0001", "_path", "node_id")).otherwise(F.col("_path"))
    ).withColumn("_base", F.when(~own, F.col("_base")))
    # many lists may share one path: their turns are ranked in chunks, not by one task
    lists = ranked(lists, [pair, "_group"], "ordinal", "_turn", ["node_id"])
    heads = lists.groupBy(pair, "_group").agg(
        F.min_by("node_id", F.struct("ordinal", "node_id")).alias("_head")
    )
    lists = (
        lists.join(heads, [pair, "_group"])
        .withColumn("_to", F.coalesce("_base", F.concat(F.lit("sync:"), "_head")))
        .withColumn("_new", F.col("_base").isNull())
        .drop("_head")
    )
    lists = materialise(lists, "list-targets")  # read by every step below
    mapped = (
        inc_entries.withColumnRenamed("track_id", "incoming_id")
        .join(ids, [pair, "incoming_id"])
        .join(lists.select(pair, "node_id", "_to", "_turn", "_new"), [pair, "node_id"])
        .select(pair, F.col("_to").alias("node_id"), "_turn", "_new", "position", F.col("merged_id").alias("track_id"))
    )
    mapped = materialise(mapped, "list-entries")
    touched = lists.select(pair, F.col("_to").alias("node_id")).distinct()
    on = [pair, "node_id"]
    old = base_entries.join(touched, on, "left_semi")
    turns = lists.groupBy(pair, F.col("_to").alias("node_id")).agg(F.max("_turn").alias("_last"))

    if policy == "merge":
        member = [*on, "track_id"]
        seen = old.select(*member).distinct()
        first_turn = mapped.groupBy(*member).agg(F.min("_turn").alias("_first"))
        fresh = mapped.join(first_turn, member).where("_turn = _first").drop("_first")
        fresh = fresh.join(seen, member, "left_anti")
        gone = old.limit(0)
        changed = fresh.where("NOT _new OR _turn > 1").select(*on, "_turn").distinct()
    elif policy == "add":
        fresh, gone = mapped.where("_new AND _turn = 1"), old.limit(0)
        changed = fresh.select(*on, "_turn").limit(0)
    elif policy == "replace":
        fresh = mapped.join(turns, on).where("_turn = _last").drop("_last")
        gone = old
        changed = _differing_turns(old, mapped, lists, on)
    else:
        raise ValueError(f"unknown playlist policy {policy!r}")

    kept = base_entries.join(gone.select(*on).distinct(), on, "left_anti")
    base_size = kept.groupBy(*on).agg(F.count(F.lit(1)).alias("_size"))
    ranked_old = ranked(kept, on, "position", "_r", ties=["track_id"])
    ranked_new = ranked(fresh, [*on, "_turn"], "position", "_r", ties=["track_id"])
    per_turn = fresh.groupBy(*on, "_turn").agg(F.count(F.lit(1)).alias("_n"))
    offsets = (
        running(per_turn, on, "_turn", F.col("_n"), "sum", "_off", inclusive=False)
        .join(base_size, on, "left")
        .select(*on, "_turn", (F.col("_off") + F.coalesce("_size", F.lit(0))).alias("_off"))
    )
    entries = ranked_old.select(*on, F.col("_r").alias("position"), "track_id").unionByName(
        ranked_new.join(offsets, [*on, "_turn"]).select(
            *on, (F.col("_r") + F.col("_off")).alias("position"), "track_id"
        )
    )
    added = lists.where("_new AND _turn = 1")
    top = base_nodes.groupBy(pair).agg(F.max("ordinal").alias("_top"))
    new_lists = added.join(top, pair, "left").select(
        pair, F.col("_to").alias("node_id"),
        (F.coalesce("_top", F.lit(0)) + F.col("ordinal") + 1).alias("ordinal"), "path",
        F.lit(False).alias("is_folder"), "is_crate",
    )
    nodes = base_nodes.select(pair, "node_id", "ordinal", "path", "is_folder", "is_crate")
    nodes = nodes.unionByName(new_lists).unionByName(_missing_folders(base_nodes, new_lists))
    report = (
        added.select(pair, F.lit(1).alias("a"), F.lit(0).alias("u"))
        .unionByName(changed.select(pair, F.lit(0).alias("a"), F.lit(1).alias("u")))
        .groupBy(pair)
        .agg(F.sum("a").alias("playlists_added"), F.sum("u").alias("playlists_updated"))
    )
    return nodes, entries, report


def _missing_folders(base_nodes: DataFrame, new_lists: DataFrame) -> DataFrame:
    """One folder row for each path above ``new_lists`` at which the base has no folder.  It
    stands at its first list's ordinal; of nodes with one ordinal the shorter path comes first."""
    above = F.transform(
        F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.slice("path", F.lit(1), i)
    )
    paths = (
        new_lists.where(F.size("path") > 1)
        .select("pair_id", "ordinal", F.explode(above).alias("path"))
        .groupBy("pair_id", "path").agg(F.min("ordinal").alias("ordinal"))
    )
    known = base_nodes.where("is_folder").select("pair_id", "path").distinct()
    return paths.join(known, ["pair_id", "path"], "left_anti").select(
        "pair_id", F.concat(F.lit("sync:folder:"), F.to_json("path")).alias("node_id"), "ordinal", "path",
        F.lit(True).alias("is_folder"), F.lit(False).alias("is_crate"),
    )


def with_parents(nodes: DataFrame, key: str = "pair_id") -> DataFrame:
    """``nodes`` with ``parent_id``: the first folder at the path above, NULL at the top or
    where no node is there.  Writers that need an adjacency list take this."""
    folders = (
        nodes.where("is_folder").groupBy(F.col(key), F.col("path").alias("_above"))
        .agg(F.min_by("node_id", F.struct("ordinal", "node_id")).alias("parent_id"))
    )
    above = F.when(F.size("path") > 1, F.slice("path", F.lit(1), F.size("path") - 1))
    return nodes.drop("parent_id").withColumn("_above", above).join(folders, [key, "_above"], "left").drop("_above")


def _differing_turns(old, mapped, lists, on) -> DataFrame:
    """Turns of a list whose track sequence differs from the one it replaces."""
    before = ranked(old, on, "position", "_r", ties=["track_id"]).select(
        *on, F.lit(0).alias("_turn"), "_r", "track_id"
    )
    after = ranked(mapped, [*on, "_turn"], "position", "_r", ties=["track_id"]).select(
        *on, "_turn", "_r", "track_id"
    )
    states = before.unionByName(after)
    shown = states.withColumn("s", F.lit(1)).unionByName(
        states.withColumn("_turn", F.col("_turn") + 1).withColumn("s", F.lit(-1))
    )
    differs = (
        shown.groupBy(*on, "_turn", "_r", "track_id").agg(F.sum("s").alias("s")).where("s <> 0")
        .select(*on, "_turn").distinct()
    )
    real = lists.select(
        "pair_id", F.col("_to").alias("node_id"), "_turn", "_new"
    ).where("NOT _new OR _turn > 1")
    return differs.join(real.select(*on, "_turn"), [*on, "_turn"], "left_semi")
