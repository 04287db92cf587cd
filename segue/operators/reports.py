"""Reports, counts and data-quality rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segue.functions.keys import format_key
from segue.functions.text import file_name, normalise_path


def in_hidden_folder(rel_path: Column) -> Column:
    """Any part starting with ``.`` or ``$``, except ``.mixxx``."""
    return F.exists(
        F.split(rel_path, "/"),
        lambda p: (p != ".mixxx") & (p.startswith(".") | p.startswith("$")),
    )


def search(needle: str, *columns: Column) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(needle.lower()))


def visible(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows whose soft-delete/hidden flags are 0; flags a source lacks are ignored."""
    for flag in flags:
        if flag in df.columns:
            df = df.where(F.col(flag) == 0)
    return df


def library_summary(
    tracks: DataFrame, cues: DataFrame, tempo: DataFrame, nodes: DataFrame
) -> DataFrame:
    """Tracks, playlists, hot cues, memory cues and gridded tracks per library (G1).

    Four independent partial aggregates, united and summed: nothing is joined row by row.
    """
    zero = F.lit(0).cast("bigint")

    def counts(df: DataFrame, **named: Column) -> DataFrame:
        names = ("tracks", "playlists", "hot_cues", "memory_cues", "gridded")
        return df.groupBy("library_id").agg(*[named.get(n, F.max(zero)).alias(n) for n in names])

    hot = F.col("slot").isNotNull()
    parts = [
        counts(tracks, tracks=F.count(F.lit(1))),
        counts(nodes.where(~F.col("is_folder")), playlists=F.count(F.lit(1))),
        counts(cues, hot_cues=F.count(F.when(hot, 1)), memory_cues=F.count(F.when(~hot, 1))),
        counts(tempo.select("library_id", "track_id").distinct(), gridded=F.count(F.lit(1))),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.groupBy("library_id").agg(
        *[F.sum(n).alias(n) for n in ("tracks", "playlists", "hot_cues", "memory_cues", "gridded")]
    )


def track_rows(tracks: DataFrame, cues: DataFrame, tempo: DataFrame) -> DataFrame:
    """One line per track: cue counts and grid size, zero where it has none."""
    on = ["library_id", "track_id"]
    hot = F.col("slot").isNotNull()
    marks = cues.groupBy(*on).agg(
        F.count(F.when(hot, 1)).alias("hot_cues"), F.count(F.when(~hot, 1)).alias("memory_cues")
    )
    grids = tempo.groupBy(*on).agg(F.count(F.lit(1)).alias("grid"))
    out = tracks.join(marks, on, "left").join(grids, on, "left")
    title = F.when(F.col("title") != "", F.col("title")).otherwise(file_name(F.col("location")))
    keys = (
        [F.concat_ws(" / ", *[format_key(F.col("key"), n) for n in ("camelot", "open_key", "musical")]).alias("keys")]
        if "key" in tracks.columns
        else []
    )
    zero = {n: F.coalesce(n, F.lit(0)).alias(n) for n in ("hot_cues", "memory_cues", "grid")}
    return out.select(
        *on, "artist", title.alias("title"), F.bround("bpm", 2).alias("bpm"), "location",
        *zero.values(), *keys,
    )


def playlist_sizes(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries per playlist, empty ones included."""
    on = ["library_id", "node_id"]
    sizes = entries.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    return (
        nodes.where(~F.col("is_folder"))
        .join(sizes, on, "left")
        .withColumn("tracks", F.coalesce("n", F.lit(0)))
        .drop("n")
    )


def top_folder(location: Column) -> Column:
    """The first folders of a location: four parts when absolute, else three."""
    parts = F.split(normalise_path(location), "/")
    depth = F.when(F.get(parts, F.lit(0)) == "", 4).otherwise(3)
    return F.array_join(F.slice(parts, F.lit(1), depth), "/")


def folder_counts(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("library_id", top_folder(F.col("location")).alias("folder")).agg(
        F.count(F.lit(1)).alias("tracks"), F.min("ordinal").alias("first_seen")
    )


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The first ``k`` rows per group: each map task keeps at most ``k`` before the exchange."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def common_folders(tracks: DataFrame, k: int = 6) -> DataFrame:
    """The ``k`` most common top folders per library, earliest first on ties."""
    top = first_k(folder_counts(tracks), ["library_id"], [F.desc("tracks"), "first_seen"], k)
    return top.drop("first_seen")


def track_page(tracks: DataFrame, k: int, *order) -> DataFrame:
    """One page of tracks with the total of the whole selection (L2).

    The page is a distributed top-k; the total is a scalar subquery, not a join.
    """
    total = tracks.agg(F.count(F.lit(1)).alias("total"))
    return tracks.orderBy(*order).limit(k).withColumn("total", total.scalar())


def missing_files(tracks: DataFrame, inventory: DataFrame) -> DataFrame:
    """Tracks whose location no inventory row has."""
    present = inventory.select(
        F.concat("root", F.lit("/"), "rel_path").alias("location")
    )
    return tracks.join(present, "location", "left_anti")


def issue_rows(df: DataFrame, rule: str, entity: str, detail: Column) -> DataFrame:
    return df.select(
        "library_id", F.lit(rule).alias("rule"), F.col(entity).cast("string").alias("entity_id"),
        detail.cast("string").alias("detail"),
    )


def placement_issues(plan: DataFrame, name: Column) -> DataFrame:
    """Issue rows of a placement plan (G7): tracks left out because the players can't play them or because
    their file is not there, and tracks with placeholder analyses. ``name`` tells the track."""
    left_out = {"unplayable": "unplayable format", "skip": "not on the device"}
    rows = [issue_rows(plan.where(F.col("action") == a), rule, "track_id", name) for a, rule in left_out.items()]
    if "analysis" in plan.columns:
        rows.append(issue_rows(plan.where("analysis = 'placeholder'"), "placeholder waveform", "track_id", name))
    return reduce(DataFrame.unionByName, rows)


def rate_issues(measured: DataFrame) -> DataFrame:
    """Tracks whose sample rate neither the file nor the catalogue tells."""
    return issue_rows(measured.where("rate_unknown"), "unknown sample rate", "track_id", F.col("location"))


def dropped_cue_issues(leftovers: DataFrame) -> DataFrame:
    """Tracks with cues or loops that found no slot (G7). ``leftovers(library_id, track_id,
    leftover_cues, leftover_loops)``."""
    some = leftovers.where("leftover_cues > 0 OR leftover_loops > 0")
    detail = F.concat(F.col("leftover_cues").cast("string"), F.lit(" cues, "), F.col("leftover_loops").cast("string"), F.lit(" loops"))
    return issue_rows(some, "cues without a slot", "track_id", detail)


def issue_counts(issues: DataFrame, examples: int = 3) -> DataFrame:
    """Issues per library and rule with the first few details.

    Counting aggregates on the map side; examples come from a per-rule top-k, so a rule
    that fires on a third of all rows moves only a few of them.
    """
    on = ["library_id", "rule"]
    counts = issues.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    some = (
        first_k(issues, on, ["entity_id", "detail"], examples)
        .groupBy(*on)
        .agg(F.sort_array(F.collect_list(F.struct("entity_id", "detail"))).alias("e"))
        .select(*on, F.array_join(F.transform("e", lambda x: x["detail"]), ", ").alias("examples"))
    )
    return counts.join(some, on)


def placement_summary(plan: DataFrame) -> DataFrame:
    """Copied, transcoded, in place, skipped, reused, measured and placeholder counts."""
    def n(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0))

    action, waves = F.col("action"), F.col("analysis")
    return plan.groupBy("library_id").agg(
        *[n(action == a).alias(a.replace(" ", "_")) for a in ("copy", "transcode", "in place", "skip", "unplayable")],
        *[n(waves == a).alias(a) for a in ("reused", "measured", "placeholder")],
    )
