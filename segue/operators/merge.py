"""Merging matched tracks: metadata, cues, grids, new tracks.

Merged tables keep the base track ids.  Cue and grid rows are never gathered per
track: rules are stated as equi joins on (track, spot) and (track, slot) over
deduplicated keys, so a track with very many rows spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segue.functions.cues import spot
from segue.functions.text import extension
from segue.operators.rewrite import apply_rules
from segue.options import MergeOptions
from segue.plans.ordered import ranked
from segue.schema import TEXT_FIELDS, VALUE_FIELDS
from segue.session import materialise

TRANSCODE_MS = 26.0  # encoder delay between an MP3 and the file it was made from
TRACK = ["pair_id", "track_id"]


def transcode_shift(base_location: Column, inc_location: Column) -> Column:
    """Shift for the incoming side when exactly one of the two files is an MP3 (T4)."""
    b, i = extension(base_location), extension(inc_location)
    return (
        F.when((b == "mp3") & (i != "mp3"), TRANSCODE_MS)
        .when((i == "mp3") & (b != "mp3"), -TRANSCODE_MS)
        .otherwise(0.0)
    )


def links(base: DataFrame, incoming: DataFrame, matches: DataFrame) -> DataFrame:
    """Matched pairs with the time shift of the incoming side."""
    b = base.select("pair_id", F.col("track_id").alias("base_id"), F.col("location").alias("bl"))
    i = incoming.select(
        "pair_id", F.col("track_id").alias("incoming_id"), F.col("location").alias("il")
    )
    return (
        matches.select("pair_id", "incoming_id", "base_id")
        .join(i, ["pair_id", "incoming_id"])
        .join(b, ["pair_id", "base_id"])
        .select(
            "pair_id", "incoming_id", "base_id",
            transcode_shift(F.col("bl"), F.col("il")).alias("shift_ms"),
        )
    )


def to_base_ids(rows: DataFrame, pairs: DataFrame, times: Sequence[str]) -> DataFrame:
    """Child rows of matched incoming tracks under their base id, moved in time."""
    out = rows.withColumnRenamed("track_id", "incoming_id").join(pairs, ["pair_id", "incoming_id"])
    for name in times:
        out = out.withColumn(name, F.col(name) + F.col("shift_ms"))
    return out.withColumn("track_id", F.col("base_id")).select(*rows.columns)


# --- metadata ---------------------------------------------------------------------------
def _given(value: Column, kind: str) -> Column:
    """NULL when the value counts as missing."""
    if kind == "string":
        return F.nullif(value, F.lit(""))
    if kind.startswith(("struct", "date")):
        return value
    return F.nullif(value, F.lit(0).cast(kind))


def merge_metadata(
    base: DataFrame, incoming: DataFrame, pairs: DataFrame, options: MergeOptions
) -> DataFrame:
    """Base tracks with merged fields and a ``changed`` flag (M1)."""
    wins = options.prefer == "incoming" and options.metadata == "replace"
    kinds = dict(base.dtypes)
    fields = [f for f in (*TEXT_FIELDS, *VALUE_FIELDS) if f in kinds and f in incoming.columns]
    extras = [f for f in ("rating", "play_count") if f in kinds and f in incoming.columns]
    new = (
        incoming.withColumnRenamed("track_id", "incoming_id")
        .select("pair_id", "incoming_id", *[F.col(f).alias(f"_n_{f}") for f in fields + extras])
        .join(pairs.select("pair_id", "incoming_id", "base_id"), ["pair_id", "incoming_id"])
        .drop("incoming_id")
        .withColumnRenamed("base_id", "track_id")
    )
    rows = base.join(new, TRACK, "left")
    out, flags = {}, []
    for f in fields + [x for x in extras if x == "rating"]:
        old, inc = F.col(f), _given(F.col(f"_n_{f}"), kinds[f])
        empty = _given(old, kinds[f]).isNull()
        take = inc.isNotNull() & ~inc.eqNullSafe(old) & (F.lit(True) if wins else empty)
        out[f] = F.when(take, inc).otherwise(old)
        flags.append(take)
    if "play_count" in extras:
        more = F.coalesce(F.col("_n_play_count") > F.coalesce("play_count", F.lit(0)), F.lit(False))
        out["play_count"] = F.when(more, F.col("_n_play_count")).otherwise(F.col("play_count"))
        flags.append(more)
    changed = F.lit(False)
    for flag in flags:
        changed = changed | flag
    return rows.select(
        *[(out[n].alias(n) if n in out else F.col(n)) for n in base.columns],
        changed.alias("changed"),
    )


# --- cues ---------------------------------------------------------------------------------
_SPOT = [*TRACK, "is_loop", "spot"]
_SLOT = [*TRACK, "slot"]


def with_spot(cues: DataFrame) -> DataFrame:
    loop, bin_ = spot(F.col("role"), F.col("position_ms"))
    return cues.withColumn("is_loop", loop).withColumn("spot", bin_)


def _free_places(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of ``second``, in order, at spots and slots neither ``first`` nor an earlier kept
    row of ``second`` uses.

    Rows alike in slot and spot are one row (the first).  A slotted row with an earlier
    unslotted row at its spot is always dropped: whatever that row's fate, the spot is
    used by then.  Slotted rows then only compete with each other; at most one per slot
    is kept, so of each slot only as many rows as there are slots can matter, and those
    few go through a fold.  An unslotted row only loses to an earlier kept slotted one.
    """
    taken_spots = first.select(*_SPOT).distinct()
    taken_slots = first.where("slot IS NOT NULL").select(*_SLOT).distinct()
    rest = [x for x in second.columns if x not in (*_SPOT, "slot", "ordinal")]
    alike = (
        second.groupBy(*_SPOT, "slot")
        .agg(F.min(F.struct("ordinal", *rest)).alias("r"))
        .join(taken_spots, _SPOT, "left_anti")
        .join(taken_slots, _SLOT, "left_anti")
        .select(*_SPOT, "slot", "r.*")
    )
    plain = alike.where("slot IS NULL")
    earlier = plain.select(*_SPOT, F.col("ordinal").alias("_p"))
    slotted = (
        alike.where("slot IS NOT NULL")
        .join(earlier, _SPOT, "left")
        .where("_p IS NULL OR _p > ordinal")
        .drop("_p")
    )
    kept = _one_per_slot(slotted)
    before = kept.select(*_SPOT, F.col("ordinal").alias("_s"))
    free = plain.join(before, _SPOT, "left").where("_s IS NULL OR _s > ordinal").drop("_s")
    return kept.unionByName(free).select(*second.columns)


def _one_per_slot(slotted: DataFrame) -> DataFrame:
    n_slots = slotted.select(*_SLOT).distinct().groupBy(*TRACK).agg(F.count(F.lit(1)).alias("_k"))
    in_slot = W.partitionBy(*_SLOT).orderBy("ordinal")
    few = (
        slotted.select(*_SPOT, "slot", "ordinal")
        .withColumn("_rn", F.row_number().over(in_slot))
        .join(n_slots, TRACK)
        .where("_rn <= _k")
    )
    spots = "array<struct<is_loop:boolean,spot:bigint>>"
    state = F.struct(
        F.array().cast("array<int>").alias("slots"), F.array().cast(spots).alias("spots"),
        F.array().cast("array<bigint>").alias("kept"),
    )

    def step(acc: Column, c: Column) -> Column:
        at = F.struct(c["is_loop"].alias("is_loop"), c["spot"].alias("spot"))
        blocked = F.array_contains(acc["slots"], c["slot"]) | F.array_contains(acc["spots"], at)
        return F.when(blocked, acc).otherwise(
            F.struct(
                F.array_append(acc["slots"], c["slot"]).alias("slots"),
                F.array_append(acc["spots"], at).alias("spots"),
                F.array_append(acc["kept"], c["ordinal"]).alias("kept"),
            )
        )

    kept = (
        few.groupBy(*TRACK)
        .agg(F.sort_array(F.collect_list(F.struct("ordinal", "slot", "is_loop", "spot"))).alias("c"))
        .select(
            *TRACK,
            F.explode(F.aggregate("c", state, step, lambda acc: acc["kept"])).alias("ordinal"),
        )
    )
    return slotted.join(kept, [*TRACK, "ordinal"], "left_semi")


def merge_cues(
    base: DataFrame, incoming: DataFrame, options: MergeOptions
) -> tuple[DataFrame, DataFrame]:
    """(merged cues, ids of changed tracks); ``incoming`` already carries base ids (M2).

    Cues of a track read in the order (position_ms, side, ordinal).
    """
    b = with_spot(base).withColumn("side", F.lit(0))
    # a join of cues and matches that every rule below reads: written once
    i = materialise(with_spot(incoming).withColumn("side", F.lit(1)), "incoming-cues")
    got = i.select(*TRACK).distinct()  # tracks without incoming cues stay as they are
    had = base.select(*TRACK).distinct()
    if options.cues == "fill" or (options.cues == "replace" and options.prefer != "incoming"):
        fresh = i.join(had, TRACK, "left_anti")
        merged = b.unionByName(fresh)
        changed = fresh.select(*TRACK).distinct()
        return _cue_columns(merged, base), changed
    untouched = b.join(got, TRACK, "left_anti")
    active = b.join(got, TRACK, "left_semi")
    if options.cues == "replace":
        after = i
    else:
        first, second = (i, active) if options.prefer == "incoming" else (active, i)
        after = first.withColumn("side", F.lit(0)).unionByName(
            _free_places(first, second).withColumn("side", F.lit(1))
        )
    return _cue_columns(untouched.unionByName(after), base), changed_marks(active, after)


def _cue_columns(merged: DataFrame, like: DataFrame) -> DataFrame:
    names = [n for n in like.columns if n != "side"]
    return merged.select(*names, "side")


def numbered_cues(merged: DataFrame) -> DataFrame:
    """Merged cues with the ordinals 1, 2, ... of the order they read in, without ``side``.

    Both sides' ordinals may be equal, so cues that are to be merged again need this first.
    """
    rows = ranked(merged, TRACK, "position_ms", "_place", ties=["side", "ordinal"])
    return rows.withColumn("ordinal", F.col("_place")).drop("_place", "side")


def marks(cues: DataFrame) -> DataFrame:
    """What a DJ would notice, one row per mark: spots, hot cues A-H, their names (M5)."""
    text = lambda *p: F.concat_ws("|", *[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in p])
    hot = F.col("slot").between(0, 7)
    place = (F.col("is_loop"), F.col("spot"))
    found = F.array(
        text("spot", *place),
        F.when(hot, text("hot", F.col("slot"), *place)),
        F.when(hot & (F.col("name") != ""), text("name", F.col("slot"), F.col("name"))),
    )
    return cues.select(*TRACK, F.explode(F.array_compact(found)).alias("mark"))


def changed_marks(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tracks whose visible marks differ; copies of a mark collapse on the map side."""
    both = (
        marks(before).withColumn("b", F.lit(1)).withColumn("a", F.lit(0))
        .unionByName(marks(after).withColumn("b", F.lit(0)).withColumn("a", F.lit(1)))
    )
    return (
        both.groupBy(*TRACK, "mark").agg(F.max("b").alias("b"), F.max("a").alias("a"))
        .where("a <> b").select(*TRACK).distinct()
    )


# --- grids ----------------------------------------------------------------------------------
def merge_grids(
    base: DataFrame, incoming: DataFrame, options: MergeOptions
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged tempo, ids whose grid was replaced, ids that visibly changed) (M3)."""
    got, had = incoming.select(*TRACK).distinct(), base.select(*TRACK).distinct()
    replaced = got
    if options.grids == "fill" or options.prefer != "incoming":
        replaced = got.join(had, TRACK, "left_anti")
    taken = incoming.join(replaced, TRACK, "left_semi")
    merged = base.join(replaced, TRACK, "left_anti").unionByName(taken)

    def seen(df: DataFrame, sign: int) -> DataFrame:
        return df.select(
            *TRACK, F.rint("position_ms").alias("p"), F.bround("bpm", 2).alias("t"),
            F.lit(sign).alias("s"),
        )

    old = base.join(replaced, TRACK, "left_semi")
    changed = (
        seen(old, -1).unionByName(seen(taken, 1))
        .groupBy(*TRACK, "p", "t").agg(F.sum("s").alias("s")).where("s <> 0")
        .select(*TRACK).distinct()
    )
    return merged, replaced, changed


def lock_replaced(tracks: DataFrame, inc_locks: DataFrame, replaced: DataFrame) -> DataFrame:
    """A replaced grid brings its lock: the flags are ORed.  ``inc_locks(pair_id, track_id,
    locked)`` carries base ids."""
    lock = inc_locks.join(replaced, TRACK, "left_semi").withColumnRenamed("locked", "_l")
    return (
        tracks.join(lock, TRACK, "left")
        .withColumn("bpm_locked", F.col("bpm_locked") | F.coalesce("_l", F.lit(False)))
        .drop("_l")
    )


# --- tracks ------------------------------------------------------------------------------------
def first_by_id(tracks: DataFrame, keys: Sequence[str] = ("library_id", "track_id")) -> DataFrame:
    """Duplicate ids keep the first track (U3); aggregated on the map side."""
    rest = [x for x in tracks.columns if x not in (*keys, "ordinal")]
    return (
        tracks.groupBy(*keys)
        .agg(F.min_by(F.struct("ordinal", *rest), "ordinal").alias("r"))
        .select(*keys, "r.*")
        .select(*tracks.columns)
    )


def new_tracks(incoming: DataFrame, matches: DataFrame, options: MergeOptions) -> DataFrame:
    """Unmatched incoming tracks under new ids and rewritten locations."""
    used = matches.select("pair_id", F.col("incoming_id").alias("track_id"))
    return (
        incoming.join(used, TRACK, "left_anti")
        .withColumn("location", apply_rules(F.col("location"), options.path_rules))
        .withColumn("track_id", F.concat(F.lit("sync:"), "track_id"))
    )


def id_map(incoming: DataFrame, matches: DataFrame, options: MergeOptions) -> DataFrame:
    """Incoming id -> id in the merged library."""
    known = matches.select("pair_id", "incoming_id", F.col("base_id").alias("merged_id"))
    if not options.add_tracks:
        return known
    return (
        incoming.select("pair_id", F.col("track_id").alias("incoming_id"))
        .join(known, ["pair_id", "incoming_id"], "left")
        .withColumn(
            "merged_id", F.coalesce("merged_id", F.concat(F.lit("sync:"), "incoming_id"))
        )
    )
