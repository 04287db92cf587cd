"""Tiered one-to-one matching of two catalogues.

Tiers run one after another: same path, same stem and size, same artist and title
with close durations, same stem.  A pair is made only when exactly one base track
is still free for the incoming track.

The three equality tiers need no sequence: all incoming tracks of a key see the same
candidates, so the first incoming track takes the only free base track.  Both sides
are reduced to one row per key by partial aggregation before the join, so a key
shared by a third of all rows costs one row per map task.

In the artist+title tier the duration tolerance gives incoming tracks of one block
different candidates, and an early pair can make a later track unambiguous.  Blocks
with one free base track stay relational.  In the others, tracks of equal duration
behave alike and are collapsed to one row (plus the first few incoming ordinals); what remains
goes through a small sequential fold per block.  Blocks that are still large are first cut
at duration gaps, and parts in which no track starts with exactly one candidate are
dropped: nothing can ever match there.
"""

from __future__ import annotations


from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segue.functions.text import norm_text, path_key, stem_key
from segue.operators.rewrite import apply_rules
from segue.options import MergeOptions
from segue.plans.ordered import neighbours, running
from segue.session import materialise

RULES = ("path", "name+size", "artist+title", "file name")
FIRST_ROWS = 32  # incoming rows per (block, duration) handed to the fold at first
WHOLE_BLOCK_GROUPS = 20_000  # larger blocks are cut at duration gaps before the fold
_BLOCK = ["pair_id", "artist_key", "title_key"]
MATCH_SCHEMA = "pair_id string, incoming_id string, base_id string, rule string"


def with_pair(df: DataFrame, pair_id: str = "all") -> DataFrame:
    return df if "pair_id" in df.columns else df.withColumn("pair_id", F.lit(pair_id))


def match_keys(tracks: DataFrame, rules=(), exact_text: bool = True) -> DataFrame:
    """The slim row the tiers work on."""
    c = F.col
    return tracks.select(
        "pair_id", c("track_id").alias("id"), c("ordinal").cast("bigint").alias("ordinal"),
        path_key(apply_rules(c("location"), rules), exact_text).alias("path_key"),
        stem_key(c("location"), exact_text).alias("stem"),
        F.coalesce(c("file_size").cast("bigint"), F.lit(0)).alias("size"),
        norm_text(c("artist"), exact_text).alias("artist_key"),
        norm_text(c("title"), exact_text).alias("title_key"),
        (c("title") != "").alias("has_title"),
        F.coalesce(c("duration_s").cast("double"), F.lit(0.0)).alias("duration"),
    )


def _pairs(inc: DataFrame, base: DataFrame, key: list[str], rule: str) -> DataFrame:
    """Keys with one free base track, joined to their first incoming track."""
    on = ["pair_id", *key]
    free = base.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("base_id"))
    first = inc.groupBy(*on).agg(F.min_by("id", F.struct("ordinal", "id")).alias("incoming_id"))
    return (
        first.join(free.where("_n = 1"), on)
        .select("pair_id", "incoming_id", "base_id", F.lit(rule).alias("rule"))
    )


def _without(rows: DataFrame, matches: DataFrame, column: str) -> DataFrame:
    used = matches.select("pair_id", F.col(column).alias("id"))
    return rows.join(used, ["pair_id", "id"], "left_anti")


def match_tracks(
    base: DataFrame, incoming: DataFrame, options: MergeOptions = MergeOptions(),
    exact_text: bool = True,
) -> DataFrame:
    """``(pair_id, incoming_id, base_id, rule)``; inputs are track tables with ``pair_id``."""
    base_keys = match_keys(with_pair(base), (), exact_text)
    inc_keys = match_keys(with_pair(incoming), options.path_rules, exact_text)
    keys = materialise(
        base_keys.withColumn("side", F.lit("b")).unionByName(
            inc_keys.withColumn("side", F.lit("i"))
        ),
        "match-keys",
    )
    all_base = keys.where("side = 'b'").drop("side")
    all_inc = keys.where("side = 'i'").drop("side")

    # Path: of several base tracks with one path only the last is known.
    last = all_base.groupBy("pair_id", "path_key").agg(
        F.max_by("id", F.struct("ordinal", "id")).alias("id")
    )
    matches = materialise(_pairs(all_inc, last, ["path_key"], RULES[0]), "match-path")

    base, inc = _without(all_base, matches, "base_id"), _without(all_inc, matches, "incoming_id")
    sized = _pairs(inc.where("size <> 0"), base.where("size <> 0"), ["stem", "size"], RULES[1])
    matches = matches.unionByName(materialise(sized, "match-size"))

    base, inc = _without(all_base, matches, "base_id"), _without(all_inc, matches, "incoming_id")
    tags = tag_pairs(
        inc.where("has_title"), base.where("has_title"), options.duration_tolerance_s
    )
    matches = matches.unionByName(tags)

    base, inc = _without(all_base, matches, "base_id"), _without(all_inc, matches, "incoming_id")
    named = _pairs(inc, base, ["stem"], RULES[3])
    return matches.unionByName(materialise(named, "match-name"))


# --- artist + title -------------------------------------------------------------------


def tag_pairs(inc: DataFrame, base: DataFrame, tolerance: float) -> DataFrame:
    """The artist+title tier over the rows the earlier tiers left."""
    groups = materialise(_collapsed(inc, base), "match-groups")
    c = F.col
    is_base = c("kind") == "b"
    blocks = groups.groupBy(*_BLOCK).agg(
        F.sum(F.when(is_base, c("n"))).alias("base_n"),
        F.sum(F.when(is_base & (c("duration") == 0), c("n")).otherwise(0)).alias("zero_n"),
        F.count(F.when(~is_base, 1)).alias("inc_groups"),
        F.count(F.lit(1)).alias("block_groups"),
    )
    # two base tracks without duration cannot be told apart by anything in their block
    open_blocks = blocks.where("base_n >= 1 AND inc_groups >= 1 AND zero_n < 2")

    # One free base track in the block: the first incoming track within tolerance.
    alone = open_blocks.where("base_n = 1").select(*_BLOCK)
    lone = groups.where(is_base).join(alone, _BLOCK)
    d, bd = c("duration"), c("bd")
    near = (d == 0) | (bd == 0) | (F.abs(d - bd) <= F.lit(float(tolerance)))
    simple = (
        groups.where(~is_base)
        .join(lone.select(*_BLOCK, c("duration").alias("bd"), c("id").alias("base_id")), _BLOCK)
        .where(near)
        .groupBy(*_BLOCK, "base_id")
        .agg(F.min(F.struct(c("first")[0]["ordinal"], c("first")[0]["id"].alias("id"))).alias("f"))
        .select("pair_id", c("f.id").alias("incoming_id"), "base_id", F.lit(RULES[2]).alias("rule"))
    )

    several = open_blocks.where("base_n > 1")
    work = groups.join(
        several.where(c("block_groups") <= WHOLE_BLOCK_GROUPS).select(*_BLOCK), _BLOCK
    ).withColumn("component", F.lit(-1.0))
    large = several.where(c("block_groups") > WHOLE_BLOCK_GROUPS).select(*_BLOCK, "zero_n")
    if not large.isEmpty():
        parts = _components(groups.join(large, _BLOCK), tolerance)
        live = _seeded(parts, tolerance)
        work = work.unionByName(parts.join(live, [*_BLOCK, "component"], "left_semi"))
    return _fold_rounds(work, simple, inc, tolerance)


def _collapsed(inc: DataFrame, base: DataFrame) -> DataFrame:
    """Tracks of one block and duration behave alike: one row each.  A base row keeps its
    count and an id, an incoming row its first few ordinals (ranked before the exchange,
    so a group of copies sends only those)."""
    at = [*_BLOCK, "duration"]
    base_groups = base.groupBy(*at).agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.min("id").alias("id")
    )
    order = W.partitionBy(*at).orderBy("ordinal", "id")
    inc_groups = (
        inc.withColumn("_rn", F.row_number().over(order))
        .where(F.col("_rn") <= FIRST_ROWS + 1)
        .groupBy(*at)
        .agg(F.sort_array(F.collect_list(F.struct("ordinal", "id"))).alias("first"))
    )
    return base_groups.select(
        *at, F.lit("b").alias("kind"), "n", "id",
        F.lit(None).cast("array<struct<ordinal:bigint,id:string>>").alias("first"),
    ).unionByName(
        inc_groups.select(
            *at, F.lit("i").alias("kind"), F.size("first").alias("n"),
            F.lit(None).cast("string").alias("id"), "first",
        )
    )


def _components(rows: DataFrame, tolerance: float) -> DataFrame:
    """Cut blocks where sorted durations leave a gap wider than the tolerance: no incoming
    track has a candidate across it.  A track without duration ties its block together."""
    on = [*_BLOCK, "duration"]
    zero = rows.where("kind = 'i' AND duration = 0").select(*_BLOCK).distinct()
    rows = rows.join(zero.withColumn("_z", F.lit(True)), _BLOCK, "left")
    tied = (F.col("zero_n") > 0) | F.coalesce("_z", F.lit(False))
    rows = rows.withColumn("tied", tied).drop("_z", "zero_n")
    slim = rows.select(*on, "kind")
    slim = neighbours(slim, _BLOCK, "duration", ["duration"], "before", ["kind"])
    gap = F.col("before").isNull() | (
        F.col("duration") - F.col("before.duration") > F.lit(float(tolerance) * 1.000001 + 1e-9)
    )
    slim = running(slim, _BLOCK, "duration", F.when(gap, F.col("duration")), "last", "component", ["kind"])
    out = rows.join(slim.select(*on, "kind", "component"), [*on, "kind"])
    return out.withColumn(
        "component", F.when(F.col("tied"), F.lit(-1.0)).otherwise(F.col("component"))
    ).drop("tied")


def _seeded(parts: DataFrame, tolerance: float) -> DataFrame:
    """Components in which some incoming track starts with exactly one candidate; in the
    others nothing can ever match.

    Counted with running sums over the sorted durations, not by pairing rows, and once
    with the window a rounding margin wider and once narrower: either count being one
    keeps the component.
    """
    on = [*_BLOCK, "component"]
    d = F.col("duration")
    ends = [
        F.struct(
            (d + F.lit(side * (tolerance + eps))).alias("at"), F.lit(side).alias("side"),
            F.lit(k).alias("which"),
        )
        for k, eps in enumerate((1e-6, -1e-6))
        for side in (-1, 1)
    ]
    queries = parts.where("kind = 'i' AND duration <> 0").select(
        *on, "duration", F.explode(F.array(*ends)).alias("q")
    )
    events = queries.select(
        *on, "duration", "q.at", "q.side", "q.which", F.lit(0).cast("bigint").alias("w")
    ).unionByName(
        parts.where("kind = 'b' AND duration <> 0").select(
            *on, "duration", d.alias("at"), F.lit(0).alias("side"), F.lit(0).alias("which"),
            F.col("n").cast("bigint").alias("w"),
        )
    )
    cum = running(events, on, "at", F.col("w"), "sum", "cum", ["side", "which", "duration"])
    counts = (
        cum.where("side <> 0")
        .groupBy(*on, "duration", "which")
        .agg(F.sum(F.col("side") * F.col("cum")).alias("c"))
    )
    zero_base = parts.where("kind = 'b' AND duration = 0").groupBy(*on).agg(F.sum("n").alias("z"))
    return (
        counts.join(zero_base, on, "left")
        .where(F.col("c") + F.coalesce("z", F.lit(0)) == 1)
        .select(*on)
        .distinct()
    )


FOLD_SCHEMA = (
    "pair_id string, artist_key string, title_key string, component double, duration double, "
    "incoming_id string, base_id string, after bigint"
)


def fold_block(
    base: list[tuple[float, str, int]], inc: list[tuple[int, str, float, bool]], tolerance: float
) -> tuple[list[tuple[str, str]], list[tuple[float, int]]]:
    """Walk a block's incoming rows in order; take a base track when it is the only free one.

    ``base`` holds (duration, id, tracks of that duration), ``inc`` (ordinal, id, duration,
    whether that duration has rows beyond those supplied).  Returns the pairs, or the rows some group still needs as
    (duration, after ordinal) when the first few of that group were not enough.
    """
    zero_free = [i for d, i, _ in base if d == 0]
    timed = sorted(b for b in base if b[0] != 0)
    durations = [b[0] for b in timed]
    total = sum(b[2] for b in timed) + len(zero_free)
    nxt = list(range(len(timed) + 1))  # next free group at or after a position

    def find(i: int) -> int:
        while nxt[i] != i:
            nxt[i] = nxt[nxt[i]]
            i = nxt[i]
        return i

    def candidates(d: float) -> tuple[int, int]:
        """Free candidates (counted up to two) and the position of the last one found."""
        if d == 0:
            return min(total, 2), (find(0) if total == 1 and not zero_free else -1)
        count, where = len(zero_free), -1
        i = find(bisect_left(durations, d - tolerance - 1e-6))
        while i < len(durations) and count < 2 and durations[i] - d <= tolerance + 1e-6:
            if abs(d - durations[i]) <= tolerance:
                count += timed[i][2]
                where = i
            i = find(i + 1)
        return count, where

    unseen: dict[float, int] = {}
    for _, _, d, _ in inc:
        unseen[d] = unseen.get(d, 0) + 1
    cut_short = sorted({d for _, _, d, more in inc if more})
    pairs: list[tuple[str, str]] = []
    for ordinal, track, d, _ in sorted(inc):
        unseen[d] -= 1
        count, where = candidates(d)
        if count != 1:
            continue
        total -= 1
        if where < 0:
            pairs.append((track, zero_free.pop()))
        else:
            pairs.append((track, timed[where][1]))
            nxt[where] = where + 1
        wanted = [(g, ordinal) for g in cut_short if not unseen[g] and candidates(g)[0] == 1]
        if wanted:
            return [], wanted
    return pairs, []


def _fold_partition(tolerance: float):
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                base = list(zip(r.b_duration, r.b_id, r.b_n))
                inc = list(zip(r.i_ordinal, r.i_id, r.i_duration, r.i_more))
                pairs, wanted = fold_block(base, inc, tolerance)
                head = (r.pair_id, r.artist_key, r.title_key, r.component)
                out += [(*head, None, i, b, None) for i, b in pairs]
                out += [(*head, d, None, None, after) for d, after in wanted]
            frame = pd.DataFrame(
                out, columns=["pair_id", "artist_key", "title_key", "component", "duration",
                              "incoming_id", "base_id", "after"],
            )
            frame["after"] = frame["after"].astype("Int64")
            frame["duration"] = frame["duration"].astype("float64")
            yield frame

    return run


def _fold(work: DataFrame, tolerance: float) -> DataFrame:
    """One row per block with its collapsed groups as arrays, folded partition by partition."""
    c = F.col
    is_base = c("kind") == "b"
    blocks = work.groupBy(*_BLOCK, "component").agg(
        F.collect_list(F.when(is_base, F.struct("duration", "id", "n"))).alias("b"),
        F.flatten(
            F.collect_list(
                F.when(
                    ~is_base,
                    F.transform("first", lambda f: F.struct(f["ordinal"].alias("ordinal"), f["id"].alias("id"), c("duration").alias("duration"), (c("n") > FIRST_ROWS).alias("more"))),
                )
            )
        ).alias("i"),
    )
    flat = blocks.select(
        *_BLOCK, "component",
        *[c(f"b.{f}").alias(f"b_{f}") for f in ("duration", "id", "n")],
        *[c(f"i.{f}").alias(f"i_{f}") for f in ("ordinal", "id", "duration", "more")],
    )
    return flat.mapInPandas(_fold_partition(tolerance), FOLD_SCHEMA)


def _fold_rounds(
    work: DataFrame, simple: DataFrame, inc: DataFrame, tolerance: float
) -> DataFrame:
    """Fold every block; blocks that asked for a row get it and are folded again."""
    on = [*_BLOCK, "component"]
    at = [*on, "duration"]
    none = F.lit(None)
    found = None
    while True:
        folded = _fold(work, tolerance)
        if found is None:  # the one-candidate blocks ride along with the first round
            folded = folded.unionByName(
                simple.select(
                    "pair_id", "incoming_id", "base_id",
                    *[none.cast("string").alias(k) for k in _BLOCK[1:]],
                    none.cast("double").alias("component"),
                    none.cast("double").alias("duration"), none.cast("bigint").alias("after"),
                )
            )
        folded = materialise(folded, "match-tags")
        done = folded.where("after IS NULL").select(
            "pair_id", "incoming_id", "base_id", F.lit(RULES[2]).alias("rule")
        )
        found = done if found is None else found.unionByName(done)
        asked = folded.where("after IS NOT NULL").select(*at, "after")
        if asked.isEmpty():
            return found
        row = F.struct("ordinal", "id")
        more = (
            inc.join(asked, [*_BLOCK, "duration"])
            .where("ordinal > after")
            .groupBy(*at)
            .agg(F.min(row).alias("f"))
        )
        # a group without a later row is complete: every row it has was supplied
        answer = asked.select(*at, F.lit("i").alias("kind")).join(more, at, "left")
        again = work.join(asked.select(*on).distinct(), on, "left_semi").join(
            answer.withColumn("answered", F.lit(True)), [*at, "kind"], "left"
        )
        first = F.when(F.col("f").isNotNull(), F.array_append("first", F.col("f"))).otherwise(
            F.col("first")
        )
        work = materialise(
            again.withColumn("first", first)
            .withColumn("n", F.when(F.col("answered"), F.lit(0)).otherwise(F.col("n")))
            .select(*at, "kind", "n", "id", "first"),
            "match-blocks",
        )


def match_report(base: DataFrame, incoming: DataFrame, matches: DataFrame) -> DataFrame:
    """Per pair and rule: tracks matched; unmatched incoming tracks count as ``added``."""
    one = F.lit(1).cast("bigint")
    by_rule = matches.select("pair_id", "rule", one.alias("n"))
    unmatched = with_pair(incoming).select("pair_id", one.alias("n")).unionByName(
        matches.select("pair_id", (-one).alias("n"))
    )
    rows = by_rule.unionByName(unmatched.withColumn("rule", F.lit("added")).select("pair_id", "rule", "n"))
    return rows.groupBy("pair_id", "rule").agg(F.sum("n").alias("tracks"))
