"""Path rules and where the music is mounted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segue.functions.text import normalise_path
from segue.plans.ordered import ranked

MAX_BROADCAST_RULES = 50_000  # rule rows; a larger rule table takes the shuffled join


def parse_rule_lines(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """``from => to`` lines to rule rows (``ordinal`` from 0); blank left sides are skipped."""
    lines = df.select(*keys, F.posexplode(F.split(text, "\r\n|\r|\n")).alias("ordinal", "_line"))
    side = F.split("_line", "=>", 2)
    return (
        lines.where(F.contains("_line", F.lit("=>")))
        .select(
            *keys, "ordinal", F.regexp_replace(side[0], r"^\s+|\s+$", "").alias("old"),
            F.regexp_replace(side[1], r"^\s+|\s+$", "").alias("new"),
        )
        .where("old <> ''")
    )


def _old_prefix(old: str) -> str:
    return old.replace("\\", "/").rstrip("/")


def _moved(path: Column, old_length: Column, new: Column) -> Column:
    moved = F.concat(
        F.regexp_replace(new, r"[/\\]+$", ""),
        F.substring(path, old_length + 1, F.length(path)),
    )
    backslashed = F.translate(moved, "/", "\\")
    return F.when(F.contains(new, F.lit("\\")), backslashed).otherwise(moved)


def apply_rules(path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Longest matching prefix wins, first rule on ties; whole path segments, any case,
    any slash direction.  No match leaves the text as it was."""
    usable = [(_old_prefix(old), new) for old, new in rules if _old_prefix(old)]
    usable.sort(key=lambda r: -len(r[0]))  # stable: equal lengths keep rule order
    if not usable:
        return path
    slashed = normalise_path(path)
    lowered = F.lower(slashed)
    out = None
    for old, new in usable:
        hit = (lowered == old.lower()) | lowered.startswith(old.lower() + "/")
        moved = _moved(slashed, F.lit(len(old)), F.lit(new))
        out = F.when(hit, moved) if out is None else out.when(hit, moved)
    return out.otherwise(path)


def _rule_rows(rules: DataFrame) -> DataFrame:
    """One row per (rule_set, lower-case prefix): the first rule."""
    prefix = F.regexp_replace(normalise_path(F.col("old")), "/+$", "")
    return (
        rules.withColumn("_old", prefix)
        .where("_old <> ''")
        .groupBy("rule_set", F.lower("_old").alias("_key"))
        .agg(F.min(F.struct("ordinal", F.length("_old").alias("len"), "new")).alias("_r"))
        .select("rule_set", "_key", "_r.ordinal", "_r.len", "_r.new")
    )


def apply_rule_table(
    df: DataFrame, rules: DataFrame, row_id: Sequence[str], path: str, out: str,
    max_broadcast: int = MAX_BROADCAST_RULES,
) -> DataFrame:
    """Rules per ``rule_set`` (a column of both sides).

    A rule table of checked size is folded to one sorted array per rule set and
    broadcast, so the tracks are not shuffled.  A larger one is joined on the exploded
    path prefixes, an equi join that spreads over (rule_set, prefix).
    """
    prepared = _rule_rows(rules)
    slashed = normalise_path(F.col(path))
    small = rules.limit(max_broadcast + 1).count() <= max_broadcast
    if small:
        order = F.struct((-F.col("len")).alias("a"), F.col("ordinal").alias("b"),
                         F.col("_key").alias("key"), F.col("len"), F.col("new"))
        arrays = prepared.groupBy("rule_set").agg(F.sort_array(F.collect_list(order)).alias("_rs"))
        low = F.lower(slashed)
        hit = F.get(
            F.filter(
                "_rs",
                lambda r: (low == r["key"]) | F.startswith(low, F.concat(r["key"], F.lit("/"))),
            ),
            F.lit(0),
        )
        return (
            df.join(F.broadcast(arrays), "rule_set", "left")
            .withColumn("_hit", hit)
            .withColumn(
                out,
                F.coalesce(_moved(slashed, F.col("_hit.len"), F.col("_hit.new")), F.col(path)),
            )
            .drop("_rs", "_hit")
        )
    parts = F.split(F.lower(slashed), "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )
    best = (
        df.select(*row_id, "rule_set", F.explode(prefixes).alias("_key"))
        .join(prepared, ["rule_set", "_key"])
        .groupBy(*row_id)
        .agg(F.max(F.struct("len", (-F.col("ordinal")).alias("o"), "new")).alias("_hit"))
    )
    return (
        df.join(best, list(row_id), "left")
        .withColumn(
            out, F.coalesce(_moved(slashed, F.col("_hit.len"), F.col("_hit.new")), F.col(path))
        )
        .drop("_hit")
    )


def infer_mounts(missing: DataFrame, inventory: DataFrame) -> DataFrame:
    """Guess ``prefix -> root`` rules per library from where missing files turn up.

    ``missing(library_id, ordinal, location)``; ``inventory(root, root_order, rel_path)``.
    Every location is looked up with an equi join on its path suffixes; the shortest
    prefix, then the first root, gets its vote.
    """
    picked = ranked(missing, ["library_id"], "ordinal", "_rank", ties=["location"])
    parts = F.split(normalise_path(F.col("location")), "/")
    splits = F.transform(
        F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(
            F.array().cast("array<int>")
        ),
        lambda i: F.struct(
            i.alias("at"),
            F.array_join(F.slice(parts, F.lit(1), i), "/").alias("prefix"),
            F.array_join(F.slice(parts, i + 1, F.size(parts)), "/").alias("rel_path"),
        ),
    )
    hits = (
        picked.select("library_id", "_rank", F.explode(splits).alias("s"))
        .select("library_id", "_rank", "s.*")
        .where("prefix <> ''")
        .join(inventory.select("root", "root_order", "rel_path"), "rel_path")
        .groupBy("library_id", "_rank")
        .agg(F.min(F.struct("at", "root_order", "prefix", "root")).alias("h"))
        .where("h.prefix <> h.root")
    )
    votes = hits.groupBy("library_id", "h.prefix", "h.root").agg(
        F.count(F.lit(1)).alias("votes"), F.min("_rank").alias("first_seen")
    )
    # one row for each prefix and root reaches this window
    best = W.partitionBy("library_id", "prefix").orderBy(F.desc("votes"), "first_seen")
    return (
        votes.withColumn("_rn", F.row_number().over(best))
        .where("_rn = 1")
        .select("library_id", "prefix", "root", "votes")
    )
