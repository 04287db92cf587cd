"""Landed tables to neutral rows: shared join helpers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_NAMES = 200_000  # rows of a dimension small enough to copy to every executor


def name_lookup(
    fact: DataFrame, dims: Mapping[str, tuple[DataFrame, str, str]], library: bool = True
) -> DataFrame:
    """Left-join a name per id column (J5): ``dims`` maps an output column to
    ``(dimension, its name column, the fact's id column)``; a dimension may serve several
    roles.  A missing id gives ''.

    Dimensions hold ``id`` (and ``library_id``) and are reduced to one row per id,
    the least name of several.  One of
    checked size is broadcast; a larger one is joined by shuffle, NULL ids set aside by
    the outer join.
    """
    small: dict[int, bool] = {}
    for out, (dim, name, fk) in dims.items():
        if id(dim) not in small:
            small[id(dim)] = dim.limit(MAX_BROADCAST_NAMES + 1).count() <= MAX_BROADCAST_NAMES
        on = ["library_id"] if library else []
        side = dim.groupBy(*on, F.col("id").alias(fk)).agg(F.min(name).alias(out))
        side = F.broadcast(side) if small[id(dim)] else side
        fact = fact.join(side, [*on, fk], "left").withColumn(out, F.coalesce(out, F.lit("")))
    return fact


def kept_lists(lists: DataFrame, attribute: Column) -> tuple[DataFrame, DataFrame]:
    """(lists and folders, issue rows for smart lists)."""
    from segue.functions.cues import playlists_kind

    kind = playlists_kind(attribute)
    rows = lists.withColumn("_kind", kind)
    kept = rows.where("_kind IN ('list', 'folder')").withColumn(
        "is_folder", F.col("_kind") == "folder"
    )
    smart = rows.where("_kind = 'smart'").select(
        "library_id", F.lit("smart list not converted").alias("rule"),
        F.col("node_id").cast("string").alias("entity_id"), F.col("name").alias("detail"),
    )
    return kept.drop("_kind"), smart
