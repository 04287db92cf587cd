"""Dimension tables with dense ids in first-use order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.plans.ordered import ranked

# Role columns in the order a track uses them; artist, remixer and composer share one table.
ROLES = (
    ("artist", "artist"), ("album", "album"), ("genre", "genre"), ("label", "label"),
    ("key", "key_name"), ("artist", "remixer"), ("artist", "composer"),
)


def dimension_rows(
    tracks: DataFrame, roles: Sequence[tuple[str, str]] = ROLES, scope: str = "library_id"
) -> DataFrame:
    """``kind, name, id``: ids count from 1 per kind in order of first use.

    A name is reduced to its first use on the map side; ids come from ranks within
    chunks of the track order, so no kind is numbered by a single task.
    """
    present = [(i, kind, col) for i, (kind, col) in enumerate(roles) if col in tracks.columns]
    uses = tracks.select(
        scope, "ordinal",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("at"), F.col(col).alias("name"))
                    for i, kind, col in present
                ]
            )
        ).alias("u"),
    ).where("u.name <> ''")
    first = uses.groupBy(scope, F.col("u.kind").alias("kind"), F.col("u.name").alias("name")).agg(
        F.min(F.struct("ordinal", "u.at")).alias("f")
    )
    rows = first.select(scope, "kind", "name", "f.ordinal", F.col("f.at").alias("at"))
    return ranked(rows, [scope, "kind"], "ordinal", "id", ties=["at"]).drop("ordinal", "at")


def with_dimension_ids(
    tracks: DataFrame, dims: DataFrame, roles: Sequence[tuple[str, str]] = ROLES,
    scope: str = "library_id",
) -> DataFrame:
    """``<column>_id`` per role; '' gives 0."""
    out = tracks
    for kind, col in roles:
        if col not in tracks.columns:
            continue
        side = dims.where(F.col("kind") == kind).select(
            scope, F.col("name").alias(col), F.col("id").alias(f"{col}_id")
        )
        out = out.join(side, [scope, col], "left").withColumn(
            f"{col}_id", F.coalesce(f"{col}_id", F.lit(0))
        )
    return out
