"""Before-images and undo."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIBRARY_FOLDERS = ("PIONEER", ".PIONEER", "_Serato_")


def before_image(current: DataFrame, planned: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(old rows the plan will change, keys the plan will create)."""
    keys = list(keys)
    touched = planned.select(*keys).distinct()
    return (
        current.join(touched, keys, "left_semi"),
        touched.join(current.select(*keys), keys, "left_anti"),
    )


def revert(
    changed: DataFrame, image: DataFrame, created: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """The table as it was: created rows out, changed rows replaced by their old values."""
    keys = list(keys)
    stay = changed.join(created, keys, "left_anti").join(image.select(*keys), keys, "left_anti")
    return stay.unionByName(image.select(*changed.columns))


def created_files(before: DataFrame, after: DataFrame, backup_mark: str) -> DataFrame:
    """Files a conversion added, library folders and backups aside."""
    top = F.get(F.split("rel_path", "/"), F.lit(0))
    return (
        after.where(~top.isin(*LIBRARY_FOLDERS))
        .where(~F.contains("rel_path", F.lit(backup_mark)))
        .join(before.select("root", "rel_path"), ["root", "rel_path"], "left_anti")
    )


def distinct_sources(found: DataFrame) -> DataFrame:
    """Each discovered library once, with the least of its other columns (U4)."""
    key = ["format", "path"]
    rest = [c for c in found.columns if c not in key]
    if not rest:
        return found.distinct()
    return found.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*[c if c in key else F.col(f"_r.{c}").alias(c) for c in found.columns])
