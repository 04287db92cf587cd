"""Finding libraries in a file inventory (A10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.operators.reports import first_k, in_hidden_folder

# The files that give a library away, their format, and where the library's
# folder is seen from the file (folders up).  Lower choice wins within a format.
MARKS = (
    (r"(^|/)PIONEER/rekordbox/(export\.pdb|exportLibrary\.db)$", "rekordbox_usb", 3, 0),
    (r"(^|/)\.PIONEER/rekordbox/(export\.pdb|exportLibrary\.db)$", "rekordbox_usb", 3, 1),
    (r"(^|/)_Serato_/database V2$", "serato", 2, 0),
    (r"(^|/)database V2$", "serato", 1, 1),
    (r"(^|/)\.mixxx/mixxxdb\.sqlite$", "mixxx", 2, 1),
    (r"(^|/)mixxxdb\.sqlite$", "mixxx", 1, 0),
    (r"(^|/)rekordbox/master\.db$", "rekordbox_db", 2, 1),
    (r"(^|/)master\.db$", "rekordbox_db", 1, 0),
    (r"(?i)\.xml$", "rekordbox_xml", 1, 2),
)
REMOVABLE = r"^(/media/|/mnt/|/Volumes/|/run/media/)"


def find_libraries(inventory: DataFrame) -> DataFrame:
    """``format, path, home, serato_root`` per library: ``inventory(root, rel_path)`` rows
    are classified by path, hidden folders skipped, one candidate kept per home folder and
    format.  XML files count only where ``is_collection`` says their head was checked, and
    only in folders without another library."""
    mark, up, choice = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int")
    for pattern, fmt, n, order in reversed(MARKS):
        hit = F.col("rel_path").rlike(pattern)
        mark = F.when(hit, fmt).otherwise(mark)
        up = F.when(hit, n).otherwise(up)
        choice = F.when(hit, order).otherwise(choice)
    seen = inventory.withColumn("_visible", ~in_hidden_folder(F.regexp_replace("rel_path", r"(^|/)\.PIONEER/", "$1PIONEER/")))
    rows = seen.where("_visible").select(
        "root", "rel_path", mark.alias("format"), up.alias("_up"), choice.alias("_choice"),
        *(["is_collection"] if "is_collection" in inventory.columns else []),
    ).where("format IS NOT NULL")
    if "is_collection" in rows.columns:
        rows = rows.where("format <> 'rekordbox_xml' OR is_collection")
    path = F.concat("root", F.lit("/"), "rel_path")
    parts = F.split(path, "/")
    rows = rows.withColumn("path", path).withColumn(
        "home", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - F.col("_up")), "/")
    )
    databases = rows.where("format <> 'rekordbox_xml'")
    best = first_k(databases, ["home", "format"], [F.col("_choice"), F.col("path")], 1)
    xml = rows.where("format = 'rekordbox_xml'").join(best.select("home").distinct(), "home", "left_anti")
    found = best.unionByName(xml.select(*best.columns))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    shown = (
        F.when(F.col("format") == "rekordbox_usb", F.col("home"))
        .when(F.col("format") == "serato", folder)
        .otherwise(F.col("path"))
    )
    root = F.when(
        F.col("format") == "serato",
        F.when(F.col("home").rlike(REMOVABLE), F.col("home")).otherwise(F.lit("/")),
    )
    return found.select("format", shown.alias("path"), "home", root.alias("serato_root"))
