"""Writing the neutral model (K1)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from segue.model import Library


TABLES = ("libraries", "tracks", "cues", "tempo", "playlist_nodes", "playlist_entries", "quality_issues")


def write_tables(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite", changed: DataFrame | None = None) -> None:
    """One Parquet folder per table, partitioned by library.

    Rows are spread over the library's files by AQE before the write (a `rebalance`
    hint), so one very large library is not written by one task and small ones do not
    leave many files.  With ``changed(library_id)`` only those libraries are written, each in place of its
    old files, and all others keep theirs (M8); a changed library without rows in a table loses them there.
    """
    for name, df in tables.items():
        path = f"{folder.rstrip('/')}/{name}"
        rows = df if changed is None else df.join(changed.select("library_id").distinct(), "library_id", "left_semi")
        writer = rows.hint("rebalance", "library_id").write.mode(mode).partitionBy("library_id")
        (writer if changed is None else writer.option("partitionOverwriteMode", "dynamic")).parquet(path)
        if changed is not None:
            _drop_emptied(rows, changed, path)


def _drop_emptied(rows: DataFrame, changed: DataFrame, path: str) -> None:
    """Delete the folders of changed libraries that have no rows any more: their names alone come to the
    driver, a dynamic overwrite leaves such folders as they were."""
    spark = rows.sparkSession
    gone = changed.select("library_id").distinct().join(rows.select("library_id").distinct(), "library_id", "left_anti")
    for row in gone.where("library_id IS NOT NULL").toLocalIterator():
        folder = spark._jvm.org.apache.hadoop.fs.Path(path, "library_id=" + spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(row.library_id))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def library_tables(library: Library, libraries: DataFrame | None = None, issues: DataFrame | None = None) -> dict[str, DataFrame]:
    tables = {
        "libraries": libraries, "tracks": library.tracks, "cues": library.cues, "tempo": library.tempo,
        "playlist_nodes": library.nodes, "playlist_entries": library.entries, "quality_issues": issues,
    }
    return {name: df for name, df in tables.items() if df is not None}


def write_library(
    library: Library, folder: str, libraries: DataFrame | None = None, issues: DataFrame | None = None, changed: DataFrame | None = None
) -> None:
    write_tables(library_tables(library, libraries, issues), folder, changed=changed)


def read_tables(spark, folder: str, names=TABLES[1:-1]):
    return {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}") for n in names}
