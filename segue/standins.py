"""Neutral tables derived from the supplied star schema.

Each function mirrors a view of the same name in `segue.catalog.sql`, so every
query can be checked against SQL over the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATH_RULES = (
    ("/home", "/elsewhere"),
    ("/home/dj/Music", "/usb/Music"),
    ("/home/dj/Music/none", "/never"),
    ("D:\\DJ", "/usb/dj"),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tracks_a(spark: SparkSession, sf: str) -> DataFrame:
    """The base catalogue: one track per part."""
    return table(spark, sf, "part").select(
        F.lit("ab").alias("pair_id"), F.lit("A").alias("library_id"),
        F.concat(F.lit("a:"), F.col("p_partkey").cast("string")).alias("track_id"),
        F.col("p_partkey").alias("ordinal"),
        F.concat(
            F.lit("/usb/Music/"), "p_brand", F.lit("/"), "p_name", F.lit(" "),
            (F.col("p_partkey") % 500).cast("string"), F.lit(".mp3"),
        ).alias("location"),
        F.col("p_name").alias("title"), F.col("p_brand").alias("artist"),
        F.col("p_type").alias("genre"), F.col("p_size").cast("double").alias("duration_s"),
        F.rint(F.col("p_retailprice") * 100).cast("bigint").alias("file_size"),
        (60 + F.col("p_size")).cast("double").alias("bpm"),
        F.col("p_size").alias("p_size"), F.col("p_partkey").alias("n"),
    )


def tracks_b(spark: SparkSession, sf: str) -> DataFrame:
    """The incoming catalogue: every part again, changed in one of several ways."""
    a = tracks_a(spark, sf)
    m = F.col("n") % 10
    name = F.concat("title", F.lit(" "), (F.col("n") % 500).cast("string"))
    key = F.col("n").cast("string")
    location = (
        F.when(m < 2, F.concat(F.lit("/home/dj/Music/"), "artist", F.lit("/"), name, F.lit(".mp3")))
        .when(m < 4, F.concat(F.lit("/other/"), name, F.lit(".mp3")))
        .when(m < 6, F.concat(F.lit("/other/renamed "), key, F.lit(".mp3")))
        .when(m == 6, F.concat(F.lit("/other/"), name, F.lit(".flac")))
        .otherwise(F.concat(F.lit("/new/file "), key, F.lit(".mp3")))
    )
    title = (
        F.when(m < 4, F.col("title"))
        .when(m < 6, F.upper("title"))
        .when(m == 6, F.concat(F.lit("other "), "title"))
        .when(m < 9, F.concat(F.lit("new "), key))
        .otherwise(F.col("title"))
    )
    artist = (
        F.when((m >= 4) & (m < 6), F.lower("artist"))
        .when(m.isin(7, 8), F.concat(F.lit("nobody "), key))
        .otherwise(F.col("artist"))
    )
    return a.select(
        "pair_id", F.lit("B").alias("library_id"),
        F.concat(F.lit("b:"), key).alias("track_id"), "ordinal",
        location.alias("location"), title.alias("title"), artist.alias("artist"),
        F.when(m < 5, F.col("genre")).otherwise("").alias("genre"),
        (
            F.col("duration_s")
            + F.when((m >= 4) & (m < 6), 1.0).when(m == 9, 5.0).otherwise(0.0)
        ).alias("duration_s"),
        F.when(m < 4, F.col("file_size"))
        .when(m.isin(7, 8), F.col("n") + 1)
        .otherwise(F.lit(0))
        .cast("bigint")
        .alias("file_size"),
        F.col("bpm"), "p_size", "n",
    )


def _line_ordinal():
    cents = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
    return (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000_000 + (
        F.col("l_suppkey") * 7919 + cents
    ) % 1_000_000_000


def cues(spark: SparkSession, sf: str, side: str = "a") -> DataFrame:
    """Cues of every track, one per line item.  Side ``a`` takes odd suppliers, ``b`` even
    ones; ``all`` gives every line item to the base tracks."""
    li = table(spark, sf, "lineitem")
    if side != "all":
        li = li.where(F.col("l_suppkey") % 2 == (1 if side == "a" else 0))
    prefix = "b" if side == "b" else "a"
    position = F.rint("l_extendedprice")
    loop = F.col("l_returnflag") == "R"
    return li.select(
        F.lit("ab").alias("pair_id"), F.lit(prefix.upper()).alias("library_id"),
        F.concat(F.lit(f"{prefix}:"), F.col("l_partkey").cast("string")).alias("track_id"),
        _line_ordinal().alias("ordinal"),
        F.when(loop, "loop").otherwise("cue").alias("role"), position.alias("position_ms"),
        F.when(loop, position + F.col("l_quantity") * 1000).alias("end_ms"),
        F.when(F.col("l_returnflag") != "N", F.col("l_linenumber") - 1).cast("int").alias("slot"),
        F.col("l_linestatus").alias("name"),
        F.when(F.col("l_suppkey") % 3 == 0, F.lit(0x28E214)).cast("int").alias("colour"),
        F.lit(False).alias("locked"),
    )


def tempo(spark: SparkSession, sf: str, side: str = "a") -> DataFrame:
    """Three markers per track: a start, one on its grid, and a tempo change.  Base tracks
    of ten seconds or less are too short to have a grid."""
    part = table(spark, sf, "part")
    if side == "a":
        part = part.where("p_size > 10")
    bpm = (F.col("p_size") + 60).cast("double")
    if side == "b":
        bpm = bpm + F.when(F.col("p_partkey") % 4 == 0, 0.5).otherwise(0.0)
    beat = F.lit(60000.0) / bpm

    def marker(at, tempo_, number):
        return F.struct(at.alias("position_ms"), tempo_.alias("bpm"), F.lit(number).alias("beat"))

    return part.select(
        F.lit("ab").alias("pair_id"), F.lit(side.upper()).alias("library_id"),
        F.concat(F.lit(f"{side}:"), F.col("p_partkey").cast("string")).alias("track_id"),
        F.explode(
            F.array(
                marker(F.lit(25.0), bpm, 1), marker(beat * 64 + 25.0, bpm, 1),
                marker(beat * 98 + 25.0, bpm + 10, 3),
            )
        ).alias("m"),
    ).select("pair_id", "library_id", "track_id", "m.position_ms", "m.bpm", "m.beat")


def nodes(spark: SparkSession, sf: str, side: str = "a") -> DataFrame:
    """One list per order in a folder per priority; pending orders are new on side ``b``."""
    key = F.col("o_orderkey").cast("string")
    name = key
    if side == "b":
        name = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("new "), key)).otherwise(key)
    return table(spark, sf, "orders").select(
        F.lit("ab").alias("pair_id"), F.lit(side.upper()).alias("library_id"),
        F.concat(F.lit(f"{side}:"), key).alias("node_id"), F.col("o_orderkey").alias("ordinal"),
        F.array(F.col("o_orderpriority"), name).alias("path"), name.alias("name"),
        F.lit(False).alias("is_folder"), (F.col("o_orderstatus") == "F").alias("is_crate"),
    )


def entries(spark: SparkSession, sf: str, side: str = "a") -> DataFrame:
    li = table(spark, sf, "lineitem")
    if side != "all":
        li = li.where(F.col("l_suppkey") % 2 == (1 if side == "a" else 0))
    prefix = "b" if side == "b" else "a"
    return li.select(
        F.lit("ab").alias("pair_id"), F.lit(prefix.upper()).alias("library_id"),
        F.concat(F.lit(f"{prefix}:"), F.col("l_orderkey").cast("string")).alias("node_id"),
        F.col("l_linenumber").cast("bigint").alias("position"),
        F.concat(F.lit(f"{prefix}:"), F.col("l_partkey").cast("string")).alias("track_id"),
    )


def library(spark: SparkSession, sf: str, side: str):
    from segue.model import Library

    tracks = tracks_a(spark, sf) if side == "a" else tracks_b(spark, sf)
    return Library(
        tracks, cues(spark, sf, side), tempo(spark, sf, side), nodes(spark, sf, side),
        entries(spark, sf, side),
    )
