"""Decoder offsets and measured audio facts.

Audio facts come one row per location; ``header_case`` is A-D for MP3s, 'unreadable'
when the file could not be inspected.  A location without a row was not found.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.functions.cues import DEFAULT_RATE
from segue.functions.text import extension

# --- fixed values: measured offsets (ms) by MP3 decoder and header case -------------------
MP3_OFFSETS = {
    "MAD": {"A": 26, "D": 26},
    "CoreAudio": {"A": 12, "B": 13, "C": 26, "D": 50},
    "FFmpeg": {"D": 26},
}
LAME_CASE = "D"
FALLBACK_MP4_MS = 48.0
AAC_PRIMING_SAMPLES = 2112
MP3_FRAME_SAMPLES = 1152
SERATO_FRAME_CASES = ("B", "C")
MP4_EXTENSIONS = ("m4a", "mp4", "aac")
# ------------------------------------------------------------------------------------------


def mp4_priming_ms(priming: Column, codec: Column, timescale: Column) -> Column:
    """Encoder delay: the stated one, else the AAC default."""
    default = F.when(codec == "mp4a", AAC_PRIMING_SAMPLES).otherwise(0)
    samples = F.coalesce(F.nullif(priming, F.lit(0)), default)
    return F.when(timescale > 0, samples * 1000.0 / timescale).otherwise(0.0)


def mixxx_offset(
    ext: Column, header_case: Column, priming: Column, codec: Column, timescale: Column,
    found: Column, decoder: str = "MAD",
) -> Column:
    """struct(ms, issue): what to add to a Mixxx position."""
    table = MP3_OFFSETS[decoder]
    by_case = F.lit(0.0)
    for case, ms in table.items():
        by_case = F.when(header_case == case, float(ms)).otherwise(by_case)
    bad = header_case == "unreadable"
    none = F.lit(None).cast("string")

    def out(ms: Column, issue: Column) -> Column:
        return F.struct(ms.cast("double").alias("ms"), issue.alias("issue"))

    mp4 = (
        F.when(~found, out(F.lit(FALLBACK_MP4_MS), F.lit("file not found; assumed standard AAC priming")))
        .when(bad, out(F.lit(FALLBACK_MP4_MS), F.lit("could not read MP4 encoder delay")))
        .otherwise(out(mp4_priming_ms(priming, codec, timescale), none))
    )
    mp3 = (
        F.when(~found, out(F.lit(float(table.get(LAME_CASE, 0))), F.lit("file not found; assumed a LAME MP3")))
        .when(bad, out(F.lit(0.0), F.lit("could not read MP3 headers")))
        .otherwise(out(by_case, none))
    )
    return (
        F.when(ext.isin(*MP4_EXTENSIONS), mp4).when(ext == "mp3", mp3).otherwise(out(F.lit(0.0), none))
    )


def serato_offset_ms(ext: Column, header_case: Column, rate: Column) -> Column:
    """Serato counts one MPEG frame more where there is a header frame without a valid
    LAME tag (T3)."""
    counted = (ext == "mp3") & header_case.isin(*SERATO_FRAME_CASES) & (rate > 0)
    return F.when(F.coalesce(counted, F.lit(False)), F.lit(MP3_FRAME_SAMPLES * 1000.0) / rate).otherwise(0.0)


def with_facts(tracks: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts as columns ``f_*`` and ``found``; one row per location on the facts side: of
    several, each fact is the least known one."""
    names = [n for n in facts.columns if n != "location"]
    one = facts.groupBy("location").agg(*[F.min(n).alias(n) for n in names])  # NULLs don't count
    one = one.select("location", F.struct(*names).alias("_f"))
    return (
        tracks.join(one, "location", "left")
        .select(tracks["*"], *[F.col(f"_f.{n}").alias(f"f_{n}") for n in names], F.col("_f").isNotNull().alias("found"))
    )


def with_offsets(tracks: DataFrame, facts: DataFrame, decoder: str = "MAD") -> DataFrame:
    """``mixxx_ms``, ``serato_ms`` and ``issue`` per track."""
    rows = with_facts(tracks, facts)
    ext = extension(F.col("location"))
    offset = mixxx_offset(
        ext, F.col("f_header_case"), F.col("f_priming"), F.col("f_codec"), F.col("f_timescale"),
        F.col("found"), decoder,
    )
    serato = serato_offset_ms(ext, F.col("f_header_case"), F.col("f_sample_rate"))
    return rows.withColumn("_o", offset).select(
        tracks["*"], F.col("_o.ms").alias("mixxx_ms"), serato.alias("serato_ms"),
        F.col("_o.issue").alias("issue"),
    )


def measured_or_stated(tracks: DataFrame, facts: DataFrame) -> DataFrame:
    """Measured values where there are any, the catalogue's otherwise; a sample rate known
    to neither becomes 44,100 Hz and is flagged ``rate_unknown`` (J17)."""
    rows = with_facts(tracks, facts)
    out = {}
    for n in ("duration_s", "bitrate", "file_size"):
        if f"f_{n}" in rows.columns and n in tracks.columns:
            out[n] = F.coalesce(F.nullif(F.col(f"f_{n}"), F.lit(0)), F.col(n))
    rate = F.coalesce(F.nullif("f_sample_rate", F.lit(0)), F.nullif("sample_rate", F.lit(0)))
    return rows.select(
        *[n for n in tracks.columns if n not in (*out, "sample_rate")],
        *[v.alias(n) for n, v in out.items()],
        F.coalesce(rate, F.lit(DEFAULT_RATE)).cast("int").alias("sample_rate"),
        rate.isNull().alias("rate_unknown"), "found",
    )


def shift_child(rows: DataFrame, tracks: DataFrame, ms: Column, times: Sequence[str]) -> DataFrame:
    """Move a track's cues or tempo markers by a per-track amount (T4)."""
    moved = rows.join(
        tracks.select("library_id", "track_id", ms.alias("_ms")), ["library_id", "track_id"], "left"
    )
    for t in times:
        moved = moved.withColumn(t, F.col(t) + F.coalesce("_ms", F.lit(0.0)))
    return moved.select(*rows.columns)


def with_tags(tracks: DataFrame, tags: DataFrame) -> DataFrame:
    """Tag values over the catalogue's: the lock when the tag has one, the colour only
    where the catalogue has none (J18).  ``tags(location, locked, colour)``, the colour as
    shown; of several tags of a file, each value is the least known one."""
    one = tags.groupBy("location").agg(F.min("locked").alias("locked"), F.min("colour").alias("colour"))
    one = one.select("location", F.struct("locked", "colour").alias("_t"))
    return (
        tracks.join(one, "location", "left")
        .withColumn("bpm_locked", F.coalesce("_t.locked", "bpm_locked"))
        .withColumn("colour", F.coalesce("colour", "_t.colour"))
        .withColumn("tagged", F.col("_t").isNotNull())
        .drop("_t")
    )


def tags_replace(rows: DataFrame, tag_rows: DataFrame, tagged: DataFrame, times: Sequence[str]) -> DataFrame:
    """Cues or tempo of tagged tracks come from the tags alone, moved from the tags' timeline
    to the catalogue's (J18, T3).  ``tagged(library_id, track_id, serato_ms)``, NULL as 0."""
    on = ["library_id", "track_id"]
    read = tag_rows.join(tagged.select(*on), on, "left_semi")
    return rows.join(tagged.select(*on), on, "left_anti").unionByName(
        shift_child(read, tagged, -F.col("serato_ms"), times).select(*rows.columns)
    )
