"""Waveform summaries from decoded samples.

Samples arrive as rows (track, frame, levels).  Everything is grouped by (track, column)
or (track, bucket), or runs in chunks of the column number; a single long track is spread
like any other data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segue.plans.ordered import group_values, running_max
from segue.session import materialise

# --- fixed values: rates, release factors, gain targets and scales of the target format ---
COLUMNS_PER_SECOND = 150
SAMPLE_RATE = 11025
BANDS = ("low", "mid", "high")
RELEASE = (0.97, 0.93, 0.90)
GAIN_TARGET = (78.0, 105.0, 115.0)
GAIN_FLOOR = (80, 80, 95)
GAIN_CAP = (267, 300, 500)
BAND_SCALE = (1.25, 1.15, 0.6)
PREVIEW_BAND_SCALE = (0.56, 0.71, 2.0)
COLOUR_SCALE = (2.4, 1.6, 1.1)
FLAT = {"detail": 140, "tiny": 8, "preview": 140, "relative": 28208, "band": 40, "band_preview": 30}
FLAT_COLOUR = (80, 164, 80, 40, 60, 40)
# -------------------------------------------------------------------------------------------

TRACK = ["track_id"]
CHUNK_COLUMNS = 1 << 14


def _bound(column: Column, rate: int) -> Column:
    """First frame of a column; ties round to even."""
    return F.rint(column * rate / F.lit(float(COLUMNS_PER_SECOND))).cast("bigint")


def column_of(frame: Column, rate: int) -> Column:
    guess = F.floor(frame * COLUMNS_PER_SECOND / F.lit(float(rate)))
    return (
        F.when(_bound(guess + 1, rate) <= frame, guess + 1)
        .when(_bound(guess, rate) <= frame, guess)
        .otherwise(guess - 1)
    )


def signal_columns(samples: DataFrame, rate: int = SAMPLE_RATE) -> DataFrame:
    """Peaks per channel, sum of squares and sample count per 1/150 s.

    ``samples(track_id, frame, full, white, low, mid, high)``, frames 0..n-1 without holes.
    """
    if rate < 2 * COLUMNS_PER_SECOND:
        raise ValueError("at least two samples per column are needed")

    def peak(name: str) -> Column:
        return F.greatest(F.max(name), -F.min(name)).alias("peak" if name == "full" else name)

    cols = samples.groupBy(*TRACK, column_of(F.col("frame"), rate).alias("col")).agg(
        *[peak(n) for n in ("full", "white", *BANDS)],
        F.sum(F.col("full") * F.col("full")).alias("sumsq"), F.count(F.lit(1)).alias("samples"),
    )
    # the last column can be empty when its first frame rounds up to the end of the track
    ends = samples.groupBy(*TRACK).agg((F.max("frame") + 1).alias("frames"))
    n = F.ceil(F.col("frames") * COLUMNS_PER_SECOND / F.lit(float(rate)))
    empty = ends.withColumn("col", n - 1).where(_bound(F.col("col"), rate) >= F.col("frames"))
    zero = F.lit(0.0)
    return cols.unionByName(
        empty.select(
            *TRACK, "col", *[zero.alias(x) for x in ("peak", "white", *BANDS, "sumsq")],
            F.lit(0).cast("bigint").alias("samples"),
        )
    )


def _salt() -> Column:
    return F.floor(F.col("col") / CHUNK_COLUMNS)


def detail(columns: DataFrame) -> DataFrame:
    """Per column: ``height`` 0-31, ``whiteness`` 0-7, ``packed`` byte (W2), decayed band
    envelopes (W3), scaled bands 0-127 (W4) and ``relative`` band word (W5), with the
    track's column count ``n``."""
    c = F.col
    decay = {
        f"_e{j}": F.when(c(b) > 0, F.ln(c(b)) - c("col") * math.log(r))
        for j, (b, r) in enumerate(zip(BANDS, RELEASE))
    }
    rows = running_max(columns, TRACK, "col", decay)
    for j, (b, r) in enumerate(zip(BANDS, RELEASE)):
        env = F.coalesce(F.exp(c(f"_e{j}") + c("col") * math.log(r)), F.lit(0.0))
        rows = rows.withColumn(f"env_{b}", env).drop(f"_e{j}")
    rows = group_values(
        rows, TRACK, _salt(),
        {
            "top": ("max", c("peak")), "n": ("count", F.lit(1)),
            **{f"top_{b}": ("max", c(f"env_{b}")) for b in BANDS},
        },
    )
    ratio = c("peak") / c("top")
    height = F.when(c("top") > 0, F.least(F.lit(31), F.floor(F.lit(31.5) * ratio * ratio))).otherwise(0)
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("white") / c("peak")))
    white = F.when(c("peak") <= 0, 7).otherwise(7 - F.least(F.lit(7), F.floor(F.lit(8) * share)))
    rows = rows.withColumn("height", height.cast("int")).withColumn("whiteness", white.cast("int"))
    for j, b in enumerate(BANDS):
        gain = F.when(
            c(f"top_{b}") > 0,
            F.least(F.lit(GAIN_CAP[j]), F.greatest(F.lit(GAIN_FLOOR[j]), F.rint(F.lit(GAIN_TARGET[j]) / c(f"top_{b}")))),
        ).otherwise(GAIN_FLOOR[j])
        rows = rows.withColumn(f"gain_{b}", gain.cast("int"))
        scaled = F.rint(F.lit(BAND_SCALE[j]) * c(f"gain_{b}") * c(f"env_{b}"))
        rows = rows.withColumn(f"scaled_{b}", F.least(F.lit(127), scaled).cast("int"))
    strongest = F.greatest(*BANDS)

    def level(b: str) -> Column:
        share = F.rint(F.lit(7) * F.sqrt(c(b) / strongest))
        return F.when(strongest <= 0, 0).otherwise(F.least(F.lit(7), share)).cast("int")

    word = c("height") * 4
    for shift, b in zip((13, 10, 7), BANDS):
        word = word + F.shiftleft(level(b), shift)
    return rows.withColumn("packed", F.shiftleft(c("whiteness"), 5) + c("height")).withColumn(
        "relative", word
    ).drop("top", *[f"top_{b}" for b in BANDS])


def track_gains(details: DataFrame) -> DataFrame:
    return details.groupBy(*TRACK).agg(*[F.max(f"gain_{b}").alias(f"gain_{b}") for b in BANDS])


# --- W6: previews --------------------------------------------------------------------------
def buckets_of(col: Column, n: Column, parts: int) -> Column:
    """Buckets 0..parts-1 a column falls in.  Bucket k starts at ``k * n div parts``; with
    fewer columns than buckets a column is repeated."""
    last = F.ceil((col + 1) * parts / n) - 1
    first = F.when(n >= parts, last).otherwise(F.ceil(col * parts / n))
    return F.sequence(first.cast("int"), last.cast("int"))


def _bucketed(details: DataFrame, parts: int, *aggs: Column) -> DataFrame:
    rows = details.withColumn("bucket", F.explode(buckets_of(F.col("col"), F.col("n"), parts)))
    return rows.groupBy(*TRACK, "bucket").agg(*aggs)


def _rms(details: DataFrame, parts: int) -> DataFrame:
    total = F.sum("samples")
    rms = F.when(total > 0, F.sqrt(F.sum("sumsq") / total)).otherwise(0.0)
    out = _bucketed(details, parts, rms.alias("rms"))
    # `parts` rows per track, a constant: a plain window is bounded
    return out.withColumn("top", F.max("rms").over(W.partitionBy(*TRACK)))


def preview(details: DataFrame) -> DataFrame:
    """400 packed bytes: loudness to the loudest bucket, whiteness of 200 buckets."""
    details = materialise(
        details.select(*TRACK, "col", "n", "samples", "sumsq", "whiteness"), "signal-detail"
    )
    loud = _rms(details, 400)
    mean = F.rint(F.sum("whiteness") / F.count(F.lit(1)))
    white = _bucketed(details, 200, mean.alias("w")).withColumnRenamed("bucket", "half")
    rows = loud.withColumn("half", F.floor(F.col("bucket") / 2).cast("int")).join(white, [*TRACK, "half"])
    height = F.when(F.col("top") > 0, F.least(F.lit(31), F.rint(F.lit(24) * F.col("rms") / F.col("top")))).otherwise(0)
    return rows.select(
        *TRACK, "bucket",
        (F.shiftleft(F.least(F.lit(7), F.col("w")).cast("int"), 5) + height.cast("int")).alias("packed"),
    )


def tiny_preview(details: DataFrame) -> DataFrame:
    """100 values 0-15."""
    level = F.rint(F.lit(15) * F.sqrt(F.col("rms") / F.col("top")))
    return _rms(details, 100).select(
        *TRACK, "bucket",
        F.when(F.col("top") > 0, F.least(F.lit(15), level)).otherwise(0).cast("int").alias("level"),
    )


def band_preview(details: DataFrame) -> DataFrame:
    """1200 buckets of three bands 0-127."""
    return _bucketed(
        details, 1200,
        *[
            F.least(F.lit(127), F.rint(F.lit(s) * F.sum(f"scaled_{b}") / F.count(F.lit(1))))
            .cast("int").alias(b)
            for b, s in zip(BANDS, PREVIEW_BAND_SCALE)
        ],
    )


def colour_preview(bands: DataFrame) -> DataFrame:
    """Six bytes per bucket of the band preview."""
    for b, s in zip(BANDS, COLOUR_SCALE):
        bands = bands.withColumn(b, F.least(F.lit(127), F.rint(F.lit(s) * F.col(b))).cast("int"))
    strongest = F.greatest(*BANDS)
    norm = F.sqrt(sum((F.col(b) * F.col(b) for b in BANDS), F.lit(0)))
    some = strongest > 0
    b0 = F.when(some, F.least(F.lit(127), F.rint(F.lit(0.88) * strongest + 38))).otherwise(0)
    b2 = F.when(some, F.least(F.lit(127), F.rint(F.lit(0.91) * norm))).otherwise(0)
    b1 = F.when(some, F.least(F.lit(255), F.greatest(F.lit(0), F.rint(F.lit(203) - F.lit(0.49) * b0)))).otherwise(0)
    return bands.select(
        *TRACK, "bucket", b0.cast("int").alias("b0"), b1.cast("int").alias("b1"),
        b2.cast("int").alias("b2"), *[F.col(b).alias(f"b{3 + j}") for j, b in enumerate(BANDS)],
    )


def flat_detail(tracks: DataFrame) -> DataFrame:
    """Placeholder columns for tracks that could not be measured."""
    n = F.greatest(F.lit(1), F.ceil(F.col("duration_s") * COLUMNS_PER_SECOND)).cast("int")
    return tracks.select(*TRACK, F.explode(F.sequence(F.lit(0), n - 1)).alias("col")).select(
        *TRACK, F.col("col").cast("bigint").alias("col"), F.lit(FLAT["detail"]).alias("packed"),
        F.lit(FLAT["relative"]).alias("relative"),
        *[F.lit(FLAT["band"]).alias(f"scaled_{b}") for b in BANDS],
    )
